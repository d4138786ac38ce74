"""Graph queries over all edges, against brute force."""

import random

from quillspan.operators import graph
from quillspan.plans import knowledge

SF = "/root/testdata/sf0.001"


def greedy(edges):
    """Edges (confidence, src, dst), best first, each unless its target already leads to its source."""
    after, kept = {}, set()
    for _, a, b in sorted(edges, reverse=True):
        stack, seen = [b], {b}
        while stack:
            for n in after.get(stack.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        if a not in seen:
            after.setdefault(a, []).append(b)
            kept.add((a, b))
    return kept


def test_acyclic_on_random_graphs(spark):
    rng = random.Random(3)
    rows = [(g, a, b, rng.randrange(9) / 8) for g, n, p in ((1, 12, 0.2), (2, 25, 0.5), (3, 40, 0.06)) for a in range(n) for b in range(n) if rng.random() < p]
    got = {(r["lecture_id"], r["src"], r["dst"]) for r in graph.acyclic(spark.createDataFrame(rows, "lecture_id long, src long, dst long, confidence double")).collect()}
    assert got == {(g, a, b) for g in (1, 2, 3) for a, b in greedy([(c, a, b) for h, a, b, c in rows if h == g])}


def test_dag_enforced_takes_every_edge_of_a_lecture(spark):
    brand = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    lectures = {}
    for c, a, b in (tuple(r) for r in knowledge.scored_pairs(spark, SF).filter("confidence >= 0.65").select("confidence", "src", "dst").collect()):
        if brand[a] == brand[b]:
            lectures.setdefault(brand[a], []).append((c, a, b))
    got = {(r["lecture_id"], r["src"], r["dst"]) for r in knowledge.dag_enforced(spark, SF).collect()}
    assert got == {(k, a, b) for k, rows in lectures.items() for a, b in greedy(rows)}
    assert len(lectures) > 2 and len(got) < sum(map(len, lectures.values()))


def test_strong_components(spark):
    """Against reach both ways, on graphs of one large and many small cycles, chains, loops and nulls."""
    rng = random.Random(4)
    for n, p in ((30, 0.05), (40, 0.03), (25, 0.2)):
        edges = {(a, b) for a in range(n) for b in range(n) if rng.random() < p} | {(100 + i, 101 + i) for i in range(6)} | {(200 + i, 200 + (i + 1) % 7) for i in range(7)}
        reach = {a: {a} for e in edges for a in e}
        for _ in reach:
            for a, b in edges:
                reach[a] |= reach[b]
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if (a, a) in edges or any(a in reach[b] for b in reach[a] - {a})}
        got = graph.strong_components(spark.createDataFrame([*edges, (1, None), (None, 2)], "src long, dst long"))
        assert {r["node"]: r["component"] for r in got.collect()} == want
    assert graph.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).collect() == []


def test_peeling(spark):
    rows = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 1, 2), (2, 2, 1), (2, 2, 3), (2, 0, 1), (3, 5, 5)]
    got = graph.validated(spark.createDataFrame(rows, "lecture_id int, src long, dst long"))
    # what comes after a cycle can't be peeled from the sources either
    assert {(r["lecture_id"], r["edges"], r["on_cycles"]) for r in got.collect()} == {(1, 3, 0), (2, 4, 3), (3, 1, 1)}


def test_enforced_graph_has_no_cycle(spark):
    got = {r["enforced"]: r for r in knowledge.dag_is_acyclic(spark, SF).collect()}
    assert got[False]["on_cycles"] > 0 and got[True]["on_cycles"] == 0
