"""Fuzzy searches over all names, against brute force."""

import random
import re
from difflib import SequenceMatcher

import pytest

from quillspan.functions import fixed
from quillspan.operators import fuzzy
from quillspan.plans import extracted, knowledge
from quillspan.plans import mapping as m

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) >= 2 and w not in fixed.ENTITY_STOPWORDS]


def stem(w):
    if len(w) <= 3:
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if any(w.endswith(e) for e in ("ses", "xes", "ches", "shes")):
        return w[:-2]
    return w[:-1] if re.search("[^s]s$", w) else w


def score(query, name):
    q, n = words(query), words(name)
    if not q or not n:
        return 0.0
    both = {stem(w) for w in q} & {stem(w) for w in n}
    share = len(both) / len({stem(w) for w in n})
    if both:
        return 1.0 if share == 1 else 0.7 + 0.3 * share
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    near = [max(ratio(a, b) for a in q) for b in n]
    if len(n) == 1:
        return near[0] if near[0] >= 0.82 else 0.0
    most = max(sum(near) / len(near), ratio(" ".join(n), " ".join(q)))
    return most if most >= 0.72 else 0.0


def best(query, names, k=3):
    found = [(-round(score(query, n), 6), n, i) for i, n in names]
    return [(i, -s) for s, n, i in sorted(f for f in found if f[0] < 0)[:k]]


@pytest.mark.parametrize(
    ("query", "column", "ask", "case"),
    [(knowledge.graph_fuzzy_seed, "node", lambda n: n[:3] + "x" + n[4:], str.lower), (extracted.fuzzy_entity_scores, "entity_id", lambda n: f"what is the {n}s like", str)],
)
def test_top_three_of_all_names(spark, query, column, ask, case):
    names = {r["entity_id"]: r["name"] for r in m.entities(spark, SF).collect()}
    want = {(i, k, s) for i in names if i % 20 == 0 for k, s in best(ask(names[i].lower()), [(k, case(n)) for k, n in names.items()])}
    assert {(r["query_id"], r[column], r["score"]) for r in query(spark, SF).collect()} == want
    assert {q for q, _, _ in want} >= {20, 100}


def misspelt(made, w):
    i = made.randrange(len(w) + 1)
    return made.choice([w, w[:i] + made.choice("aeinrstx") + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], w + "s"])


def test_best_names_against_brute_force(spark):
    made = random.Random(13)
    base = ["".join(made.choice("aeinrstlo") for _ in range(made.randrange(1, 12))) for _ in range(60)] + ["the", "processes", "dijkstra", "boxes", "42"]
    name = lambda: " ".join(misspelt(made, made.choice(base)) or "a" for _ in range(made.choice([1, 1, 2, 2, 3])))
    names = [(i, name()) for i in range(400)] + [(400, ""), (401, "!"), (402, None), (403, "Dijkstra's process"), (404, "dijkstra")] + [(500 + i, "same name") for i in range(20)]
    queries = [(i, f"What is {name()}?" if i % 2 else name()) for i in range(80)] + [(80, None), (81, "the of"), (82, "dijsktra"), (83, "same nam")]
    got = fuzzy.best_names(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(names, "node long, name string"))
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.node, r.score))
    want = {i: best(q or "", [(k, n or "") for k, n in names]) for i, q in queries}
    assert found == {i: b for i, b in want.items() if b}
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())


def test_bounds_lose_no_alike_pair(spark):
    made = random.Random(14)
    strings = sorted({"".join(made.choice("abcde ") for _ in range(made.randrange(1, 14))).strip() for _ in range(150)} - {""})
    for least in (0.5, 0.72, 0.9):
        d = spark.createDataFrame([(s,) for s in strings], "text string")
        got = {tuple(r) for r in fuzzy.possibly_alike(d, d, least).collect()}
        assert got >= {(a, b) for a in strings for b in strings if SequenceMatcher(None, a, b).ratio() >= least}
        assert len(got) < len(strings) ** 2
