"""Traversals and checks of typed graphs: a few unrolled joins, or an iteration over tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.scratch import written

HOPS = 3


def trails(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, backward: bool = False, along: str = "edge_id") -> DataFrame:
    """query_id, start, node, hops, path (edge ids), along (a column's values of these edges) of trails along the edges (against them if backward): no edge twice, the end is not the start.

    Only the seeds' surroundings are joined; each hop is one equi-join on the frontier, by merging: files of edges are
    small for their rows, which a broadcast would hold whole.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("edge_id").alias("_e"), F.col(along).alias("_v")).hint("merge")
    kind = edges.schema[along].dataType.simpleString()
    front = seeds.select("query_id", F.col("node").alias("start"), F.col("node"), F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("path"), F.array().cast(f"array<{kind}>").alias("along"))
    found = []
    for _ in range(hops):
        on = (F.col("node") == F.col("_from")) & ~F.array_contains("path", F.col("_e"))
        longer = [F.concat(c, F.array(v)).alias(c) for c, v in (("path", "_e"), ("along", "_v"))]
        front = front.join(step, on).select("query_id", "start", F.col("_to").alias("node"), (F.col("hops") + 1).alias("hops"), *longer)
        found.append(front)
    return reduce(DataFrame.unionAll, found).filter("node <> start")


def simple_paths_back(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """query_id, start, node, depth, path of nodes leading to a seed, none of them twice."""
    step = edges.select(F.col("dst").alias("_at"), F.col("src").alias("_before"))
    front = seeds.select("query_id", F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    found = []
    for _ in range(depth):
        on = (F.col("node") == F.col("_at")) & ~F.array_contains("path", F.col("_before"))
        front = front.join(step, on).select("query_id", "start", F.col("_before").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_before")).alias("path"))
        found.append(front)
    return reduce(DataFrame.unionAll, found)


def least_depth(paths: DataFrame) -> DataFrame:
    """All paths of each node at its least depth."""
    w = Window.partitionBy("query_id", "node")
    return paths.withColumn("_m", F.min("depth").over(w)).filter("depth = _m").drop("_m")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """entity_id, degree over both directions; 0 for orphans."""
    ends = edges.select(F.col("src").alias("entity_id")).union(edges.select(F.col("dst").alias("entity_id")))
    return nodes.join(ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")), "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def trail_counts(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, backward: bool = False) -> DataFrame:
    """query_id, node, hops, n: how many trails() of each length lead from a query's starts to another node, for at most three hops.

    Walks are summed over the starts of a query after each hop, so the frontier is one
    row per query and node.  What isn't such a trail is taken off at the end: walks back to their own
    start, whose number depends on the node alone, and walks that take one edge twice.
    Edges are one per ordered pair, without loops; then the only walk of three edges
    that repeats one goes there, back, and there again.  Queries with the same
    starts should ask once, under one id.
    """
    if hops > 3:
        raise ValueError("longer trails can repeat edges in more ways: list them")
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    starts = seeds.select("query_id", "node").distinct()
    front, found = starts.withColumn("n", F.lit(1).cast("long")), []
    for k in range(1, hops + 1):
        front = front.join(step, F.col("node") == F.col("_from")).groupBy("query_id", F.col("_to").alias("node")).agg(F.sum("n").alias("n"))
        found.append(front.select("query_id", "node", F.lit(k).alias("hops"), "n"))
    two = step.join(step.select(F.col("_from").alias("_to"), F.col("_to").alias("_third")), "_to") if hops > 1 else None
    for k in range(2, hops + 1):
        if k == 2:
            closed = two.filter("_third = _from").select(F.col("_from").alias("node"))
        else:
            closed = two.join(step.select(F.col("_from").alias("_third"), F.col("_to").alias("_last")), "_third").filter("_last = _from").select(F.col("_from").alias("node"))
        closed = closed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        found.append(starts.join(closed, "node").select("query_id", "node", F.lit(k).alias("hops"), (-F.col("n")).alias("n")))
    if hops == 3:
        mutual = step.join(step.select(F.col("_to").alias("_from"), F.col("_from").alias("_to")), ["_from", "_to"])
        back = starts.join(mutual, F.col("node") == F.col("_from")).groupBy("query_id", F.col("_to").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        found.append(back.select("query_id", "node", F.lit(3).alias("hops"), (-F.col("n")).alias("n")))
    return reduce(DataFrame.unionAll, found).groupBy("query_id", "node", "hops").agg(F.sum("n").alias("n")).filter("n > 0")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has one coming in and whose target has one going out."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")


def _spread(marks: DataFrame, step: DataFrame) -> DataFrame:
    """node, mark: the least mark that reaches each node along step (_from, _to), from marks (node, mark); a round per hop of the longest such way."""
    found, n = written(marks, "marks"), None
    while True:
        carried = found.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), "mark")
        new = written(found.union(carried).groupBy("node").agg(F.min("mark").alias("mark")), "marks")
        state = new.agg(F.count(F.lit(1)), F.sum(F.col("mark").cast("decimal(38,0)"))).first()
        if state == n:
            return new
        found, n = new, state


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): strongly connected nodes, and nodes with a loop; others don't appear.

    Each turn spreads least ids along the edges, then back from the nodes that kept
    their own: what is met by both is a component of the node whose id it has.
    Components leave, and edges that can be on no cycle are trimmed, until none is left.
    """
    e = edges.select("src", "dst").dropna().distinct()
    loops = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e, found = written(_trimmed(e.filter("src <> dst")), "arcs"), []
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
        ahead = _spread(nodes.select("node", F.col("node").alias("mark")), e.select(F.col("src").alias("_from"), F.col("dst").alias("_to")))
        # back, within one colour
        inside = e.join(ahead.select(F.col("node").alias("src"), F.col("mark").alias("a")), "src").join(ahead.select(F.col("node").alias("dst"), F.col("mark").alias("b")), "dst").filter("a = b")
        inside = written(inside.select(F.col("dst").alias("_from"), F.col("src").alias("_to")), "inside")
        back = _spread(ahead.filter("node = mark"), inside)
        found.append(back.select("node", F.col("mark").alias("component")))
        gone = back.select("node")
        e = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        e = written(_trimmed(e), "arcs")
    whole = reduce(DataFrame.union, found) if found else loops.limit(0)
    many = whole.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("component")
    return whole.join(many, "component", "left_semi").select("node", "component").union(loops).groupBy("node").agg(F.min("component").alias("component"))


def _without_cycles(src: list, dst: list, rank: dict) -> list[int]:
    """Numbers of the edges kept when they are added in turn, each unless its target already leads to its source.

    `rank` is an order of all nodes; it stays a topological order of what is kept, so a
    search for a way back stops at the source's place (Pearce and Kelly 2006).
    """
    after: dict = {n: set() for n in rank}
    before: dict = {n: set() for n in rank}

    def reach(start, step: dict, within) -> set:
        stack, seen = [start], {start}
        while stack:
            for n in step[stack.pop()]:
                if n not in seen and within(rank[n]):
                    seen.add(n)
                    stack.append(n)
        return seen

    kept = []
    for i, (a, b) in enumerate(zip(src, dst, strict=True)):
        low, high = rank[b], rank[a]
        if a == b or a in after[b]:
            continue
        if low < high and b not in after[a]:
            ahead = reach(b, after, lambda r: r <= high)  # noqa: B023
            if a in ahead:
                continue
            behind = reach(a, before, lambda r: r >= low)  # noqa: B023
            moved = sorted(behind, key=rank.__getitem__) + sorted(ahead, key=rank.__getitem__)
            rank.update(zip(moved, sorted(rank[n] for n in moved), strict=True))
        after[a].add(b)
        before[b].add(a)
        kept.append(i)
    return kept


def acyclic(edges: DataFrame, group: str = "lecture_id") -> DataFrame:
    """edges (group, src, dst, confidence) without the least confident edge of each cycle found; ties by (src, dst).

    Edges are added in descending confidence unless their target already leads to
    their source: the edge left out closes a cycle and is the least confident on it.
    One group is one task, as each choice rests on those before it.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["confidence", "src", "dst"], ascending=[False, False, False])
        # sources before targets: a first order that few edges go against
        lean = rows.groupby("src")["confidence"].sum().sub(rows.groupby("dst")["confidence"].sum(), fill_value=0.0)
        rank = {n: k for k, n in enumerate(lean.sort_values(ascending=False).index.tolist())}
        return rows.iloc[_without_cycles(rows["src"].tolist(), rows["dst"].tolist(), rank)]

    return edges.groupBy(group).applyInPandas(keep, edges.schema)


def validated(edges: DataFrame, group: str = "lecture_id") -> DataFrame:
    """group, edges, on_cycles: how many edges of each group are left when sources are peeled off until none is; 0 for a graph without cycles.

    A group is one task, as in acyclic(), whose results this checks.
    """

    def peel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([rows["src"], rows["dst"]]), return_inverse=True)
        a, b = at[: len(rows)], at[len(rows) :]
        order = np.argsort(a, kind="stable")
        starts, incoming = np.searchsorted(a[order], np.arange(len(ids) + 1)), np.bincount(b, minlength=len(ids))
        ready, left = np.flatnonzero(incoming == 0).tolist(), len(rows)
        while ready:
            n = ready.pop()
            own = b[order[starts[n] : starts[n + 1]]]
            left -= len(own)
            for x in own.tolist():
                incoming[x] -= 1
                if not incoming[x]:
                    ready.append(x)
        return pd.DataFrame({group: [rows[group].iloc[0]], "edges": [len(rows)], "on_cycles": [left]})

    kind = edges.schema[group].dataType.simpleString()
    return edges.groupBy(group).applyInPandas(peel, f"{group} {kind}, edges long, on_cycles long")


def distance_scores(mentions: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: 3 for each chunk of an asked entity, 1.5 for a neighbour's, 0.5 for a second neighbour's (not the entity itself); parallel edges count.

    Weights are summed after each hop, so a query has one row for a node; ways back to
    where they began are as many as the squares of a node's parallel edges.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    both = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    starts = asked.groupBy("query_id", F.col("node").alias("entity")).agg(F.count(F.lit(1)).alias("n"))

    def hop(front: DataFrame) -> DataFrame:
        return front.join(both.withColumnRenamed("a", "entity"), "entity").groupBy("query_id", F.col("b").alias("entity")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))

    one = hop(starts)
    closed = both.groupBy(F.col("a").alias("entity")).agg(F.sum(F.col("m") * F.col("m")).alias("c"))
    parts = [(starts, 3.0), (one, 1.5), (hop(one), 0.5), (starts.join(closed, "entity").select("query_id", "entity", (-F.col("n") * F.col("c")).alias("n")), 0.5)]
    rows = reduce(DataFrame.unionAll, [d.select("query_id", "entity", (F.col("n") * w).alias("w")) for d, w in parts])
    rows = rows.groupBy("query_id", "entity").agg(F.sum("w").alias("w")).filter("w > 0")
    return rows.join(mentions.withColumnRenamed("node", "entity"), "entity").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))


def confidence(discourse, graph, heading, first_segment, t_source, t_target):
    """Confidence that one concept comes before another: 0 without discourse and graph evidence, else weighted signals, to four digits."""
    strong, weak = F.greatest(discourse, graph), F.least(discourse, graph)
    meaning = F.least(F.lit(1.0), strong + 0.25 * weak)
    prominence = F.least(F.lit(1.0), F.when(heading, 0.7).otherwise(0.0) + F.when(first_segment, 0.3).otherwise(0.0))
    delta = F.abs(t_target - t_source)
    time = F.when(t_source == t_target, 0.5).when(t_source < t_target, 1.0 / (1.0 + delta / 600.0)).otherwise(0.4 / (1.0 + delta / 600.0))
    raw = 0.70 * meaning + 0.15 * prominence + 0.15 * time
    return F.when((discourse == 0) & (graph == 0), 0.0).otherwise(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)) * 10000.0 + 0.5) / 10000.0)


def budgeted_lines(lines: DataFrame, budget: int) -> DataFrame:
    """lines (query_id, pos, line): distinct lines in order, up to the first that goes over the budget (a line costs its length and one)."""
    first = lines.groupBy("query_id", "line").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("used", F.sum(F.length("line") + 1).over(w)).filter(F.col("used") <= budget)
