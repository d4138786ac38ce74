"""Connected components by contraction: forests inside tasks, DataFrame joins between them.

Every task first replaces its own edges by a spanning forest (numpy union-find, at
most `FLUSH` edges in memory).  Then rounds of contraction: each node moves to the
least node of its neighbourhood, itself included - least by id and by a new random
hash in turn, so that stars vanish at once and chains shrink by a constant factor -
and edges are drawn between where their ends went.  Once at most `FEW` edges are
left, a bounded number, one task finishes.  Nothing is collected; every round starts
from tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import cut

FLUSH, FEW = 1_000_000, 16_384


def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges (a, b), ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        on = x != y
        if not on.any():
            return nodes, nodes[root]
        x, y = x[on], y[on]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root == (up := root[root])).all():
            root = up


def _forests(edges: DataFrame, flush: int, whole: bool = False) -> DataFrame:
    """a, b: each task's edges as stars around the least nodes; whole: also the stars' own nodes."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def packed(out: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            on = np.ones(len(out[0]), bool) if whole else out[0] != out[1]
            return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in out], ["a", "b"])

        for batch in batches:
            parts.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            waiting += batch.num_rows
            if waiting >= flush and not whole:
                out = trees(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield packed(out)
                parts, waiting = [], 0
        if waiting:
            yield packed(trees(*(np.concatenate(x) for x in zip(*parts, strict=True))))

    return edges.mapInArrow(forest, "a long, b long")


def connected_components(edges: DataFrame, few: int = FEW, flush: int = FLUSH) -> DataFrame:
    """edges (a long, b long) -> node, component: the least node that is connected with it.

    Nodes without an edge to another node don't appear.  Repeated edges, loops and
    edges with a null end are harmless.
    """
    e = cut(_forests(edges.select("a", "b").filter("a <> b"), flush), "edges")
    maps: list[DataFrame] = []
    while e.count() > few:
        turn = len(maps)
        rank = (lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c).alias("id"))) if turn % 2 else (lambda c: F.struct(F.col(c).alias("id")))  # noqa: E731, B023
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = cut(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("root")), "roots")
        ends = e.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        ends = ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        maps.append(to)
        e = cut(_forests(ends, flush), "edges")
    last = cut(_forests(e.coalesce(1), flush, whole=True), "last-components").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not maps:
        return last.withColumnRenamed("root", "component")
    found = maps[0]
    for more in [*maps[1:], last]:
        found = found.join(more.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return cut(found.join(least, "root").select("node", "component"), "components")
