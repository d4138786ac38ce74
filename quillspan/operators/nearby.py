"""The best chunks of many queries by distance in a graph: queries in blocks, a row for each node or chunk of a block.

A vector holds one whole number for each query of its block, so an edge or a mention moves
one row for all of them; tasks sum the rows of a bounded number of keys, and of chunks pass on only the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.scratch import written

#: Queries of a block on average; rows of a task.
WIDTH, ROWS = 64, 250_000
#: A chunk without an id, which sorts first as null does.
NONE = -(2**63)


class _Sums:
    """Vectors by key of one block, summed from rows (slot, n) or n times a vector."""

    def __init__(self, width: int):
        self.at: dict[int, int] = {}
        self.sums = np.zeros((1024, width), np.int64)

    def add(self, keys: np.ndarray, slot: np.ndarray, n: np.ndarray, vectors: pa.Array) -> None:
        found, inverse = np.unique(keys, return_inverse=True)
        place = np.array([self.at.setdefault(k, len(self.at)) for k in found.tolist()], np.int64)
        if len(self.at) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(self.at)), self.sums.shape[1]), np.int64)])
        single = vectors.is_null().to_numpy(zero_copy_only=False)
        np.add.at(self.sums, (place[inverse[single]], slot[single]), n[single])
        whole = np.flatnonzero(~single)
        if len(whole):
            whole = whole[np.argsort(inverse[whole], kind="stable")]
            own = inverse[whole]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows = _unpacked(vectors.take(pa.array(whole)), self.sums.shape[1]) * n[whole][:, None]
            self.sums[place[own[begin]]] += np.add.reduceat(rows, begin, axis=0)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(self.at, np.int64, len(self.at)), self.sums[: len(self.at)]


def _packed(rows: np.ndarray) -> list[bytes]:
    small = not len(rows) or np.abs(rows).max() < 2**31
    return [r.tobytes() for r in (rows.astype(np.int32) if small else rows)]


def _unpacked(vectors: pa.Array, width: int) -> np.ndarray:
    raw = vectors.to_pylist()
    if len({len(v) for v in raw}) == 1:
        return np.frombuffer(b"".join(raw), np.int32 if len(raw[0]) == 4 * width else np.int64).reshape(-1, width).astype(np.int64)
    return np.stack([np.frombuffer(v, np.int32 if len(v) == 4 * width else np.int64).astype(np.int64) for v in raw])


def _summed(rows: DataFrame, n: int, width: int, give: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What give(block, keys, sums) makes of rows (block, key, slot, n, v), of which there are n in all, dealt to tasks of about ROWS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Sums] = {}
        for batch in batches:
            block, key, slot, times = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "key", "slot", "n"))
            for b in np.unique(block).tolist():
                on = np.flatnonzero(block == b)
                blocks.setdefault(b, _Sums(width)).add(key[on], slot[on], times[on], batch["v"].take(pa.array(on)))
        for b in list(blocks):
            keys, sums = blocks.pop(b).result()
            yield give(b, keys, sums)

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    return rows.select("block", "key", "slot", "n", "v").repartition(parts, "block", "key").mapInArrow(work, schema)


def _single(rows: DataFrame) -> DataFrame:
    return rows.select("block", "key", "slot", "n", F.lit(None).cast("binary").alias("v"))


def _vectors(rows: DataFrame, n: int, width: int) -> DataFrame:
    """block, entity, v."""

    def give(block: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int32)), pa.array(keys), pa.array(_packed(sums), pa.binary())], ["block", "entity", "v"])

    return written(_summed(rows, n, width, give, "block int, entity long, v binary"), "vectors")


def _met(vectors: DataFrame, other: DataFrame, key: str, n) -> tuple[DataFrame, int]:
    """Rows of vectors for each row of other (entity, ...), under `key`, and how many there are."""
    many = other.groupBy("entity").agg(F.count(F.lit(1)).alias("_c"))
    rows = vectors.select("entity").join(many.hint("merge"), "entity").agg(F.sum("_c")).first()[0] or 0
    met = vectors.join(other.hint("merge"), "entity").select("block", F.col(key).alias("key"), F.lit(0).alias("slot"), n.cast("long").alias("n"), "v")
    return met, rows


def best_by_distance(mentions: DataFrame, edges: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best of graph.distance_scores() for each query, ties by chunk_id; ids are whole numbers.

    Weights are doubled, so that sums are whole numbers, exact in any order.
    """
    asked = written(asked.select("query_id", F.col("node").alias("entity")), "asked")
    names = asked.select("query_id").distinct()
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-names.count() // WIDTH)))).cast("int")
    names = names.withColumn("block", block).withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("query_id")) - 1)
    names = written(names, "slots")
    width = (names.agg(F.max("slot")).first()[0] or 0) + 1
    both = edges.select(F.col("src").alias("entity"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("entity"), F.col("src").alias("b")))
    both = written(both.groupBy("entity", "b").agg(F.count(F.lit(1)).alias("m")), "both-ways")
    starts = written(asked.groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n")).join(names, "query_id").select("block", "slot", "entity", "n"), "starts")
    first = starts.join(both.hint("merge"), "entity").select("block", F.col("b").alias("key"), "slot", (F.col("n") * F.col("m")).alias("n"))
    many = both.groupBy("entity").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col("m") * F.col("m")).alias("_back"))
    n_first = starts.join(many.hint("merge"), "entity").agg(F.sum("_c")).first()[0] or 0
    one = _vectors(_single(first), n_first, width)
    # 6 for a start less its ways back, 3 for a neighbour, 1 for each way to a second neighbour
    own = starts.join(many.hint("merge"), "entity", "left").select("block", F.col("entity").alias("key"), "slot", (F.col("n") * (6 - F.coalesce("_back", F.lit(0)))).alias("n"))
    near = one.select("block", F.col("entity").alias("key"), F.lit(0).alias("slot"), F.lit(3).cast("long").alias("n"), "v")
    second, n_second = _met(one, both, "b", F.col("m"))
    weights = _vectors(reduce(DataFrame.unionAll, [_single(own), near, second]), n_second + starts.count() + one.count(), width)
    said = mentions.select(F.col("node").alias("entity"), F.coalesce(F.col("chunk_id").cast("long"), F.lit(NONE)).alias("chunk_id"))
    rows, n_rows = _met(weights, said, "chunk_id", F.lit(1))

    def best(block: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(width):
            own = sums[:, s]
            on = np.flatnonzero(own > 0)
            if len(on) > k:
                least = np.partition(own[on], len(on) - k)[len(on) - k]
                on = on[own[on] >= least]
            on = on[np.lexsort((keys[on], -own[on]))][:k]
            found.append((np.full(len(on), s), on))
        slot, at = (np.concatenate(x) for x in zip(*found, strict=True))
        data = [np.full(len(at), block, np.int32), slot.astype(np.int32), keys[at], sums[at, slot] / 2.0]
        return pa.RecordBatch.from_arrays(list(map(pa.array, data)), ["block", "slot", "chunk_id", "score"])

    top = _summed(rows, n_rows, width, best, "block int, slot int, chunk_id long, score double").join(names, ["block", "slot"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    top = top.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.select("query_id", F.when(F.col("chunk_id") != NONE, F.col("chunk_id")).alias("chunk_id"), "score", "rank")
