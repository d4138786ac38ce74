"""The best rows of every query within its lecture: all pairs, in blocks of documents by blocks of queries.

Every query meets every document of its lecture, as exact search does; a task holds
the scores of one block of each at a time and passes on its k best rows a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block on average; a task's scores are their product.
DOCS, QUERIES = 2048, 4096
#: What a pair has: it isn't found, its score is null, it has a score.
MISSED, NULL, SCORED = 0, 1, 2


def _sizes(df: DataFrame, column: str, block: int) -> DataFrame:
    """lecture_id, column: into how many blocks the rows of a lecture go."""
    return df.groupBy("lecture_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(column))


def best_of(scores: np.ndarray, state: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest scores of each row, to nine digits, equal ones by least id; NaN counts as greatest, as in Spark, and null comes last."""
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = np.finfo(np.float64).min
    for at in range(0, len(scores), 256):
        s, found = scores[at : at + 256], state[at : at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.where(np.abs(s) < 1e6, np.round(s, 9), s)
        s = np.where(np.isnan(s), np.inf, np.maximum(s, low / 2))
        s = np.where(found == SCORED, s, np.where(found == NULL, low, -np.inf))
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        order = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[place < k] + at)
        columns.append(c[place < k])
    return np.concatenate(rows), np.concatenate(columns)


def best_pairs(docs: DataFrame, queries: DataFrame, score: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, lecture_id, chunk_id, score: at least the k best documents of each query, from docs (lecture_id, chunk_id, ...) and queries (lecture_id, query_id, ...).

    score(docs, queries) gives two matrices, a row for each query of the block: scores, and what each pair has.
    What is shuffled is each side once for every block of the other.
    """
    sizes = _sizes(docs, "_nd", DOCS).join(_sizes(queries, "_nq", QUERIES), "lecture_id")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = docs.join(sizes, "lecture_id").withColumns({"_d": own("chunk_id", "_nd"), "_q": every("_nq")}).drop("_nd", "_nq")
    q = queries.join(sizes, "lecture_id").withColumns({"_q": own("query_id", "_nq"), "_d": every("_nd")}).drop("_nd", "_nq")
    kind = docs.schema["lecture_id"].dataType.simpleString()
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, lecture_id {kind}, chunk_id {docs.schema['chunk_id'].dataType.simpleString()}, score double"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "lecture_id", "chunk_id", "score"]
        if not left.num_rows or not right.num_rows:
            none = [right["query_id"][:0], left["lecture_id"][:0], left["chunk_id"][:0], pa.array([], pa.float64())]
            return pa.table(none, names)
        s, state = score(left, right)
        r, c = best_of(s, state, left["chunk_id"].to_numpy(), k)
        found = pa.array(s[r, c], mask=state[r, c] == NULL)
        return pa.table([right["query_id"].take(pa.array(r)), left["lecture_id"].take(pa.array(c)), left["chunk_id"].take(pa.array(c)), found], names)

    key = ["lecture_id", "_d", "_q"]
    q = q.select(*[F.col(c).alias(c) for c in q.columns])  # documents may be queries of their own
    return d.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(search, types)
