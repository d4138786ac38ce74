"""Exact dense retrieval under a tenant filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators import blocks
from quillspan.operators.lexical import top_k

SLACK = 15


def require_tenant(lecture_id: str | None) -> str:
    """Retrieval without a tenant is refused."""
    if lecture_id is None or not str(lecture_id).strip():
        raise ValueError("retrieval needs a lecture_id")
    return lecture_id


def within_tenant(docs: DataFrame, lecture_id: str | None) -> DataFrame:
    return docs.filter(F.col("lecture_id") == F.lit(require_tenant(lecture_id)))


def _whole(t: pa.Table) -> np.ndarray:
    """The length of each vector; -1 if it is null or an entry is."""
    v = t["embedding"].combine_chunks()
    n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if v.flatten().null_count:
        n[pc.list_parent_indices(v).filter(v.flatten().is_null()).to_numpy()] = -1
    return n


def _vectors(t: pa.Table, at: np.ndarray, n: int) -> np.ndarray:
    return t["embedding"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)


def products(docs: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Dot products in double precision of all vectors of two blocks; null if a vector or an entry is, or lengths differ."""
    d, q = _whole(docs), _whole(queries)
    scores, state = np.zeros((len(q), len(d))), np.full((len(q), len(d)), blocks.NULL, np.int8)
    for n in np.intersect1d(d, q).tolist():
        i, j = np.flatnonzero(q == n), np.flatnonzero(d == n)
        if n >= 0:
            with np.errstate(invalid="ignore", over="ignore"):
                scores[np.ix_(i, j)] = _vectors(queries, i, n) @ _vectors(docs, j, n).T
            state[np.ix_(i, j)] = blocks.SCORED
    return scores, state


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, filler: Column, slack: int = SLACK) -> DataFrame:
    """The k best that aren't filler among the k + slack best: a filler costs a place of the slack."""
    found = blocks.best_pairs(docs.select("lecture_id", "chunk_id", "embedding"), queries.select("lecture_id", "query_id", "embedding"), products, k + slack)
    best = top_k(found, k + slack).drop("rank")
    kept = best.join(docs.select("lecture_id", "chunk_id", filler.alias("_filler")), ["lecture_id", "chunk_id"]).filter(~F.col("_filler"))
    return top_k(kept, k).drop("_filler")
