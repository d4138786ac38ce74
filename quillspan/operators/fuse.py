"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(legs: list[DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf, score, n_legs, rank from legs of query_id, chunk_id, rank, score.

    The score is the first leg's that has the row.  Order: fused score, then score,
    then first leg and rank there.
    """
    rows = reduce(DataFrame.unionByName, [leg.select("query_id", "chunk_id", "rank", "score").withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)])
    first = F.min(F.struct("leg", "rank", "score"))
    f = rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), first.alias("_f"), F.count(F.lit(1)).alias("n_legs"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.round("_f.score", 9).desc(), "_f.leg", "_f.rank")
    f = f.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "rrf", F.col("_f.score").alias("score"), "n_legs", "rank")
    return f if k is None else f.filter(F.col("rank") <= k)


def best_of_each(rows: DataFrame, key: list[str], score: str = "score", arrival: str = "arrival") -> DataFrame:
    """One row per key: the best score, on ties the first to arrive."""
    w = Window.partitionBy(*key).orderBy(F.round(score, 9).desc(), arrival)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
