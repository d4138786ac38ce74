"""Rows dealt to as many tasks as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task.  Adaptive execution joins partitions by their compressed size and by cores, so a task would grow with the tables.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in tasks of about ROWS rows, of which there are `rows` in all; a given number of partitions isn't joined again."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)
