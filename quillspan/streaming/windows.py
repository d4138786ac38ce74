"""Event-time windows that run alike over tables and streams (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """start, end, by, n, total per window; a stream needs `late`, how long a window waits for late events."""
    e = events.withWatermark(at, late) if late else events
    g = e.groupBy(F.window(at, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Windows that end after a pause of `gap`."""
    e = events.withWatermark(at, late) if late else events
    g = e.groupBy(F.session_window(at, gap).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n", "total")
