"""What several operators join and name by: lookups that a hot key doesn't hold up, numbers without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import cut

#: A key with at least one in so many of all rows is hot; there can't be more hot keys than this.
MOST_HOT = 1024
#: monotonically_increasing_id() is the task's number, shifted by this, plus the row's place in the task.
_TASK_BITS = 33


def attach(rows: DataFrame, found: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows, each with the other columns of the row of `found` that has its keys.

    `found` is a written table with one row for each key of rows, none null, and
    `size`, the number of rows that ask for it.  Hot keys, at most MOST_HOT rows of
    numbers and digests, go to every task; rows that they answered are spread over
    all tasks of the join that answers the others.
    """
    more = [c for c in found.columns if c not in keys]
    total = found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = found.filter(F.col(size) >= max(2, -(-total // MOST_HOT))).select(*keys, F.struct(*more).alias("_hot"))
    cold = found.select(*keys, F.struct(*more).alias("_cold"), F.lit(-1).cast("long").alias("_spread"))
    d = rows.join(F.broadcast(hot), keys, "left")
    d = d.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(65_536))))
    # the same join at every size
    d = d.join(cold.hint("merge"), [*keys, "_spread"], "left")
    return d.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in more])


def numbered(df: DataFrame, column: str, label: str) -> DataFrame:
    """df as a written table with a column of numbers 0, 1, 2 ... in the order of its tasks and their rows.

    The tasks' numbers of rows, one for each task, are all that goes to the driver.
    """
    table = cut(df.withColumn("_place", F.monotonically_increasing_id()), label)
    task = F.shiftright("_place", _TASK_BITS)
    sizes = sorted((r[0], r[1]) for r in table.groupBy(task.alias("_task")).count().collect())
    ends, before = [], 0
    for number, rows in sizes:
        ends.append((number, before))
        before += rows
    offsets = df.sparkSession.createDataFrame(ends, "_task long, _before long")
    local = F.col("_place").bitwiseAND((1 << _TASK_BITS) - 1)
    return table.withColumn("_task", task).join(F.broadcast(offsets), "_task").withColumn(column, F.col("_before") + local).drop("_task", "_before", "_place")


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
