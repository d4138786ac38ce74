"""Numbers without gaps inside groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.scratch import written

#: monotonically_increasing_id() is the task's number, shifted by this, plus the row's place in the task.
_TASK_BITS = 33


def numbered(df: DataFrame, group: list[str], order: list[str], column: str = "nth") -> DataFrame:
    """df with a column 1, 2 ... of each group's rows in order of `order`, nulls first.

    Rows are sorted once, in ranges of (group, order), so a group may span many tasks: a
    task's rows of a group start where the tasks before it ended.  Only one row for
    each group and task is summed up; groups needn't fit into a task.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges").withColumn("_task", F.shiftright("_place", _TASK_BITS))
    parts = rows.groupBy(*group, "_task").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    renamed = parts.withColumnsRenamed({c: f"_of_{c}" for c in [*group, "_task"]})
    same = F.lit(True)
    for c in [*group, "_task"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(renamed, same).select(*df.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(column))
