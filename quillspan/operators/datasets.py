"""Validation, repair, de-duplication and splits of data sets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillspan.sources.scratch import written


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(row_key, rule_id) for each rule that a row breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule_id"))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(row_key, rule_id) of the rows whose key has no parent."""
    p = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.join(p, key, "left_anti").select(F.col(key).cast("string").alias("row_key"), F.lit(rule).alias("rule_id"))


def keep_first(rows: DataFrame, key: Column | list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, Column) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hash_order(seed: str, *key: Column) -> Column:
    """A repeatable random order: the md5 of a seed and a key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key]).cast("binary"))


def running(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """rows with place, the sum of value over the rows before in an order of all rows, and places, the sum over all.

    Rows are dealt out by ranges of the order; only one sum per range goes to the
    driver, so no task sorts the whole table.
    """
    d = rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    d = written(d, "ranges")
    sums = sorted((r[0], r[1]) for r in d.groupBy("_range").agg(F.sum("_v")).collect())
    starts = [sum(s for _, s in sums[:k]) for k in range(len(sums))]
    at = rows.sparkSession.createDataFrame([(r, s) for (r, _), s in zip(sums, starts, strict=True)], "_range int, _before long")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(F.broadcast(at), "_range").withColumn("place", F.col("_before") + F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return d.withColumn("places", F.lit(sum(s for _, s in sums)).cast("long")).drop("_v", "_range", "_before")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """rows with place, from 0, in the order of a key, and places, their number."""
    return running(rows, [F.col(key)], F.lit(1).cast("long"))


def group_split(rows: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """group, n, split: whole groups go to dev, in hash order, until it has `share` of all rows; a single group stays in train."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_h", hash_order(seed, F.col(group)))
    g = running(g, [F.col("_h"), F.col(group)], F.col("n"))
    # a group that has all rows is a single one
    dev = (F.col("place") < F.col("places") * share) & (F.col("n") < F.col("places"))
    return g.select(group, "n", F.when(dev, "dev").otherwise("train").alias("split"))


def balanced(rows: DataFrame, stratum: str, quota: int, seed: str, key: str) -> DataFrame:
    """`quota` rows of each stratum in hash order, none twice."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= quota).drop("_n")


def repaired_json(raw: str | None) -> tuple[list[str], str]:
    """Objects of the first array in a model's output, as compact JSON, and ok, repaired, partial or failed.

    Code fences go; the first balanced array is read strictly; then with stray
    backslashes doubled; then the whole objects of a broken array are saved.
    """
    text = re.sub(r"```[a-zA-Z]*", "", raw or "").strip()
    start = text.find("[")
    if start < 0:
        return [], "failed"

    def close(at: int, opener: str, closer: str) -> int | None:
        depth, quoted, escaped = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if escaped:
                escaped = False
            elif quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c == opener:
                depth += 1
            elif c == closer:
                depth -= 1
                if not depth:
                    return i
        return None

    def read(part: str) -> list | None:
        try:
            found = json.loads(part)
        except ValueError:
            return None
        return found if isinstance(found, list) else None

    packed = lambda items: [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in items]
    end = close(start, "[", "]")
    if end is not None:
        part = text[start : end + 1]
        if (found := read(part)) is not None:
            return packed(found), "ok"
        if (found := read(re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", part))) is not None:
            return packed(found), "repaired"
    saved, at = [], start
    while (at := text.find("{", at)) >= 0:
        end = close(at, "{", "}")
        if end is None:
            break
        if (one := read("[" + text[at : end + 1] + "]")) is not None:
            saved += one
        at = end + 1
    return packed(saved), "partial" if saved else "failed"


_REPAIRED = StructType([StructField("items", ArrayType(StringType())), StructField("status", StringType())])


@pandas_udf(_REPAIRED)
def json_repair(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repaired_json(x) for x in raw], columns=["items", "status"])
