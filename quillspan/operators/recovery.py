"""Whether graph results hold what a question's gold says: paths found, false paths, rates by hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import graph


def path_rows(seeds: DataFrame, edges: DataFrame, names: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """query_id, start_name, related_name, rel_types: a row for every trail of at most three hops, out and in, from seeds (query_id, node).

    edges (src, dst, edge_id, relation), names (node, name).  With wanted (query_id, low, high: two lower-cased names in
    order), distinct rows that join these ends, either way round: trails begin only at seeds with such a name.
    """
    named = lambda c, to: names.select(F.col("node").alias(c), F.col("name").alias(to)).hint("merge")
    s = seeds.select("query_id", "node")
    if wanted is not None:
        wanted = wanted.select("query_id", F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        ends = wanted.select("query_id", F.explode(F.array("_low", "_high")).alias("_name")).distinct()
        begin = s.join(named("node", "_n"), "node").withColumn("_name", F.lower(F.coalesce("_n", F.lit(""))))
        s = begin.join(ends.hint("merge"), ["query_id", "_name"], "left_semi").select("query_id", "node")
    walked = [graph.trails(s, edges, backward=back, along="relation") for back in (False, True)]
    t = walked[0].union(walked[1]).withColumn("rel_types", F.sort_array(F.array_distinct(F.filter("along", lambda r: r.isNotNull()))))
    t = t.join(named("start", "start_name"), "start").join(named("node", "related_name"), "node").select("query_id", "start_name", "related_name", "rel_types")
    if wanted is None:
        return t
    on = ["query_id", "_low", "_high"]
    return _pairs(t.distinct(), "start_name", "related_name").join(wanted.hint("merge"), on, "left_semi").select("query_id", "start_name", "related_name", "rel_types")


def wanted_pairs(gold: DataFrame, subjects: DataFrame) -> DataFrame:
    """query_id, low, high: the ends that recovered_paths() looks for, and those that false_paths() does."""
    g = _pairs(gold, "source", "target").select("query_id", "_low", "_high")
    s = subjects.select("query_id", F.lower("name").alias("_a")).distinct()
    both = s.join(s.withColumnRenamed("_a", "_b"), "query_id").filter("_a < _b").select("query_id", "_a", "_b")
    return g.union(both).toDF("query_id", "low", "high").distinct()


def rows_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, start_name, related_name, rel_types of path_rows under `once`, for each of wanted (query_id, once, low, high) that looks for such ends."""
    w = wanted.select("query_id", "once", F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
    return _pairs(rows, "start_name", "related_name").join(w, ["once", "_low", "_high"]).select("query_id", "start_name", "related_name", "rel_types")


def _pairs(d: DataFrame, a: str, b: str) -> DataFrame:
    """d with the lower-cased ends in order, whatever their direction."""
    x, y = F.lower(F.coalesce(F.col(a), F.lit(""))), F.lower(F.coalesce(F.col(b), F.lit("")))
    return d.withColumns({"_low": F.least(x, y), "_high": F.greatest(x, y)})


def recovered_paths(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, gold, found, recovered for the questions of gold (query_id, source, relation, target): whether all of its edges are among its rows.

    An edge is found by a row with its ends, either way round, one of whose types holds its relation; case doesn't count.
    This is a division: found edges are counted against all.
    """
    g = _pairs(gold.select("query_id", "source", "relation", "target").distinct(), "source", "target").withColumn("_rel", F.lower("relation"))
    r = _pairs(rows, "start_name", "related_name").select("query_id", "_low", "_high", F.explode("rel_types").alias("_type")).distinct()
    hit = g.join(r, ["query_id", "_low", "_high"]).filter(F.contains(F.lower("_type"), F.col("_rel"))).select("query_id", "source", "relation", "target").distinct().withColumn("_hit", F.lit(1))
    n = g.join(hit, ["query_id", "source", "relation", "target"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("found"))
    return n.withColumn("recovered", F.col("gold") == F.col("found"))


def false_paths(subjects: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, false_path for the questions of subjects (query_id, name) that have no answer: whether a row joins two different ones."""
    s = subjects.select("query_id", F.lower("name").alias("_name")).distinct()
    r = rows.select("query_id", F.lower("start_name").alias("a"), F.lower("related_name").alias("b")).filter("a <> b").distinct()
    both = r.join(s.withColumnRenamed("_name", "a"), ["query_id", "a"], "left_semi").join(s.withColumnRenamed("_name", "b"), ["query_id", "b"], "left_semi")
    return s.select("query_id").distinct().join(both.select("query_id").distinct().withColumn("_hit", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("_hit", F.lit(False)).alias("false_path"))


def hop_rates(questions: DataFrame, recovered: DataFrame, false: DataFrame) -> DataFrame:
    """hop, total, hits, rate of questions (query_id, hop; null without an answer): recovered paths by hops, hop 0 for all of them; under null, false paths of unanswerable ones.

    A question without gold edges isn't recovered.
    """
    q = questions.join(recovered.select("query_id", "recovered"), "query_id", "left").join(false.select("query_id", "false_path"), "query_id", "left")
    hit = F.coalesce(F.when(F.col("hop").isNull(), F.col("false_path")).otherwise(F.col("recovered")), F.lit(False)).cast("long")
    rows = q.select(F.explode(F.when(F.col("hop").isNull(), F.array(F.col("hop"))).otherwise(F.array(F.col("hop"), F.lit(0)))).alias("hop"), hit.alias("_hit"))
    return rows.groupBy("hop").agg(F.count(F.lit(1)).alias("total"), F.sum("_hit").alias("hits"), F.round(F.avg("_hit"), 4).alias("rate"))
