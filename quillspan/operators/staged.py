"""Seeds of graph queries in stages, and the prerequisites of what a query asks about.

A stage runs only for the queries that the one before left without a result (anti-joins,
not a loop over queries).  Everything stays within a query's lecture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import extraction, fuzzy, graph
from quillspan.operators.containment import contained
from quillspan.operators.spread import spread
from quillspan.sources.scratch import written

EXACT, PARTIAL, FUZZY = 1, 2, 3
LEAST_CONFIDENCE, NO_CONFIDENCE, TARGETS = 0.65, 0.8, 2


def mentions(queries: DataFrame) -> DataFrame:
    """lecture_id, query_id, nth, mention: what queries (lecture_id, query_id, query) mention; without a lecture nothing."""
    q = queries.filter("lecture_id is not null and lecture_id <> ''")
    return q.select("lecture_id", "query_id", F.posexplode(extraction.query_entities(F.coalesce("query", F.lit("")))).alias("nth", "mention"))


def _met(asked: DataFrame, entities: DataFrame, key: list[str]) -> DataFrame:
    """query_id, lecture_id, node: distinct rows of asked (query_id, key) and entities (node, key), dealt to tasks by how many there are."""
    many = lambda d, c: d.groupBy(*key).agg(F.count(F.lit(1)).alias(c))
    rows = many(asked, "_a").join(many(entities, "_b"), key).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    met = asked.join(entities, key).select("query_id", "lecture_id", "node")
    return spread(met, rows, "query_id", "node").distinct()


def seeds(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, lecture_id, node, stage: entities (lecture_id, node, name) that a mention equals (EXACT); if there is none, whose names contain one (PARTIAL); if there
    is none, those of the three best fuzzy names (FUZZY).  Case doesn't count.  A query without a mention has no seed.
    """
    said = mentions(queries).select("lecture_id", "query_id", F.lower("mention").alias("term")).distinct()
    e = entities.select("lecture_id", "node", "name", F.lower("name").alias("low")).filter("name is not null")
    exact = written(_met(said, e.withColumnRenamed("low", "term"), ["lecture_id", "term"]), "exact-seeds")
    said = said.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    names = e.select("lecture_id", F.col("low").alias("text_id"), F.col("low").alias("text")).distinct()
    inside = contained(names, said.select("lecture_id", F.col("term").alias("name")), ["lecture_id"]).select("lecture_id", F.col("name").alias("term"), F.col("text_id").alias("low"))
    # what a term is inside of doesn't rest on who asks
    held = written(inside.join(e, ["lecture_id", "low"]).select("lecture_id", "term", "node").distinct(), "held")
    partial = written(_met(said, held, ["lecture_id", "term"]), "partial-seeds")
    rest = queries.join(said.select("query_id").distinct(), "query_id", "left_semi").join(partial.select("query_id").distinct(), "query_id", "left_anti")
    distinct = e.select("lecture_id", "name").distinct().withColumn("node", F.lit(0))
    best = fuzzy.best_names(rest, distinct, 3, fuzzy.PHRASE, ["lecture_id"]).select("query_id", F.lower("name").alias("low")).distinct()
    found = _met(written(best.join(rest.select("query_id", "lecture_id"), "query_id"), "best-names"), e, ["lecture_id", "low"])
    stage = lambda d, n: d.withColumn("stage", F.lit(n))
    return stage(exact, EXACT).union(stage(partial, PARTIAL)).union(stage(found, FUZZY))


def traversed(found: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, node, direction, hops, trails from seeds (query_id, node): what is reached within three hops either way; a query whose seeds lead nowhere has one row without a node."""
    found, edges = written(found.select("query_id", "node").distinct(), "seeds"), written(edges.select("src", "dst"), "edges").hint("merge")  # a small file of many rows
    out = graph.trail_counts(found, edges).withColumn("direction", F.lit("out"))
    back = graph.trail_counts(found, edges, backward=True).withColumn("direction", F.lit("in"))
    rows = out.union(back).groupBy("query_id", "node", "direction").agg(F.min("hops").alias("hops"), F.sum("n").alias("trails"))
    none = found.select("query_id").distinct().join(rows.select("query_id").distinct(), "query_id", "left_anti")
    return rows.unionByName(none.select("query_id", F.lit("out").alias("direction"), F.lit(0).alias("hops")), allowMissingColumns=True)


def variants(name: Column) -> Column:
    """A name in lower case and the singular forms of its last word."""
    low = F.lower(F.trim(name))
    last = F.substring_index(low, " ", -1)
    off = lambda k: F.substring(low, F.lit(1), F.length(low) - k)
    forms = [
        low,
        F.when(last.endswith("ies") & (F.length(last) > 4), F.concat(off(3), F.lit("y"))),
        F.when(last.endswith("es") & (F.length(last) > 3), off(2)),
        F.when(last.endswith("s") & ~last.endswith("ss") & (F.length(last) > 2), off(1)),
    ]
    return F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull()))


def _backward(targets: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of prerequisites for targets (lecture_id, concept, node): every path at its concept's least depth, of paths with equal names one."""
    step = edges.filter(F.col("confidence").isNull() | (F.col("confidence") >= LEAST_CONFIDENCE))
    name = entities.select("node", "name")
    asked = targets.select(F.struct("lecture_id", "concept").alias("query_id"), "node")
    p = written(graph.least_depth(graph.simple_paths_back(asked, step)), "paths-back")
    first = step.select(F.col("src").alias("node"), F.col("dst").alias("_next"), "confidence", "timestamp", "chunk_id")
    p = p.withColumn("_next", F.element_at("path", -2)).join(first, ["node", "_next"])
    # paths are read from the prerequisite on; they have four nodes at most
    steps = p.select("query_id", F.struct("start", "path").alias("_id"), F.posexplode("path").alias("_i", "node")).join(name, "node")
    named = steps.groupBy("query_id", "_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_i")).alias("i"), "name"))), lambda s: s["name"]).alias("names"))
    p = p.withColumn("_id", F.struct("start", "path")).join(named, ["query_id", "_id"])
    order = Window.partitionBy("query_id", "names").orderBy(F.asc_nulls_last("timestamp"), "path")
    p = p.withColumn("_r", F.row_number().over(order)).filter("_r = 1").filter(F.lower(F.element_at("names", 1)) != F.lower(F.element_at("names", -1)))
    shown = [F.element_at("names", 1).alias("prerequisite"), F.element_at("names", 2).alias("parent"), F.element_at("names", -1).alias("target")]
    return p.select("query_id.lecture_id", "query_id.concept", *shown, "depth", "timestamp", "chunk_id", F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(NO_CONFIDENCE)).alias("confidence"), "names")


def prerequisites(targets: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """lecture_id, concept, prerequisite, parent, target, depth, timestamp, chunk_id, confidence, names for distinct targets (lecture_id, concept).

    Entities whose name is a concept's, or its singular, are looked at; only where that gives no
    row, those whose name contains it.  edges (src, dst, confidence, timestamp, chunk_id): confident ones count, and
    those that don't say.  Each concept is found at its least depth, at most three, on every path of that length.
    """
    edges = written(edges, "edges")
    e = entities.select("lecture_id", "node", F.lower("name").alias("_low"))
    t = written(targets.select("lecture_id", "concept").distinct(), "targets")
    exact = t.withColumn("_low", F.explode(variants(F.col("concept")))).join(e, ["lecture_id", "_low"]).select("lecture_id", "concept", "node").distinct()
    one = written(_backward(exact, edges, entities), "prerequisites")
    rest = t.join(one.select("lecture_id", "concept").distinct(), ["lecture_id", "concept"], "left_anti").withColumn("name", F.lower(F.trim("concept")))
    texts = e.select("lecture_id", F.col("_low").alias("text_id"), F.col("_low").alias("text")).distinct()
    inside = contained(texts, rest, ["lecture_id"]).withColumnRenamed("text_id", "_low")
    other = rest.join(inside, ["lecture_id", "name"]).join(e, ["lecture_id", "_low"]).select("lecture_id", "concept", "node").distinct()
    return one.union(_backward(other, edges, entities))


def query_prerequisites(queries: DataFrame, found: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, place, prerequisite, parent, target, depth, timestamp, chunk_id, confidence: what comes before the first two concepts of each query.

    Concepts: the names of the seeds found (query_id, node), by name, then mentions.  Of rows with one prerequisite and
    parent the first stays; in order of concepts, then the deepest first, then by time, missing last.
    """
    names = found.join(entities.select("node", "name"), "node").select("query_id", F.lit(0).alias("_leg"), F.col("name").alias("_by"), F.col("name").alias("concept"))
    said = mentions(queries).select("query_id", F.lit(1).alias("_leg"), F.lpad(F.col("nth").cast("string"), 9, "0").alias("_by"), F.col("mention").alias("concept"))
    c = names.union(said).groupBy("query_id", "concept").agg(F.min(F.struct("_leg", "_by")).alias("_at"))
    c = c.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "concept"))).filter(F.col("_nth") <= TARGETS)
    c = written(c.join(queries.select("query_id", "lecture_id"), "query_id"), "concepts")
    rows = c.join(prerequisites(c, entities, edges), ["lecture_id", "concept"])
    order = ["_nth", F.desc("depth"), F.asc_nulls_last("timestamp"), "names"]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "prerequisite", "parent").orderBy(*order))).filter("_r = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.select("query_id", place.alias("place"), "prerequisite", "parent", "target", "depth", "timestamp", "chunk_id", "confidence")
