"""Packages without what an audit rejects: issues of entities, cascaded deletes, aliases made ids again, counts on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions import text as X
from quillspan.operators.numbering import numbered
from quillspan.sources.scratch import written

MOST_WORDS, MOST_CHARACTERS = 6, 45


def is_clause(name: Column) -> Column:
    """A part of a sentence, by how it begins, what it holds, or a sentence end inside."""
    out = F.lit(False)
    for p in fixed.CLAUSE_PATTERNS:
        out = out | F.trim(name).rlike(p)
    return out


def is_long(name: Column) -> Column:
    t = F.trim(name)
    return (F.size(F.filter(F.split(t, "\\s+"), lambda w: w != "")) > MOST_WORDS) | (F.length(t) > MOST_CHARACTERS)


def entity_issues(entities: DataFrame, relations: DataFrame, within: list[str]) -> DataFrame:
    """within, entity_id, issue: what is wrong with each entity (within, entity_id, name), given its relations (within, src, dst).

    FRAGMENT, else EXCESSIVE_LENGTH; GENERIC_STOPWORD; ORPHAN without a relation; DUPLICATE of another's name.
    """
    ends = relations.select(*within, F.col("src").alias("entity_id")).union(relations.select(*within, F.col("dst").alias("entity_id"))).distinct()
    e = entities.select(*within, "entity_id", F.coalesce("name", F.lit("")).alias("name")).join(ends.withColumn("_related", F.lit(True)), [*within, "entity_id"], "left")
    e = e.withColumn("_norm", X.cluster_name(F.col("name")))
    # names are counted before they meet, so a frequent one is no large group
    twice = e.groupBy(*within, "_norm").agg(F.count(F.lit(1)).alias("_same")).filter("_same > 1")
    e = e.join(twice, [*within, "_norm"], "left")
    found = F.array(
        F.when(is_clause(F.col("name")), "FRAGMENT").when(is_long(F.col("name")), "EXCESSIVE_LENGTH"),
        F.when(F.col("_norm").isin(fixed.GENERIC_NAMES), "GENERIC_STOPWORD"),
        F.when(F.col("_related").isNull(), "ORPHAN"),
        F.when(F.col("_same").isNotNull(), "DUPLICATE"),
    )
    return e.select(*within, "entity_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def cleaned(entities: DataFrame, relations: DataFrame, within: list[str], order: list[str], drop_tiers: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) less what the audit rejects; relations get ids rel_000001 ... in each package again, in order of `order`.

    An entity (within, entity_id, name) goes if its name is a clause, a fragment or too long.  A relation (within, src, dst, tier) goes
    if its evidence is of a tier to drop (0 and 1), or if one of its ends went or never was.
    """
    tiers = [0, 1] if drop_tiers is None else drop_tiers
    name = F.coalesce("name", F.lit(""))
    kept = entities.filter(~(is_clause(name) | is_long(name) | X.is_fragment(name)))
    ids = kept.select(*within, "entity_id").distinct()
    ends = lambda d, c: d.join(ids.withColumnRenamed("entity_id", c), [*within, c], "left_semi")
    left = ends(ends(relations.filter(~F.col("tier").isin(tiers)), "src"), "dst")
    # ranges are found by a look at all rows, so what leads to them is done before
    rows = numbered(written(left.select(*relations.columns), "left"), within, order, "_nth")
    return kept, rows.select("*", F.format_string("rel_%06d", "_nth").alias("relation_id")).drop("_nth")


def remapped(relations: DataFrame, aliases: DataFrame, known: DataFrame, within: list[str]) -> tuple[DataFrame, Observation]:
    """(relations with src and dst as ids, an observation of `mapped` and `dropped` rows).

    An end is an alias (within, alias, entity_id) or an id already: one that an alias stands for, or a known one
    (within, entity_id).  Relations with any other end are dropped.  The counts are gathered by the pass that reads the rows
    of the first action; a task that runs again doesn't count twice.
    """
    ids = aliases.select(*within, "entity_id").union(known.select(*within, "entity_id")).filter("entity_id <> ''").distinct()
    d = relations
    for c in ("src", "dst"):
        named = aliases.filter("entity_id <> ''").select(*within, F.col("alias").alias(c), F.col("entity_id").alias(f"_{c}_alias"))
        own = ids.select(*within, F.col("entity_id").alias(c), F.col("entity_id").alias(f"_{c}_own"))
        d = d.join(named, [*within, c], "left").join(own, [*within, c], "left").withColumn(f"_{c}", F.coalesce(f"_{c}_alias", f"_{c}_own")).drop(f"_{c}_alias", f"_{c}_own")
    whole = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    counts = Observation()
    d = d.observe(counts, F.sum(whole.cast("long")).alias("mapped"), F.sum((~whole).cast("long")).alias("dropped"))
    out = [F.col("_src").alias("src") if c == "src" else F.col("_dst").alias("dst") if c == "dst" else F.col(c) for c in relations.columns]
    return d.filter(whole).select(*out), counts


def extraction_counts(responses: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """One row for each stage `by`: what became of responses (by, status) and of items (by, name, raw type, outcome columns accepted, normalized, duplicate, fragment).

    requests; valid, repaired (partial ones too) and failed parses; items accepted, of these with a type made normal, rejected, duplicates and fragments; rates of parses to four digits.
    """
    r = responses.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum((F.col("status") == "ok").cast("long")).alias("valid"),
        F.sum(F.col("status").isin("repaired", "partial").cast("long")).alias("repaired"),
        F.sum((~F.coalesce(F.col("status").isin("ok", "repaired", "partial"), F.lit(False))).cast("long")).alias("failed"),
    )
    names = ["accepted", "normalized", "rejected", "duplicates", "fragments"]
    i = items.groupBy(by).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in names])
    rate = lambda c: F.round(F.when(F.col("requests") > 0, F.col(c) / F.col("requests")).otherwise(0.0), 4)
    return r.join(i, by, "left").select(by, "requests", "valid", "repaired", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], rate("valid").alias("parse_ok"), rate("repaired").alias("parse_repaired"))


def first_of_each(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """items with `duplicate`: whether an item of equal keys comes before it."""
    return items.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)
