"""Prerequisites inferred from cues, mentions, order of time and known relations."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspan.functions import fixed
from quillspan.operators.graph import acyclic, confidence
from quillspan.operators.spread import ROWS, spread
from quillspan.sources.scratch import written

#: Pairs in a chunk that one task looks for cues in.
CUES = 20_000


def cue_text(text: Column) -> Column:
    """Lower case on one line, with word characters and plain punctuation only."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n\t]+", " ")
    t = F.regexp_replace(t, "(?U)[^\\w\\s\\.,;:!\\?\\-']", " ")
    return F.lower(F.trim(F.regexp_replace(t, "(?U)\\s+", " ")))


def _inflected(token: Column) -> Column:
    """A pattern for a token in singular and plural."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when((n > 3) & token.endswith("ies"), F.concat(cut(3), F.lit("(?:y|ies)")))
        .when((n > 3) & token.endswith("es"), F.concat(cut(2), F.lit("(?:es|s)?")))
        .when((n > 2) & token.endswith("s") & ~token.endswith("ss"), F.concat(cut(1), F.lit("(?:s|es)?")))
        .otherwise(F.concat(token, F.lit("(?:s|es)?")))
    )


def term_pattern(name: Column) -> Column:
    """A pattern for a name's ASCII words in singular or plural, with blanks, hyphens or `and` between them; a generic last word of three or more may be left out; null for a name without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    parts, gap = F.transform(words, _inflected), "(?:[\\s\\-]+(?:and\\s+)?)"
    generic = (F.size(words) >= 3) & F.element_at(words, F.greatest(F.size(words), F.lit(1))).isin(fixed.GENERIC_HEAD_NOUNS)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), gap)
    loose = F.concat(F.lit("(?:"), head, F.lit(f"(?:{gap}"), F.element_at(parts, -1), F.lit(")?)"))
    return F.when(F.size(words) == 0, F.lit(None).cast("string")).when(generic, loose).otherwise(F.array_join(parts, gap))


@lru_cache(maxsize=20_000)
def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.IGNORECASE)


@pandas_udf(StructType([StructField("score", DoubleType()), StructField("cue", StringType()), StructField("snippet", StringType())]))
def cue(text: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The strongest cue in a clean text that one term (its pattern) comes before another; of equal ones the first listed, with 30 characters around it."""
    out = []
    for t, a, b in zip(text, before, after, strict=True):
        best: tuple = (0.0, None, None)
        if t and a and b:
            for template, score, name in fixed.CUE_PATTERNS:
                if score > best[0] and (m := _compiled(template.replace("{A}", a).replace("{B}", b)).search(t)):
                    best = score, name, t[max(0, m.start() - 30) : m.end() + 30].strip()
        out.append(best)
    return pd.DataFrame(out, columns=["score", "cue", "snippet"])


def term_place(text: Column, pattern: Column) -> Column:
    """Where a term first stands in a clean text, from 0; null if nowhere."""
    at = F.regexp_instr(text, F.concat(F.lit("(?i)\\b"), pattern, F.lit("\\b")))
    return F.when(at > 0, at - 1)


def _stems(text: Column) -> Column:
    """Words without the letters that singular and plural differ in at the end: a term and a text that has it share the stem of the term's first word."""
    w = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(w, lambda x: F.regexp_replace(x, "[seiy]+$", ""))


def mentions(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """entity_id, name, chunk_id, ts, offset, heading, for entities (lecture_id, entity_id, name) that chunks (lecture_id, chunk_id, ts, transcript, ocr_text, visual_context) mention.

    Terms and chunks meet by lecture and the stem of the term's first word; the
    inflected pattern is tested after.
    """
    e = entities.withColumn("_p", term_pattern(F.col("name"))).filter("_p is not null").withColumn("_k", _stems(F.lower("name"))[0])
    said, ocr, seen = (cue_text(F.col(c)) for c in ("transcript", "ocr_text", "visual_context"))
    c = chunks.select("lecture_id", "chunk_id", "ts", F.concat_ws(" ", said, ocr, seen).alias("_t"), F.concat_ws(" ⁣ ", ocr, seen).alias("_h"))
    keys = c.select("lecture_id", "chunk_id", F.explode(F.array_distinct(_stems(F.col("_t")))).alias("_k"))
    pairs = e.join(keys, ["lecture_id", "_k"]).select("lecture_id", "entity_id", "name", "chunk_id", "_p")
    found = pairs.join(c, ["lecture_id", "chunk_id"]).withColumn("offset", term_place(F.col("_t"), F.col("_p"))).filter("offset is not null")
    return found.select("lecture_id", "entity_id", "name", "chunk_id", "ts", "offset", term_place(F.col("_h"), F.col("_p")).isNotNull().alias("heading"))


def profiles(entities: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """lecture_id, entity_id, name, t, offset, chunk_id, chunk_ids, places, in_headings, in_first_segment for each entity; t is null for one that nothing mentions.

    The earliest mention has the least time, then the least offset.  segments:
    lecture_id, place (0 is the first), title, start, chunk_ids.  A title that names an
    entity is a heading, and a mention at the segment's start if that is earlier.
    """
    m = mentions(entities, chunks)
    by_chunk = m.groupBy("lecture_id", "entity_id").agg(F.min(F.struct("ts", "offset", "chunk_id")).alias("f"), F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"), F.max("heading").alias("h"))
    inside = m.join(segments.select("lecture_id", "place", F.explode("chunk_ids").alias("chunk_id")), ["lecture_id", "chunk_id"]).select("lecture_id", "entity_id", "place", F.lit(False).alias("titled"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("int").alias("offset"))
    e = entities.withColumn("_p", term_pattern(F.col("name"))).filter("_p is not null").withColumn("_k", _stems(F.lower("name"))[0])
    s = segments.select("lecture_id", "place", "start", cue_text(F.col("title")).alias("_t"))
    titled = e.join(s.withColumn("_k", F.explode(F.array_distinct(_stems(F.col("_t"))))), ["lecture_id", "_k"]).withColumn("offset", term_place(F.col("_t"), F.col("_p"))).filter("offset is not null")
    both = inside.union(titled.select("lecture_id", "entity_id", "place", F.lit(True), "start", "offset"))
    by_segment = both.groupBy("lecture_id", "entity_id").agg(F.sort_array(F.collect_set("place")).alias("places"), F.max("titled").alias("titled"), F.min(F.when(F.col("titled"), F.struct("start", "offset"))).alias("g"))
    p = entities.select("lecture_id", "entity_id", "name").join(by_chunk, ["lecture_id", "entity_id"], "left").join(by_segment, ["lecture_id", "entity_id"], "left")
    earlier = F.col("g").isNotNull() & (F.col("f.ts").isNull() | (F.col("g.start") < F.col("f.ts")))
    no = F.lit(False)
    return p.select(
        "lecture_id", "entity_id", "name",
        F.when(earlier, F.col("g.start")).otherwise(F.col("f.ts")).alias("t"),
        F.when(earlier, F.col("g.offset")).otherwise(F.col("f.offset")).alias("offset"),
        F.col("f.chunk_id").alias("chunk_id"),
        F.coalesce("chunk_ids", F.array().cast(f"array<{m.schema['chunk_id'].dataType.simpleString()}>")).alias("chunk_ids"),
        F.coalesce("places", F.array().cast("array<int>")).alias("places"),
        (F.coalesce("h", no) | F.coalesce("titled", no)).alias("in_headings"),
        F.coalesce(F.array_contains("places", 0), no).alias("in_first_segment"),
    )


def cue_scores(pairs: DataFrame, profile: DataFrame, chunks: DataFrame) -> DataFrame:
    """lecture_id, src, dst, discourse, cue, snippet: the best cue for each pair in a chunk's transcript; of equal ones the earliest chunk's."""
    terms = profile.select("lecture_id", F.col("entity_id").alias("_e"), term_pattern(F.col("name")).alias("_p"), "chunk_ids")
    a = terms.withColumnsRenamed({"_e": "src", "_p": "_a", "chunk_ids": "_x"})
    b = terms.withColumnsRenamed({"_e": "dst", "_p": "_b", "chunk_ids": "_y"})
    # a cue names both terms, so only chunks that mention both can have one
    p = pairs.select("lecture_id", "src", "dst").join(a, ["lecture_id", "src"]).join(b, ["lecture_id", "dst"])
    p = written(p.select("lecture_id", "src", "dst", "_a", "_b", F.explode(F.array_intersect("_x", "_y")).alias("chunk_id")), "cue-pairs")
    # rows are few bytes and much work: both sides are dealt to tasks by the number of pairs
    n = p.count() * (ROWS // CUES)
    said = chunks.select("lecture_id", "chunk_id", "ts", cue_text(F.col("transcript")).alias("_t"))
    p = spread(p, n, "lecture_id", "chunk_id").join(spread(said, n, "lecture_id", "chunk_id").hint("merge"), ["lecture_id", "chunk_id"])
    p = p.withColumn("c", cue("_t", "_a", "_b")).filter("c.score > 0")
    best = p.groupBy("lecture_id", "src", "dst").agg(F.min(F.struct((-F.col("c.score")).alias("s"), "ts", "chunk_id", "c")).alias("m"))
    return best.select("lecture_id", "src", "dst", F.col("m.c.score").alias("discourse"), F.col("m.c.cue").alias("cue"), F.col("m.c.snippet").alias("snippet"))


def candidate_pairs(profile: DataFrame, relations: DataFrame, chunks: DataFrame, window: int = 3) -> DataFrame:
    """Ordered pairs that may be prerequisites, with what speaks for them and the reason (null: accepted) why not.

    Only pairs that are related, share a chunk or lie within `window` segments are
    listed: any other is `not_near`, and its number follows from the entities'.  A pair
    against the order of time needs a PREREQUISITE_OF forward, a DERIVED_FROM back, or
    a cue of 0.8: else it is out of `temporal_order`; so is one without a time.
    """
    r = relations.select("lecture_id", "src", "dst", "relation").filter("src <> dst")
    fwd = r.groupBy("lecture_id", "src", "dst").agg(F.sort_array(F.collect_set("relation")).alias("forward"))
    rev = fwd.select("lecture_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("forward").alias("reverse"))
    shared = profile.select("lecture_id", "entity_id", F.explode("chunk_ids").alias("k"))
    near = profile.select("lecture_id", "entity_id", F.explode("places").alias("k"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.select("lecture_id", "k", F.col("entity_id").alias("src")).join(y.select("lecture_id", "k", F.col("entity_id").alias("dst")), ["lecture_id", "k"]).filter("src <> dst").select("lecture_id", "src", "dst")

    wide = near.select("lecture_id", "entity_id", F.explode(F.sequence(F.col("k") - window, F.col("k") + window)).alias("k"))
    pairs = fwd.select("lecture_id", "src", "dst").union(rev.select("lecture_id", "src", "dst")).union(met(shared, shared)).union(met(wide, near)).distinct()
    side = lambda to: profile.select("lecture_id", F.col("entity_id").alias(to), *[F.col(c).alias(f"{c}_{to}") for c in ("t", "in_headings", "in_first_segment")])
    p = pairs.join(side("src"), ["lecture_id", "src"]).join(side("dst"), ["lecture_id", "dst"]).join(fwd, ["lecture_id", "src", "dst"], "left").join(rev, ["lecture_id", "src", "dst"], "left")
    p = p.join(cue_scores(pairs, profile, chunks), ["lecture_id", "src", "dst"], "left").withColumn("discourse", F.coalesce("discourse", F.lit(0.0)))
    none = F.array().cast("array<string>")
    p = p.withColumns({"forward": F.coalesce("forward", none), "reverse": F.coalesce("reverse", none)})
    strong = F.array_contains("forward", "PREREQUISITE_OF") | F.array_contains("reverse", "DERIVED_FROM") | (F.col("discourse") >= 0.8)
    late = F.col("t_src").isNull() | F.col("t_dst").isNull() | ((F.col("t_src") > F.col("t_dst")) & ~strong)
    return p.withColumn("reason", F.when(late, "temporal_order"))


def graph_evidence(forward: Column, reverse: Column) -> Column:
    """The greatest weight of a pair's relations, each way."""
    table = lambda i: F.create_map(*[F.lit(x) for k, w in fixed.PREREQUISITE_WEIGHTS.items() for x in (k, w[i])])
    most = lambda names, i: F.coalesce(F.array_max(F.transform(names, lambda n: F.coalesce(F.element_at(table(i), n), F.lit(0.0)))), F.lit(0.0))
    return F.greatest(most(forward, 0), most(reverse, 1))


def inferred(entities: DataFrame, chunks: DataFrame, segments: DataFrame, relations: DataFrame, least: float = 0.65) -> DataFrame:
    """lecture_id, src, dst, confidence, discourse, graph, cue: prerequisites of each lecture, confident enough and without cycles."""
    p = written(profiles(entities, chunks, segments), "profiles")  # used several times
    c = candidate_pairs(p, relations, chunks).filter("reason is null").withColumn("graph", graph_evidence(F.col("forward"), F.col("reverse")))
    c = c.withColumn("confidence", confidence(F.col("discourse"), F.col("graph"), F.col("in_headings_src"), F.col("in_first_segment_src"), F.col("t_src"), F.col("t_dst")))
    return acyclic(c.filter(F.col("confidence") >= least).select("lecture_id", "src", "dst", "confidence", "discourse", "graph", "cue"))


def numbered(rows: DataFrame, group: str, order: list[str], prefix: str) -> DataFrame:
    """rows with number, `prefix` and six digits from 000001, in an order within each group."""
    return rows.withColumn("number", F.format_string(f"{prefix}%06d", F.row_number().over(Window.partitionBy(group).orderBy(*order))))
