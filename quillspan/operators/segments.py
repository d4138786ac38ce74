"""Texts of segments as columns: titles, noise, rendered chunks, objects in captions, variants of names; scores of ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed


def stripped(text: Column) -> Column:
    """Without blanks at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")


def written_title(raw: Column, most: int = 8) -> Column:
    """A title as a model wrote it: quotes, end stops, a leading label and marks go, `most` words stay; a stand-in if nothing does."""
    t = F.rtrim(F.btrim(stripped(raw), F.lit("\"'")), F.lit("."))
    t = F.regexp_replace(F.regexp_replace(t, fixed.TITLE_PREFIX, ""), fixed.TITLE_MARKS, "")
    t = stripped(F.regexp_replace(t, "\\s+", " "))
    return F.when(t == "", fixed.UNTITLED).otherwise(F.array_join(F.slice(F.split(t, " "), 1, most), " "))


def is_repetitive(text: Column) -> Column:
    """No words of letters; four or more of which under 0.4 differ; or one word of at most three letters, however often."""
    # ends of words are ASCII, as in the SQL: of a word with an accent, the runs without it count
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?<![a-z0-9_])[a-z]+(?![a-z0-9_])"), F.lit(0))
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    return (n == 0) | ((n >= 4) & (kinds / n < 0.4)) | ((kinds == 1) & (F.length(F.get(words, F.lit(0))) <= 3))


def slide_text(text: Column) -> Column:
    """A slide's description without its generic header and background; at most one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(stripped(text), fixed.SLIDE_HEADER, ""), fixed.SLIDE_BACKGROUND, "")
    return stripped(F.regexp_replace(t, "\n{3,}", "\n\n"))


def rendered(chunk_id: Column, at: Column, said: Column, ocr: Column, seen: Column) -> Column:
    """A chunk as labelled sections; what is empty is left out, but speech is named as missing."""
    named = lambda label, t: F.when(t != "", F.concat(F.lit(label + ":\n"), t))
    head = F.format_string("--- [Chunk: %s | Timestamp: %.2fs] ---", chunk_id.cast("string"), F.coalesce(at, F.lit(0.0)))
    speech = F.coalesce(named("SPOKEN TRANSCRIPT", stripped(said)), F.lit("SPOKEN TRANSCRIPT: (None)"))
    return F.concat_ws("\n\n", head, speech, named("SLIDE / OCR TEXT", stripped(ocr)), named("VISUAL CONTEXT", slide_text(seen)))


def caption_objects(text: Column, most: int = 20) -> Column:
    """The first `most` different items of a caption, lower-cased, of 2 to 49 characters; commas, semicolons and lines part them."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n;]"), lambda x: F.lower(stripped(x)))
    return F.slice(F.array_distinct(F.filter(items, lambda x: F.length(x).between(2, 49))), 1, most)


def name_variants(name: Column) -> Column:
    """A name, then it with naive singulars of its last word; they never coincide, as their ends differ."""
    last = F.lower(F.substring_index(name, " ", -1))
    n, off = F.length(last), lambda k: F.substring(name, F.lit(1), F.length(name) - k)
    y = F.when(last.endswith("ies") & (n > 4), F.concat(off(3), F.lit("y")))
    es = F.when(last.endswith("es") & (n > 3), off(2))
    s = F.when(last.endswith("s") & ~last.endswith("ss") & (n > 2), off(1))
    return F.array_compact(F.array(name, y, es, s))


def ranked_scores(rows: DataFrame, top: int = 3) -> DataFrame:
    """rows (query_id, arrival, score, relevant) -> query_id, mrr, top1, top_mean, least, most, mean; rows without a score count for the ranks only, 0 stands for nothing."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("arrival"))
    g = rows.withColumn("_r", place).groupBy("query_id").agg(
        (1.0 / F.min(F.when(F.col("relevant"), F.col("_r")))).alias("mrr"),
        F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("top1"),
        F.avg(F.when(F.col("_r") <= top, F.col("score"))).alias("top_mean"),
        F.min("score").alias("least"),
        F.max("score").alias("most"),
        F.avg("score").alias("mean"),
    )
    return g.select("query_id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("mrr", "top1", "top_mean", "least", "most", "mean")])


def outcomes(rows: DataFrame) -> DataFrame:
    """rows (query_id, in_pool, in_context, relevant, refused) -> query_id, outcome of each question that has a relevant row.

    With a relevant row in the context: ok, or refused_with_evidence; else
    lost_after_retrieval if one was in the pool, retrieval_miss if none was.
    """
    g = rows.filter("relevant").groupBy("query_id").agg(F.max("in_pool").alias("p"), F.max("in_context").alias("c"), F.max("refused").alias("r"))
    found = F.when(F.col("r"), "refused_with_evidence").otherwise("ok")
    return g.select("query_id", F.when(F.col("c"), found).when(F.col("p"), "lost_after_retrieval").otherwise("retrieval_miss").alias("outcome"))
