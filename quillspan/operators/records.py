"""Records of many kinds: joined with their frames, made texts, told apart, put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.containment import contained, first_places, sentences
from quillspan.sources.scratch import written


def with_frame_times(records: DataFrame, frames: DataFrame) -> DataFrame:
    """records (frame_id, ...) with the ts of their frame, for frames (frame_id, pos, ts): of repeated frames the last by pos counts; records without a frame or its time go."""
    last = frames.groupBy("frame_id").agg(F.max(F.struct("pos", "ts"))["ts"].alias("ts")).filter("ts is not null")
    return records.join(last, "frame_id")


def uncovered(source: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of source that covered doesn't have; null is a value like others."""
    return source.select(*keys).subtract(covered.select(*keys))


def segmenter_text(said: Column, seen: Column, ocr: Column) -> Column:
    """A chunk's text for segmenting: on one line, without blanks at its ends."""
    return F.regexp_replace(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (said, seen, ocr)]), "^\\s+|\\s+$", "")


def embedder_text(said: Column, seen: Column, ocr: Column) -> Column:
    """A chunk's text for embedding: three lines as they are."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (said, seen, ocr)])


def triplet_text(said: Column, seen: Column, ocr: Column) -> Column:
    """A chunk's text for triplets: three lines without blanks at the ends."""
    return F.regexp_replace(embedder_text(said, seen, ocr), "^\\s+|\\s+$", "")


def outer_array(raw: Column) -> Column:
    """The elements, as JSON, between the first [ and the last ] of what a model wrote, fences left out; none if that is no JSON array."""
    inner = F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", ""), "(?s)\\[.*\\]", 0)
    return F.coalesce(F.from_json(inner, "array<string>"), F.array().cast("array<string>"))


def routed(expected: Column, predicted: Column) -> Column:
    """1.0 if the route is the expected one in any case, else 0.0; also if either is missing."""
    return F.when(F.lower(expected) == F.lower(predicted), 1.0).otherwise(0.0)


def with_evidence(relations: DataFrame) -> DataFrame:
    """Relations that quote something."""
    return relations.filter(F.trim(F.coalesce("evidence", F.lit(""))) != "")


def united(datasets: dict[str, DataFrame]) -> DataFrame:
    """Datasets of different columns as one, with the `kind` of each row; what a dataset lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("kind", F.lit(k)) for k, d in datasets.items()])


def naming_sentences(names: DataFrame, texts: DataFrame, within: list[str], least: int = 20, most: int = 400, words: bool = False) -> DataFrame:
    """within, name, text_id, nth, sentence: the first sentence of `least` to `most` characters that names each concept (within, name), in any case.  `words`: no name has a blank inside."""
    s = sentences(texts, within).withColumn("text", F.trim("text")).filter(F.length("text").between(least, most))
    places = s.select(*within, F.struct("text_id", "nth").alias("place"), F.lower("text").alias("text"))
    low = written(names.select(*within, "name", F.lower(F.trim("name")).alias("_low")), "named")
    one = low.select(*within, F.col("_low").alias("name"))
    found = first_places(places, one if words else one.filter(~F.col("name").rlike("\\s")), within)
    if not words:
        more = contained(places.withColumnRenamed("place", "text_id"), one.filter(F.col("name").rlike("\\s")), within)
        found = found.union(more.groupBy(*within, "name").agg(F.min("text_id")))
    found = low.join(found.withColumnRenamed("name", "_low"), [*within, "_low"]).select(*within, "name", F.col("place.text_id").alias("text_id"), F.col("place.nth").alias("nth"))
    return found.join(s.withColumnRenamed("text", "sentence"), [*within, "text_id", "nth"])
