"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame code only.

A shingle is five consecutive words (a shorter text is one shingle); its hash is the
first 16 hexadecimal digits of the md5 of its words joined by spaces.  A sketch is
the k least distinct hashes in order, so the sketch of a union is the k least of the
sketches' union (`merged`), and from sketches alone follow estimates of
resemblance, containment and the number of distinct shingles.

Defined results: null text counts as empty; a text without words has the empty
sketch, which resembles only another empty one (1.0); equal texts have equal
sketches; texts with at most k distinct shingles are compared exactly.  Repeated rows follow one
another; a doc_id that is the least long counts as null in the order.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import cut, word_array

SHINGLE, K, HEX = 5, 128, 16


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """The hash of each shingle of a text, in order."""

    def hashed(x: Column) -> Column:
        return F.substring(F.md5(F.array_join(x, " ").cast("binary")), 1, HEX)

    return F.transform(
        F.filter(F.array(word_array(text)), lambda w: F.size(w) > 0),
        lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (words - 1))), lambda i: hashed(F.slice(w, i, words))),
    )


def sketch(text: Column, k: int = K) -> Column:
    """The k least distinct shingle hashes of a text, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(shingle_hashes(text)))), 1, k)


def joined(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    return F.transform(
        F.array(joined(a, b, k)),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.filter(F.array_intersect(a, b), lambda v: v <= F.element_at(u, -1))) / F.size(u)),
    )[0]


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the range."""
    top = F.conv(F.substring(F.element_at(a, -1), 1, 12), 16, 10).cast("double") + 1.0
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << 48) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the common number over a's."""
    common = resemblance(a, b, k) * distinct_count(joined(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def merged(sketches: DataFrame, group: str, column: str, k: int = K) -> DataFrame:
    """One sketch for each group of sketches: distinct hashes first, then the k least; a large group is cut to k hashes in every task before the shuffle."""
    hashes = sketches.select(group, F.explode(column).alias("_h")).distinct()
    least = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h"))).filter(F.col("_r") <= k)
    return least.groupBy(group).agg(F.sort_array(F.collect_list("_h")).alias(column))


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and the order of rows, descending: _key (the id; the least long for null), _hash (60 bits of the text's md5), _part (the task that read it: splits equal rows)."""
    return _keyed(docs).withColumns({"_hash": _text_hash(), "_part": F.spark_partition_id()})


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))


def _text_hash() -> Column:
    return F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long")


def boundaries(places: DataFrame, rows: int, bucket_rows: int, most_buckets: int, per_bucket: int = 8) -> list[tuple[int, int, int]]:
    """Ascending lower ends of buckets of about equal numbers of rows, for places (_key, _hash, _part, n).

    Places with many rows, and about per_bucket others for each bucket, chosen by
    hash, stand for all; they only decide how rows are dealt out.
    """
    buckets = max(1, min(most_buckets, -(-rows // bucket_rows)))
    if buckets == 1:
        return []
    heavy = max(1, rows // (buckets * per_bucket))
    rate = min(1.0, 1.0 * buckets * per_bucket / rows)
    share = F.pmod(F.xxhash64("_key", "_hash", "_part"), F.lit(1 << 30)) / float(1 << 30)
    chosen = places.filter((F.col("n") >= heavy) | (share < rate)).withColumn("w", F.when(F.col("n") >= heavy, F.col("n")).otherwise(F.col("n") / rate)).toArrow()
    key, part, text, weight = (chosen[c].to_numpy() for c in ("_key", "_part", "_hash", "w"))
    order = np.lexsort((part, text, key))
    until = np.cumsum(weight[order]) - weight[order]
    nth = np.floor(until * (buckets / max(1.0, float(weight.sum())))).astype(np.int64)
    first = order[np.flatnonzero(np.diff(nth, prepend=0) > 0)]
    return list(zip(key[first].tolist(), text[first].tolist(), part[first].tolist(), strict=True))


def bucket_of(ends: list[tuple[int, int, int]]) -> Column:
    """The number of lower ends up to a row's place, found in two steps of the square root of their number."""
    if not ends:
        return F.lit(0)
    place = F.struct(F.col("_key").alias("k"), F.col("_hash").alias("h"), F.col("_part").alias("p"))
    wide = math.isqrt(len(ends)) + 1
    stated = lambda some: F.from_json(F.lit(json.dumps([dict(zip("khp", e, strict=True)) for e in some])), "array<struct<k:bigint,h:bigint,p:int>>")
    below = lambda a: F.size(F.filter(a, lambda e: e <= place))
    coarse = below(stated(ends[::wide]))
    fine = below(F.slice(stated(ends), (F.greatest(coarse, F.lit(1)) - 1) * wide + 1, wide))
    return (F.greatest(coarse, F.lit(1)) - 1) * wide + fine


def with_next(docs: DataFrame, bucket_rows: int = 1024, most_buckets: int = 65536) -> DataFrame:
    """docs (doc_id, text) in buckets of the descending order, each with a guest: the first row of the bucket after it.

    Buckets hold about equal numbers of rows wherever the ids lie, bucket_rows (more
    once there are most_buckets); rows with one id are split by their text, equal rows by the task
    that read them.  The last bucket's guest is the first row of all.  Returns _bucket,
    _guest, _key, _hash, _part, doc_id, text: within a bucket, sorted by _guest, then the order,
    then text, each row's successor is the next document.
    """
    d = ordered(docs)
    places = cut(d.groupBy("_key", "_hash", "_part").agg(F.count(F.lit(1)).alias("n")), "places")
    rows = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket = bucket_of(boundaries(places, rows, bucket_rows, most_buckets)).alias("_bucket")
    own = d.select(bucket, F.lit(0).alias("_guest"), "_key", "_hash", "_part", "doc_id", "text")
    # at most most_buckets + 1 rows: the head of a bucket visits the bucket above, the highest one's visits the lowest
    heads = sorted((r[0], r[1]["k"], r[1]["h"]) for r in places.groupBy(bucket).agg(F.max(F.struct(F.col("_key").alias("k"), F.col("_hash").alias("h")))).collect())
    visits = docs.sparkSession.createDataFrame([(k, h, heads[(i + 1) % len(heads)][0]) for i, (_, k, h) in enumerate(heads)], "_key long, _hash long, _bucket int")
    # texts are hashed only where the id is a head's
    guests = _keyed(docs).join(F.broadcast(visits), "_key").filter(_text_hash() == F.col("_hash")).groupBy("_bucket").agg(F.min("text").alias("text"))
    return own.unionByName(guests.select("_bucket", F.lit(1).alias("_guest"), "text"), allowMissingColumns=True)


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of the rows of docs (doc_id, text) and of their edited texts.

    Edited: the last floor(n/2) code points are replaced by the first as many of the
    next document by descending id (null ids last; equal ids by descending md5 of the
    text, of which 60 bits count, then by text; after the last comes the first).  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, distinct_shingles.
    """
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_key"), F.desc("_hash"), F.desc("_part"), "text")
    # the texts move alone: a sketch made before would nearly double what is shuffled
    d = with_next(docs).repartition("_bucket").withColumn("_sketch", sketch(F.col("text"), k))
    d = d.withColumn("_next", F.lead("text").over(order)).withColumn("_next_sketch", F.lead("_sketch").over(order)).filter("_guest = 0")
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next"), F.lit(1), half)))
    d = d.withColumn("_edited_sketch", sketch(F.col("_edited"), k))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("_sketch", "").alias("fingerprint"),
        F.array_join("_edited_sketch", "").alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"),
        distinct_count(F.col("_sketch"), k).alias("distinct_shingles"),
    )
