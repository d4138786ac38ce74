"""Exact dedup by skew-safe combining, in DataFrame code only.

Texts meet three times, and their whole content is compared each time: every task
joins its own copies, salted digest groups merge what the tasks found, and the
winners of the salts merge globally.  However many copies a text has, a task sends
it on once, and no group gets more than its share of the tasks' rows.  Decisions
then go back to the rows by digest, rows of one id and text as one; hot digests go
to every task.  That equal digests mean equal texts is not assumed: a digest with two
texts would appear twice among the winners, and then rows are joined by their texts.

Defined results: null text counts as empty, so all such rows are copies of one
another and of empty texts (not of a single blank); of equal texts the least
doc_id stays, null only if there is no other; of repeated rows with that id exactly one
is kept; an empty table has no rows.  Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.lookup import attach, content_digest
from quillspan.llm.shared import BLANKS, cut

#: Groups of one digest, at most.
SALTS = 32
#: Repeated rows come back in runs of so many.
RUN = 65_536


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def content_groups(rows: DataFrame, least: str, salts: int = SALTS) -> DataFrame:
    """rows (_digest, _text, least) -> one row for each distinct _text: _digest, _text, the minimum of `least`, group_size."""
    salted = rows.withColumn("_salt", F.spark_partition_id() % salts)
    # the first half of this aggregation runs in the tasks that read the rows, where the salt is one
    merged = salted.groupBy("_digest", "_salt", "_text").agg(F.min(least).alias(least), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("_digest", "_text").agg(F.min(least).alias(least), F.sum("group_size").alias("group_size"))


def winners(rows: DataFrame, least: str, label: str) -> tuple[DataFrame, bool]:
    """The written groups of content_groups() without their texts, and whether each digest stands for one text."""
    found = cut(content_groups(rows, least).drop("_text"), label)
    return found, found.groupBy("_digest").count().filter("count > 1").isEmpty()


def _rows(docs: DataFrame, digest) -> DataFrame:
    d = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_text"))
    return d.withColumn("_digest", digest(F.col("_text")))


def _decided(d: DataFrame, sure: bool = True) -> DataFrame:
    """d (_digest, _text, doc_id) with keep_id and group_size; repeated rows are one, counted in `n`.  Texts stay if the digest isn't a sure one."""
    found, exact = winners(d.withColumnRenamed("doc_id", "keep_id"), "keep_id", "winners")
    if exact and sure:
        return attach(d.groupBy("_digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), found, ["_digest"], "group_size")
    own = d.groupBy("_digest", "_text", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return own.join(content_groups(d.withColumnRenamed("doc_id", "keep_id"), "keep_id"), ["_digest", "_text"])


def decide(docs: DataFrame, digest=content_digest) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    `digest` deals texts out; results are the same for any.
    """
    d = _decided(_rows(docs, digest), digest is content_digest)
    kind = docs.schema["doc_id"].dataType
    sha = content_digest(F.col("_text")) if "_text" in d.columns else F.col("_digest")
    runs = d.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))).alias("_run"))
    each = runs.select("*", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("n"), (F.col("_run") + 1) * RUN) - 1)).alias("_nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 0)
    return each.select("doc_id", F.col("keep_id").cast(kind).alias("keep_id"), "group_size", kept.alias("kept"), sha.alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each distinct text (of repeated rows, any)."""
    d = docs.select(F.struct("*").alias("_row"), content_digest(normalised(F.col("text"))).alias("_digest"), F.col("doc_id").alias("_id"))
    staying = cut(_decided(_rows(docs, content_digest)).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("_digest", F.col("doc_id").alias("_id")), "staying")
    ids = F.col("a._id").eqNullSafe(F.col("b._id"))
    stays = d.alias("a").join(staying.alias("b"), (F.col("a._digest") == F.col("b._digest")) & ids, "left_semi")
    return stays.groupBy("_digest").agg(F.first("_row").alias("_row")).select("_row.*")
