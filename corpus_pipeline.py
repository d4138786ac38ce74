"""From documents to training sequences: language, toxicity, near copies, mix, packing.

Each stage takes all that the stage before kept; run() writes each result as Parquet
in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import language_id, minhash, mixing, packing, toxicity
from quillspan.llm.shared import cut, drop_scratch, scratch_mark

#: A document goes if less than this share of its words is in one language, or if it is more likely toxic than not.
LEAST_LANGUAGE, MOST_TOXIC = 0.4, 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language, and without those that no language has LEAST_LANGUAGE of; a missing lang is filled in."""
    # the row travels as one column, so that no name of it can clash
    found = docs.select(F.struct("*").alias("_row"), language_id.language_column(docs, F.col("text")).alias("_p"))
    found = found.filter((F.col("_p.lang") != language_id.UNDETERMINED) & (F.col("_p.score") >= LEAST_LANGUAGE))
    return found.select(F.col("_row").withField("lang", F.coalesce("_row.lang", "_p.lang")).alias("_row")).select("_row.*")


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are toxic by the model of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = docs.select(F.struct("*").alias("_row"), toxicity.toxicity_column(docs, labels, F.col("text")).alias("_p"))
    return found.filter(F.col("_p.p_toxic") <= MOST_TOXIC).select("_row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents once, repeatedly, in part, or not at all."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", by_language), ("toxicity", by_toxicity), ("near_copies", without_near_copies), ("mixing", mixed), ("packing", packed)]
#: The trained models, the signatures and the BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage's rows are written, the scratch tables that it used go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = cut(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, mark, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
