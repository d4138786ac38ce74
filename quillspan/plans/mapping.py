"""The tables of sf_dir as what the operators work on, with the same mapping in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a chunk of its source's lecture; every 15 seconds one."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("chunk_id"), "text")
    # ids alone are numbered by lecture; texts are dealt out by id
    at = F.row_number().over(Window.partitionBy("lecture_id").orderBy("chunk_id")) - 1
    return d.join(d.select("lecture_id", "chunk_id", (15.0 * at).alias("ts")), ["lecture_id", "chunk_id"])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks() without time: nothing to sort."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark item asks one of twenty lectures."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("lecture_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("t"), (F.col("vec_id") % 10).cast("string")).alias("lecture_id"), F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks its own tenant."""
    return vectors(spark, sf_dir).filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "lecture_id", "embedding", F.col("label").alias("wanted"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as timed utterances: 15 characters a second, a pause before each third turn."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("lecture_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pause = F.when(F.col("seq") % 3 == 0, 2.0).otherwise(0.5)
    length = F.length("text") / 15.0
    c = c.withColumn("_end", F.round(F.sum(length + pause).over(w), 3))
    return c.select("lecture_id", "seq", "text", F.round(F.col("_end") - length, 3).alias("start"), F.col("_end").alias("end"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order are related; the line number picks the type."""
    from quillspan.functions.fixed import RELATIONS

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = spread(li, li.count(), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = li.withColumn("dst", F.lead("l_partkey").over(w)).withColumnRenamed("l_partkey", "src")
    kind = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return li.filter("dst is not null").select("src", kind.alias("relation"), "dst", F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))


#: The same in SQL.
CHUNKS_SQL = "(select source as lecture_id, doc_id as chunk_id, text, 15.0::double * (row_number() over (partition by source order by doc_id) - 1) as ts from documents)"
PASSAGES_SQL = "(select source as lecture_id, doc_id as chunk_id, text from documents)"
QUESTIONS_SQL = "(select item_id as query_id, 'src' || (item_id % 20) as lecture_id, text as query from benchmark)"
VECTORS_SQL = "(select 't' || (vec_id % 10) as lecture_id, vec_id as chunk_id, embedding, label from embeddings)"
ATOMS_SQL = """(select lecture_id, seq, text, round(e - length(text) / 15.0::double, 3) as start, e as "end" from (
  select conv_id as lecture_id, turn as seq, coalesce(text, '') as text,
         round(sum(length(text) / 15.0::double + case when turn % 3 = 0 then 2.0 else 0.5 end) over (partition by conv_id order by turn rows unbounded preceding), 3) as e
  from conversations))"""
ENTITIES_SQL = "(select p_partkey as entity_id, p_name as name, p_type as type from part)"
RELATIONS_SQL = """(select src, list_value('PREREQUISITE_OF', 'INTRODUCED_BEFORE', 'USED_BY', 'DERIVED_FROM', 'VISUALIZED_BY', 'EXPLAINS')[(line % 6 + 1)::int] as relation, dst, order_id, line from (
  select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst, l_orderkey as order_id, l_linenumber as line from lineitem) where dst is not null)"""
