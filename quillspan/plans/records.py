"""Queries over records: frames, coverage, texts of chunks, model output, routes, unions, sentences that name concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import records as R
from quillspan.plans import audits
from quillspan.plans import mapping as m


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as records of frames that are known twice, some of them without a time."""
    e = m.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    frames = e.select(F.expr("event_id div 4").alias("frame_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 20 != 3, F.col("value")).alias("ts"))
    return R.with_frame_times(e.filter("event_type = 'view'").select("event_id", F.expr("event_id div 3").alias("frame_id")), frames)


def uncovered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in no line of a finished order."""
    done = m.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = m.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(done, "l_orderkey", "left_semi")
    return R.uncovered(m.table(spark, sf_dir, "part"), lines.withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"])


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts of every chunk, as digests: said, with its language seen and its source on the slide."""
    d = m.table(spark, sf_dir, "documents")
    parts = (F.col("text"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.concat(F.col("source"), F.lit(" \n")))
    return d.select("doc_id", *[F.md5(f(*parts)).alias(f.__name__) for f in (R.segmenter_text, R.embedder_text, R.triplet_text)])


def outer_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a model would write them: in prose, fenced, cut off, or none."""
    e = m.table(spark, sf_dir, "events").select("event_id", "props")
    raw = F.element_at(F.array(F.concat(F.lit("Here: ["), "props", F.lit(", "), "props", F.lit("] as asked")), F.concat(F.lit("```json\n["), "props", F.lit("]\n```")), F.concat(F.lit("["), "props"), F.lit("] no ["), F.concat(F.lit("["), "props", F.lit(",]"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", F.size(R.outer_array(raw)).alias("items"))


def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document's language in capitals, missing for some, is the expected one, by source."""
    d = m.table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 4 == 0, "EN").when(F.col("doc_id") % 4 < 3, F.upper("lang"))
    return d.groupBy("source").agg(F.round(F.avg(R.routed(F.col("lang"), said)), 6).alias("accuracy"))


def relations_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of which every third quotes its order and every fifth blanks."""
    quote = F.when(F.col("order_id") % 3 == 0, F.col("order_id").cast("string")).when(F.col("order_id") % 5 == 0, "  ")
    r = m.relations(spark, sf_dir).withColumn("evidence", quote)
    return R.with_evidence(r).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def dataset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, benchmark items and pages as one dataset."""
    t = lambda n: m.table(spark, sf_dir, n)
    parts = {"document": t("documents").select(F.col("doc_id").alias("id"), "text", "lang"), "item": t("benchmark").select(F.col("item_id").alias("id"), "text"), "page": t("pages").select(F.col("page_id").alias("id"), "url")}
    return R.united(parts).select("kind", "id", F.md5("text").alias("text"), "lang", "url")


def gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of fitting length that names the longest word of a text, in its lecture."""
    names = audits.text_relations(spark, sf_dir).select("lecture_id", F.col("source").alias("name")).distinct()
    found = R.naming_sentences(names, audits.texts(spark, sf_dir), ["lecture_id"], words=True)
    return found.select("lecture_id", "name", "text_id", "nth", F.length("sentence").alias("n_chars"))


QUERIES = {f.__name__: f for f in (frame_times, uncovered_parts, chunk_texts, outer_arrays, routing_accuracy, relations_with_evidence, dataset_union, gold_candidates)}
ORACLES = {
    "frame_times": """with f as (select event_id // 4 as frame_id, arg_max({'x': case when event_id % 20 <> 3 then value end}, event_id).x as ts from events group by 1)
select event_id, event_id // 3 as frame_id, f.ts from events e join f on f.frame_id = e.event_id // 3 where event_type = 'view' and f.ts is not null""",
    "uncovered_parts": "select p_partkey from part except select l_partkey from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F'",
    "chunk_texts": """with p as (select doc_id, coalesce(text, '') as a, coalesce(case when doc_id % 3 > 0 then lang end, '') as b, coalesce(source || ' ' || chr(10), '') as c from documents)
select doc_id, md5(regexp_replace(a || ' ' || b || ' ' || c, '^\\s+|\\s+$', '', 'g')) as segmenter_text, md5(a || chr(10) || b || chr(10) || c) as embedder_text, md5(regexp_replace(a || chr(10) || b || chr(10) || c, '^\\s+|\\s+$', '', 'g')) as triplet_text from p""",
    "outer_arrays": "select event_id, case event_id % 5 when 0 then 2 when 1 then 1 else 0 end as items from events",
    "routing_accuracy": """select source, round(avg(case when lower(lang) = lower(case when doc_id % 4 = 0 then 'EN' when doc_id % 4 < 3 then upper(lang) end) then 1.0::double else 0.0 end), 6) as accuracy from documents group by 1""",
    "relations_with_evidence": f"select relation, count(*) as n from {m.RELATIONS_SQL} where order_id % 3 = 0 group by 1",
    "dataset_union": "select 'document' as kind, doc_id as id, md5(text) as text, lang, null::varchar as url from documents union all select 'item', item_id, md5(text), null, null from benchmark union all select 'page', page_id, null, null, url from pages",
    "gold_candidates": f"""with {audits.TEXT_RELATIONS_SQL}, n as (select distinct lecture_id, source as name from tr),
s as (select source as lecture_id, doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss from documents where text is not null),
x as materialized (select lecture_id, doc_id, k - 1 as nth, trim(ss[k]) as t from s, unnest(range(1, len(ss) + 1)) u(k)), y as (select * from x where length(t) between 20 and 400),
f as (select n.lecture_id, name, min((doc_id, nth)) as loc, arg_min(length(t), (doc_id, nth)) as n_chars from n join y on y.lecture_id = n.lecture_id and contains(lower(t), name) group by 1, 2)
select lecture_id, name, loc[1] as text_id, loc[2]::int as nth, n_chars::int as n_chars from f""",
}
