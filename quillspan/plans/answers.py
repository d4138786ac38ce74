"""Queries from retrieved passages to contexts and their sources, and from mentions to prerequisites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators import assembly, inference, lexical
from quillspan.plans import mapping as m
from quillspan.plans import retrieval


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third item asks about a whole lecture; every second one wants pictures."""
    i = F.col("item_id")
    return m.table(spark, sf_dir, "benchmark").select(i.alias("query_id"), (i % 3 == 0).alias("is_lecture_wide"), (i % 2 == 0).alias("need_visual"), F.lit(6000).alias("budget"), F.col("text").alias("query"))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as candidates: the document's text was said, its language is what is seen."""
    c = m.chunks(spark, sf_dir).join(m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("visual_context")), "chunk_id")
    segment = F.floor(F.col("ts") / 300.0).cast("string").alias("segment_id")
    return c.select("lecture_id", "chunk_id", segment, "ts", F.col("text").alias("transcript"), F.lit(None).cast("string").alias("ocr_text"), "visual_context")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best passages of an item, then five that a graph would add: the first of its lecture."""
    q = m.questions(spark, sf_dir)
    top = lexical.best(m.passages(spark, sf_dir), q, retrieval.K).select("query_id", "chunk_id", F.col("rank").alias("arrival"), F.round("score", 6).alias("score"))
    ids = m.passages(spark, sf_dir).select("lecture_id", "chunk_id")
    first = ids.withColumn("arrival", F.row_number().over(Window.partitionBy("lecture_id").orderBy("chunk_id"))).filter("arrival <= 5")
    more = q.select("query_id", "lecture_id").join(first, "lecture_id").select("query_id", "chunk_id", "arrival", F.lit(None).cast("double").alias("score"))
    # texts join once, after both legs are cut to their top
    both = assembly.pooled(*[leg.select("query_id", "arrival", *[F.col(c) if c in leg.columns else F.lit(None).alias(c) for c in assembly.CANDIDATE]) for leg in (top, more)])
    return both.select("query_id", "arrival", "chunk_id", "score").join(_payload(spark, sf_dir), "chunk_id")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.reranked(_pool(spark, sf_dir), _plans(spark, sf_dir), assembly.shared_words)


def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both legs, each once, by how many words of the query their passage has; equal ones as they arrived."""
    return _ranked(spark, sf_dir).select("query_id", "chunk_id", "arrival", "score", F.md5("passage").alias("passage"), "rerank_score", "rank")


def rerank_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer that keeps the order: what other scorers are compared with."""
    r = assembly.reranked(_pool(spark, sf_dir), _plans(spark, sf_dir), assembly.in_order)
    return r.select("query_id", "chunk_id", "rerank_score", "rank")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph results of an item: relations that start from the part of its number."""
    e = m.entities(spark, sf_dir)
    r = m.relations(spark, sf_dir).filter("src <> dst").groupBy("src", "relation", "dst").agg(F.min(F.struct("order_id", "line")).alias("at"))
    q = m.questions(spark, sf_dir).select("query_id", F.col("query_id").alias("src"))
    name = lambda id_, to: e.select(F.col("entity_id").alias(id_), F.col("name").alias(to))
    r = q.join(r, "src").join(name("src", "start_name"), "src").join(name("dst", "related_name"), "dst")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "dst"))
    none = F.lit(None).cast("array<struct<source:string,relation:string,target:string>>")
    return r.select("query_id", at.alias("arrival"), "start_name", "related_name", F.array("relation").alias("rel_types"), none.alias("edges"), F.lit(1).alias("hops"), F.lit("out").alias("direction"))


def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an item's graph results within a quarter of its budget."""
    return assembly.graph_context(_lines(spark, sf_dir), _plans(spark, sf_dir))


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every item: graph lines, then merged passages in order of time, within the budget."""
    plans = _plans(spark, sf_dir).drop("query")
    whole, _ = assembly.contexts(_ranked(spark, sf_dir), _lines(spark, sf_dir), plans)
    return whole.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def context_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer may cite: the chunks whose text is in the context, by rank."""
    plans = _plans(spark, sf_dir).drop("query")
    _, tagged = assembly.contexts(_ranked(spark, sf_dir), _lines(spark, sf_dir), plans)
    return assembly.sources(tagged)


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, chunks, segments and relations of conversations: a turn is a chunk, four turns a segment; names are words that two turns or more have."""
    c = m.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("transcript"))
    chunks = c.select("lecture_id", "chunk_id", (F.col("chunk_id") * 30.0).alias("ts"), "transcript", F.lit("").alias("ocr_text"), F.lit("").alias("visual_context"))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("transcript"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("name")
    names = c.select("lecture_id", "chunk_id", words).groupBy("lecture_id", "name").agg(F.countDistinct("chunk_id").alias("n")).filter("n > 1")
    entities = names.select("lecture_id", F.xxhash64("name").alias("entity_id"), "name")
    place = F.floor(F.col("chunk_id") / 4).cast("int")
    segments = c.withColumn("place", place).groupBy("lecture_id", "place").agg(F.lit("").alias("title"), (F.min("chunk_id") * 30.0).alias("start"), F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))
    # a name is used by those that follow it in the alphabet and share its first letter
    a = entities.select("lecture_id", F.substring("name", 1, 1).alias("k"), F.col("entity_id").alias("src"), F.col("name").alias("x"))
    b = entities.select("lecture_id", F.substring("name", 1, 1).alias("k"), F.col("entity_id").alias("dst"), F.col("name").alias("y"))
    relations = a.join(b, ["lecture_id", "k"]).filter("x < y").select("lecture_id", "src", "dst", F.lit("PREREQUISITE_OF").alias("relation"))
    return entities, chunks, segments, relations


def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First mention of every name, in singular or plural, and the turns that mention it."""
    entities, chunks, segments, _ = _spoken(spark, sf_dir)
    p = inference.profiles(entities, chunks, segments)
    return p.select("lecture_id", "name", "t", "chunk_id", F.size("chunk_ids").alias("n_chunks"), F.size("places").alias("n_places"), "in_first_segment")


def prereq_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites among the names of each conversation, from cues, mentions, time and relations, without cycles."""
    entities, chunks, segments, relations = _spoken(spark, sf_dir)
    name = lambda id_, to: entities.select("lecture_id", F.col("entity_id").alias(id_), F.col("name").alias(to))
    p = inference.inferred(entities, chunks, segments, relations)
    p = p.join(name("src", "before"), ["lecture_id", "src"]).join(name("dst", "after"), ["lecture_id", "dst"])
    return p.select("lecture_id", "before", "after", "confidence", "discourse", "graph", "cue")


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}'))"
_POOL = f"""{retrieval._bm25_sql(m.PASSAGES_SQL, m.QUESTIONS_SQL)},
top as (select query_id, chunk_id, 0 as leg, rank as arrival, round(score, 6) as score from (select *, {retrieval._RANK} as rank from sc) where rank <= {retrieval.K}),
fst as (select lecture_id, chunk_id, row_number() over (partition by lecture_id order by chunk_id) as arrival from {m.PASSAGES_SQL}),
more as (select query_id, chunk_id, 1 as leg, arrival, null::double as score from {m.QUESTIONS_SQL} q join fst using (lecture_id) where arrival <= 5),
one as (select * from (select *, row_number() over (partition by query_id, chunk_id order by leg, arrival) as n from (select * from top union all select * from more)) where n = 1),
pool as (select query_id, chunk_id, score, row_number() over (partition by query_id order by leg, arrival) as arrival from one),
passage as (select p.*, q.text as query, concat_ws(' ', case when trim(coalesce(d.text, '')) <> '' then '[Transcript] ' || trim(d.text) end, case when trim(coalesce(d.lang, '')) <> '' and item_id % 2 = 0 then '[Visual] ' || trim(d.lang) end) as passage
  from pool p join benchmark q on item_id = query_id join documents d on doc_id = chunk_id)"""

QUERIES = {f.__name__: f for f in (rerank_pool, rerank_identity, graph_context, context_assembly, context_sources, entity_profiles, prereq_inferred)}
ORACLES = {
    "rerank_pool": f"""with {_POOL}, s as (select *, len(list_intersect({_WORDS.format('query')}, {_WORDS.format('passage')}))::double as rerank_score from passage)
select query_id, chunk_id, arrival, score, md5(passage) as passage, rerank_score, row_number() over (partition by query_id order by rerank_score desc, arrival) as rank from s""",
    "rerank_identity": f"with {_POOL} select query_id, chunk_id, (-arrival)::double as rerank_score, arrival as rank from passage",
    "graph_context": f"""with e as {m.ENTITIES_SQL}, r as (select src, relation, dst, min((order_id, line)) as place from {m.RELATIONS_SQL} where src <> dst group by all),
l as (select item_id as query_id, row_number() over (partition by item_id order by place, dst) as arrival, '[Graph] ' || trim(a.name) || ' -' || relation || '-> ' || trim(b.name) as line
  from benchmark join r on src = item_id join e a on a.entity_id = src join e b on b.entity_id = dst),
u as (select query_id, line, min(arrival) as arrival from l group by 1, 2),
w as (select *, sum(length(line) + 1) over (partition by query_id order by arrival) as used from u)
select query_id, string_agg(line, chr(10) order by arrival) as graph_text from w where used <= 1500 group by 1""",
}
