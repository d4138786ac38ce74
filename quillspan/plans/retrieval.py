"""Retrieval queries: BM25, dense, fused, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import dense, fuse, lexical
from quillspan.plans import mapping as m

K = 15


def tok_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lexical.postings(m.passages(spark, sf_dir))
    terms = p.groupBy("lecture_id").agg(F.countDistinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    s = lexical.corpus_stats(m.passages(spark, sf_dir))
    return s.join(terms, "lecture_id", "left").select("lecture_id", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexical.best(m.passages(spark, sf_dir), m.questions(spark, sf_dir), K)
    return s.select("query_id", "lecture_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def bm25_eval_full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.full_rank(m.passages(spark, sf_dir), m.questions(spark, sf_dir)).select("query_id", "lecture_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _filler():
    return F.col("chunk_id") % 7 == 0


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_top_k(m.vectors(spark, sf_dir), m.vector_queries(spark, sf_dir).drop("wanted"), K, _filler())


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "lecture_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _text_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of the document of the same id, among the documents of the vectors' tenants."""
    d = m.table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), (F.col("doc_id") % 10).cast("string")).alias("lecture_id"), F.col("doc_id").alias("chunk_id"), "text")
    d = d.join(m.vectors(spark, sf_dir).select("chunk_id"), "chunk_id", "left_semi")
    q = d.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "lecture_id", F.col("text").alias("query"))
    return lexical.best(d, q, K)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fuse.rrf([_dense(spark, sf_dir), _text_leg(spark, sf_dir)], K)
    return f.select("query_id", "chunk_id", "rank", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), "n_legs")


def rrf_nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third leg: the vectors with the query's label, by id."""
    from pyspark.sql import Window

    q = m.vector_queries(spark, sf_dir).select("query_id", "lecture_id", "wanted")
    v = m.vectors(spark, sf_dir).select("lecture_id", "chunk_id", F.col("label").alias("wanted"))
    # the first of a tenant and label are the first of all who ask for it
    v = v.withColumn("_n", F.row_number().over(Window.partitionBy("lecture_id", "wanted").orderBy("chunk_id"))).filter(F.col("_n") <= K).drop("_n")
    third = q.join(v, ["lecture_id", "wanted"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).filter(F.col("rank") <= K).withColumn("score", F.lit(1.0))
    f = fuse.rrf([_dense(spark, sf_dir), _text_leg(spark, sf_dir), third], K)
    return f.select("query_id", "chunk_id", "rank", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), "n_legs")


def course_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of several lectures: five passages from each lecture, then the best of each, in one order."""
    from pyspark.sql import Window

    b = m.table(spark, sf_dir, "benchmark")
    member = F.explode(F.sequence(F.lit(0), F.col("item_id") % 3 + 1)).alias("nth")
    q = b.select(F.col("item_id").alias("course_query"), F.col("text").alias("query"), member, "item_id")
    q = q.select("course_query", "nth", "query", F.concat(F.lit("src"), ((F.col("item_id") + F.col("nth") * 7) % 20).cast("string")).alias("lecture_id"))
    q = q.withColumn("query_id", F.col("course_query") * 10 + F.col("nth"))
    s = lexical.best(m.passages(spark, sf_dir), q.select("query_id", "lecture_id", "query"), 5)
    s = s.join(q.select("query_id", "course_query", "nth"), "query_id").withColumn("arrival", F.struct("nth", "rank"))
    s = fuse.best_of_each(s, ["course_query", "lecture_id", "chunk_id"])
    w = Window.partitionBy("course_query").orderBy(F.round("score", 9).desc(), "nth", "rank")
    return s.select("course_query", "lecture_id", "chunk_id", F.round("score", 6).alias("score"), F.row_number().over(w).alias("position"))


def _bm25_sql(docs: str, queries: str) -> str:
    return f"""
  dt as materialized (select lecture_id, chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}') as ts from {docs}),
  st as (select lecture_id, count(*) as n_docs, avg(len(ts)) as avgdl from dt group by 1),
  po as materialized (select lecture_id, chunk_id, len(ts) as dl, t as term, count(*) as tf from dt, unnest(ts) as u(t) group by all),
  dfs as (select lecture_id, term, count(*) as df from po group by 1, 2),
  qt as (select query_id, lecture_id, t as term, count(*) as qtf from {queries} q, unnest(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]{{2,}}')) as u(t) group by all),
  sc as materialized (select query_id, po.lecture_id, chunk_id, sum(qtf * ln((n_docs - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score
         from qt join po using (lecture_id, term) join dfs using (lecture_id, term) join st using (lecture_id) group by all)"""


_RANK = "row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)"
_DENSE_SQL = f"""
  qv as (select chunk_id as query_id, lecture_id, embedding, label as wanted from {m.VECTORS_SQL} where chunk_id % 20 = 0),
  ds as (select query_id, v.lecture_id, v.chunk_id, list_inner_product(v.embedding::double[], qv.embedding::double[]) as score from {m.VECTORS_SQL} v join qv using (lecture_id)),
  d30 as (select * from (select *, {_RANK} as rank from ds) where rank <= {K + 15}),
  dense as (select * from (select query_id, lecture_id, chunk_id, score, {_RANK} as rank from d30 where chunk_id % 7 <> 0) where rank <= {K})"""
_LEG_DOCS = "(select 't' || (doc_id % 10) as lecture_id, doc_id as chunk_id, text from documents where doc_id in (select vec_id from embeddings))"
_LEG = _bm25_sql(_LEG_DOCS, f"(select chunk_id as query_id, lecture_id, text as query from {_LEG_DOCS} where chunk_id % 20 = 0)") + f",\n  leg as (select * from (select *, {_RANK} as rank from sc) where rank <= {K})"


def _rrf_sql(legs: list[str]) -> str:
    rows = " union all ".join(f"select query_id, chunk_id, rank, score, {i} as leg from {name}" for i, name in enumerate(legs))
    return f"""
  fused as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as rrf, arg_min(score, leg) as score, min(leg) as leg, arg_min(rank, leg) as r1, count(*) as n_legs from ({rows}) group by 1, 2),
  ranked as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, round(score, 9) desc, leg, r1) as rank from fused)
select query_id, chunk_id, rank, round(rrf, 9) as rrf, round(score, 6) as score, n_legs from ranked where rank <= {K}"""


QUERIES = {f.__name__: f for f in (tok_stats, bm25_topk, bm25_eval_full_rank, dense_topk_filtered, rrf_hybrid, rrf_nway, course_fanout)}
ORACLES = {
    "tok_stats": f"""
with dt as (select lecture_id, chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}') as ts from {m.PASSAGES_SQL}),
t as (select lecture_id, count(distinct t) as n_terms, count(*) as n_tokens from dt, unnest(ts) as u(t) group by 1)
select lecture_id, count(*) as n_docs, round(avg(len(ts)), 6) as avgdl, coalesce(any_value(n_terms), 0) as n_terms, coalesce(any_value(n_tokens), 0) as n_tokens from dt left join t using (lecture_id) group by 1""",
    "bm25_topk": f"with {_bm25_sql(m.PASSAGES_SQL, m.QUESTIONS_SQL)} select query_id, lecture_id, chunk_id, rank, round(score, 6) as score from (select *, {_RANK} as rank from sc) where rank <= {K}",
    "bm25_eval_full_rank": f"""with {_bm25_sql(m.PASSAGES_SQL, m.QUESTIONS_SQL)},
e as (select query_id, lecture_id, p.chunk_id, coalesce(score, 0.0) as score from {m.QUESTIONS_SQL} q join {m.PASSAGES_SQL} p using (lecture_id) left join sc using (query_id, lecture_id, chunk_id))
select query_id, lecture_id, chunk_id, {_RANK} as rank, round(score, 6) as score from e""",
    "dense_topk_filtered": f"with {_DENSE_SQL} select query_id, lecture_id, chunk_id, rank, round(score, 6) as score from dense",
    "rrf_hybrid": f"with {_DENSE_SQL}, {_LEG}, {_rrf_sql(['dense', 'leg'])}",
    "rrf_nway": f"""with {_DENSE_SQL}, {_LEG},
  third as (select * from (select query_id, v.chunk_id, 1.0::double as score, row_number() over (partition by query_id order by v.chunk_id) as rank from qv join {m.VECTORS_SQL} v on v.lecture_id = qv.lecture_id and v.label = qv.wanted) where rank <= {K}),
  {_rrf_sql(['dense', 'leg', 'third'])}""",
    "course_fanout": f"""with cq as (select item_id as course_query, n as nth, item_id * 10 + n as query_id, 'src' || ((item_id + n * 7) % 20) as lecture_id, text as query from benchmark, unnest(range(item_id % 3 + 2)) as u(n)),
{_bm25_sql(m.PASSAGES_SQL, "cq")},
top as (select * from (select *, {_RANK} as rank from sc) where rank <= 5),
one as (select * from (select course_query, nth, top.*, row_number() over (partition by course_query, top.lecture_id, chunk_id order by round(score, 9) desc, nth, rank) as n from top join cq using (query_id)) where n = 1)
select course_query, lecture_id, chunk_id, round(score, 6) as score, row_number() over (partition by course_query order by round(score, 9) desc, nth, rank) as position from one""",
}
