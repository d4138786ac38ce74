"""Evaluation queries: gold passages, retrieval and answer metrics, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.fixed import ANSWER_STOPWORDS
from quillspan.operators import lexical, metrics
from quillspan.operators.containment import contained
from quillspan.plans import mapping as m
from quillspan.plans.retrieval import _RANK, _bm25_sql

K = 15


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, chunk_id of the documents that contain an item's text.

    The second to sixth words of an item stand as whole words in any document that
    contains it, so pairs are found by an equal run of five words and then tested;
    items of under seven words are looked for by their rarest run of characters.  An empty item has no passage.
    """
    b = m.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).filter("item is not null")
    words = F.split("item", "\\s+")
    b = b.withColumn("key", F.when(F.size(words) >= 7, F.xxhash64(F.array_join(F.slice(words, 2, 5), " "))))
    d = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").filter("text is not null")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 4)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 5), " ")))
    keys = d.select("chunk_id", F.explode(F.array_distinct(F.transform(F.array(F.split("text", "\\s+")), runs)[0])).alias("key"))
    near = keys.join(b.filter("key is not null"), "key").join(d, "chunk_id").filter(F.contains("text", "item"))
    few = contained(d.withColumnRenamed("chunk_id", "text_id"), b.filter("key is null").select(F.col("item").alias("name")))
    short = few.join(b.withColumnRenamed("item", "name"), "name").select("query_id", F.col("text_id").alias("chunk_id"))
    return near.select("query_id", "chunk_id").union(short).distinct()


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: expected and retrieved ids (BM25 over all documents), scores, and the best passage."""
    d = m.passages(spark, sf_dir).withColumn("lecture_id", F.lit("all"))
    q = m.questions(spark, sf_dir).withColumn("lecture_id", F.lit("all"))
    top = lexical.best(d, q, K)
    lists = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("_t"))
    lists = lists.select("query_id", F.col("_t.chunk_id").alias("retrieved"), F.col("_t.score").alias("scores"))
    expected = gold(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("expected"))
    s = q.select("query_id", "query").join(expected, "query_id", "left").join(lists, "query_id", "left")
    none = F.array().cast("array<bigint>")
    return s.withColumns({"expected": F.coalesce("expected", none), "retrieved": F.coalesce("retrieved", none), "scores": F.coalesce("scores", F.array().cast("array<double>"))})


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    e, r = F.col("expected"), F.col("retrieved")
    return s.select(
        "query_id",
        (F.size(e) > 0).alias("answerable"),
        metrics.precision_at(e, r, 5).alias("precision_5"),
        metrics.r_precision(e, r).alias("r_precision"),
        metrics.recall_at(e, r, 5).alias("recall_5"),
        metrics.hit_at(e, r, 5).alias("hit_5"),
        metrics.reciprocal_rank(e, r, 5).alias("mrr_5"),
        metrics.ndcg_at(e, r, 10).alias("ndcg_10"),
        metrics.context_recall(e, r).alias("context_recall"),
    )


METRICS = ["precision_5", "r_precision", "recall_5", "hit_5", "mrr_5", "ndcg_10", "context_recall"]


def ir_metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _measured(spark, sf_dir)
    return r.select("query_id", "answerable", *[F.round(c, 6).alias(c) for c in METRICS])


def ir_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over answerable items; the others' metrics are null and left out."""
    r = _measured(spark, sf_dir)
    s = metrics.summary(r.select(*[F.when(F.col("answerable"), F.col(c)).alias(c) for c in METRICS]), METRICS)
    return s.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "least", "most")], "n")


def metric_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by question type and, apart, by difficulty."""
    r = _measured(spark, sf_dir).filter("answerable")
    r = r.withColumn("question_type", F.element_at(F.array(*map(F.lit, ["factual", "conceptual", "reasoning"])), (F.col("query_id") % 3 + 1).cast("int")))
    r = r.withColumn("difficulty", F.element_at(F.array(*map(F.lit, ["easy", "medium", "hard"])), (F.floor(F.col("query_id") / 3) % 3 + 1).cast("int")))
    g = r.groupingSets([["question_type"], ["difficulty"]], "question_type", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit_5"), 6).alias("hit_5"), F.round(F.avg("mrr_5"), 6).alias("mrr_5"))
    return g.select("question_type", "difficulty", "n", "hit_5", "mrr_5")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation as the truth, the next one as the answer."""
    c = m.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("answer is not null")


def answer_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1(F.col("text"), F.col("answer")), 6).alias("f1"))


def lexical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(metrics.lexical_jaccard(F.col("text"), F.col("answer")), 6).alias("jaccard"))


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords: the first, third and fifth word of the truth, and its second and third together."""
    a = _answers(spark, sf_dir)
    w = F.split("text", " ")
    at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    kws = F.array(at(0), at(2), at(4), F.concat_ws(" ", at(1), at(2)))
    return a.select("conv_id", "turn", F.round(metrics.keyword_recall(kws, F.col("answer")), 6).alias("recall"))


def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations: the odd places of the ranking; context: its first eight."""
    s = _samples(spark, sf_dir)
    cited = F.filter(F.col("retrieved"), lambda x, i: i % 2 == 0)
    context = F.slice("retrieved", 1, 8)
    return s.select(
        "query_id",
        F.round(metrics.citation_coverage(F.col("expected"), cited), 6).alias("coverage"),
        F.round(metrics.citation_precision(cited, context), 6).alias("provenance"),
        F.size(F.array_distinct(cited)).cast("long").alias("citations"),
        F.round(metrics.chunk_coverage(cited, F.col("retrieved")), 6).alias("chunk_coverage"),
    )


def pairwise_triplet_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good against bad documents of a source, scored by length: accuracy, margin and MRR of pairs by language."""
    d = m.table(spark, sf_dir, "documents").join(m.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "quality", F.log(F.length("text") + 1.0).alias("score"))
    w = Window.partitionBy("source", "lang", "quality").orderBy("doc_id")
    d = d.withColumn("nth", F.row_number().over(w))
    p = d.filter("quality = 1").select("source", "lang", "nth", F.col("score").alias("pos"))
    n = d.filter("quality = 0").select("source", "lang", "nth", F.col("score").alias("neg"))
    t = p.join(n, ["source", "lang", "nth"]).withColumn("rank", F.when(F.col("pos") >= F.col("neg"), 1).otherwise(2))
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.round(F.avg(F.col("pos") - F.col("neg")), 6).alias("margin"),
        F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"),
        F.round(F.avg(1.0 / F.log2(F.col("rank") + 1.0)), 6).alias("ndcg"),
    )


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as latencies: nearest-rank percentiles, throughput over the span of time, error rate."""
    e = m.table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    span = F.greatest(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")), F.lit(1))
    p = lambda q: F.round(F.expr(f"percentile_disc({q}) within group (order by value)"), 6)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.count(F.lit(1)) / span, 9).alias("per_second"), F.round(F.avg(F.when(F.col("value") > 90, 1.0).otherwise(0.0)), 6).alias("error_rate"))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each item (all documents, and those of its lecture): how often one's best score is better."""
    one = lexical.best(m.passages(spark, sf_dir).withColumn("lecture_id", F.lit("all")), m.questions(spark, sf_dir).withColumn("lecture_id", F.lit("all")), 1)
    two = lexical.best(m.passages(spark, sf_dir), m.questions(spark, sf_dir), 1)
    both = one.select("query_id", F.col("score").alias("a")).join(two.select("query_id", F.col("score").alias("b")), "query_id", "full")
    diff = F.round(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 6)
    return both.select(F.when(diff > 0, "better").when(diff < 0, "worse").otherwise("same").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def timeline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the chunks of a lecture that mention a lecture's most frequent word: the span of time and tenths that they cover."""
    c = m.chunks(spark, sf_dir)
    length = c.groupBy("lecture_id").agg(F.max("ts").alias("duration"))
    hit = c.filter(F.col("text").rlike("(?i)the")).join(length, "lecture_id").filter("duration > 0")
    tenth = F.least(F.lit(9), F.floor(10 * F.col("ts") / F.col("duration")))
    return hit.groupBy("lecture_id").agg(F.round((F.max("ts") - F.min("ts")) / F.max("duration"), 6).alias("span"), F.countDistinct(tenth).alias("tenths"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the mean MRR by 10,000 Poisson resamples: each row's weight in a resample follows from a hash, so nothing is drawn twice differently."""
    r = _measured(spark, sf_dir).filter("answerable").select("query_id", "mrr_5")
    b = r.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(9999))))
    u = F.pmod(F.xxhash64("query_id", "sample", F.lit("boot")), F.lit(1 << 40)) / float(1 << 40)
    edges, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += p
        edges.append(total)
        p /= k + 1
    weight = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    means = b.withColumn("w", weight).groupBy("sample").agg((F.sum(F.col("w") * F.col("mrr_5")) / F.greatest(F.sum("w"), F.lit(1))).alias("mean"))
    q = lambda x: F.round(F.expr(f"percentile_disc({x}) within group (order by mean)"), 6)
    return means.agg(q(0.025).alias("low"), F.round(F.avg("mean"), 6).alias("mean"), q(0.975).alias("high"))


_ALL_DOCS = "(select 'all' as lecture_id, doc_id as chunk_id, text from documents)"
_ALL_Q = "(select item_id as query_id, 'all' as lecture_id, text as query from benchmark)"
_SAMPLES = f"""{_bm25_sql(_ALL_DOCS, _ALL_Q)},
  top as materialized (select * from (select *, {_RANK} as rank from sc) where rank <= {K}),
  gold as materialized (select item_id as query_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text) and b.text <> ''),
  ne as (select query_id, count(*) as n_gold from gold group by 1),
  nr as (select query_id, count(*) as n_ret from top group by 1),
  hits as materialized (select query_id, rank from top join gold using (query_id, chunk_id)),
  base as (select item_id as query_id, coalesce(n_gold, 0) as n_gold, coalesce(n_ret, 0) as n_ret from benchmark left join ne on ne.query_id = item_id left join nr on nr.query_id = item_id)"""
_MEASURED = f"""{_SAMPLES},
  h as (select base.query_id, n_gold, n_ret, count(*) filter (rank <= 5) as h5, count(rank) as h15, count(*) filter (rank <= n_gold) as hr, min(rank) filter (rank <= 5) as r5,
          coalesce(sum(1.0::double / log2(rank + 1)) filter (rank <= 10), 0.0) as dcg from base left join hits using (query_id) group by all),
  measured as (select query_id, n_gold > 0 as answerable,
    case when n_gold = 0 or n_ret = 0 then 0.0::double else h5 / 5.0::double end as precision_5,
    case when n_gold = 0 or n_ret = 0 then 0.0::double else hr / n_gold::double end as r_precision,
    case when n_gold = 0 then 1.0::double when n_ret = 0 then 0.0 else h5 / n_gold::double end as recall_5,
    case when n_gold = 0 then 1.0::double when n_ret = 0 or h5 = 0 then 0.0 else 1.0 end as hit_5,
    case when n_gold = 0 or n_ret = 0 or r5 is null then 0.0::double else 1.0::double / r5 end as mrr_5,
    case when n_gold = 0 then 1.0::double when n_ret = 0 then 0.0 else dcg / (select sum(1.0::double / log2(i + 1)) from range(1, least(n_gold, 10) + 1) t(i)) end as ndcg_10,
    case when n_gold = 0 then 1.0::double when n_ret = 0 then 0.0 else h15 / n_gold::double end as context_recall from h)"""
_ANSWERS = "(select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as answer from conversations)"
_WT = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


def _stem_sql(w: str) -> str:
    cut = lambda k: f"left({w}, length({w}) - {k})"
    kept = " or ".join(f"{cut(2)} like '%{e}'" for e in ("e", "s", "x", "z", "ch", "sh"))
    return f"case when length({w}) <= 3 then {w} when {w} like '%ies' then {cut(3)} || 'y' when {w} like '%tions' then {cut(5)} when {w} like '%tion' then {cut(4)} when {w} like '%ing' then {cut(3)} when {w} like '%ed' then {cut(2)} when {w} like '%es' then case when {kept} then {cut(2)} else {cut(2)} || 'e' end when {w} like '%s' and {w} not like '%ss' then {cut(1)} else {w} end"


def _stems_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in ANSWER_STOPWORDS)
    return f"list_distinct(list_transform(list_filter({_WT.format(text)}, lambda t: length(t) >= 2 and not list_contains([{stop}], t)), lambda t: {_stem_sql('t')}))"


QUERIES = {f.__name__: f for f in (ir_metrics_per_query, ir_metrics_summary, metric_breakdowns, answer_token_f1, lexical_jaccard, keyword_recall, citation_metrics, pairwise_triplet_metrics, latency_percentiles, run_comparison, timeline_coverage, bootstrap_ci)}
_UNION = " union all ".join(f"select '{c}' as metric, {c} as value from measured where answerable" for c in METRICS)
ORACLES = {
    "ir_metrics_per_query": f"with {_MEASURED} select query_id, answerable, {', '.join(f'round({c}, 6) as {c}' for c in METRICS)} from measured",
    "ir_metrics_summary": f"with {_MEASURED}, l as ({_UNION}) select metric, round(avg(value), 6) as mean, round(quantile_disc(value, 0.95), 6) as p95, round(min(value), 6) as least, round(max(value), 6) as most, count(*) as n from l group by 1",
    "metric_breakdowns": f"""with {_MEASURED}, r as (select *, ['factual', 'conceptual', 'reasoning'][query_id % 3 + 1] as question_type, ['easy', 'medium', 'hard'][(query_id // 3) % 3 + 1] as difficulty from measured where answerable)
select question_type, null as difficulty, count(*) as n, round(avg(hit_5), 6) as hit_5, round(avg(mrr_5), 6) as mrr_5 from r group by 1
union all select null, difficulty, count(*), round(avg(hit_5), 6), round(avg(mrr_5), 6) from r group by difficulty""",
    "answer_token_f1": f"""with p as (select conv_id, turn, {_WT.format('text')} as a, {_WT.format('answer')} as b from {_ANSWERS} where answer is not null),
a as (select conv_id, turn, t, count(*) as n from p, unnest(a) u(t) group by all), b as (select conv_id, turn, t, count(*) as n from p, unnest(b) u(t) group by all),
c as (select conv_id, turn, sum(least(a.n, b.n)) as c from a join b using (conv_id, turn, t) group by 1, 2)
select conv_id, turn, round(case when coalesce(c, 0) = 0 then 0.0::double else 2.0::double * c / (len(a) + len(b)) end, 6) as f1 from p left join c using (conv_id, turn)""",
    "lexical_jaccard": f"""with p as materialized (select conv_id, turn, {_stems_sql("coalesce(text, '')")} as a, {_stems_sql('answer')} as b from {_ANSWERS} where answer is not null)
select conv_id, turn, round(case when len(a) = 0 and len(b) = 0 then 1.0::double when len(a) = 0 or len(b) = 0 then 0.0::double else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from p""",
    "keyword_recall": f"""with p as (select conv_id, turn, string_split(text, ' ') as w, lower(answer) as a, {_WT.format('answer')} as own from {_ANSWERS} where answer is not null),
q as (select conv_id, turn, a, own, unnest([coalesce(w[1], ''), coalesce(w[3], ''), coalesce(w[5], ''), concat_ws(' ', coalesce(w[2], ''), coalesce(w[4 - 1], ''))]) as kw from p),
r as (select *, lower(kw) as low, list_filter({_WT.format('kw')}, lambda t: not list_contains([{', '.join(repr(w) for w in ANSWER_STOPWORDS)}], t)) as parts from q),
h as (select *, kw <> '' and a <> '' and (contains(a, low) or (len(parts) > 0 and len(list_filter(parts, lambda t: list_contains(own, t) or contains(a, {_stem_sql('t')}))) = len(parts)) or (low like '%s' and contains(a, left(low, length(low) - 1))) or contains(a, low || 's')) as hit from r)
select conv_id, turn, round(count(*) filter (hit) / 4.0::double, 6) as recall from h group by 1, 2""",
    "citation_metrics": f"""with {_SAMPLES}, c as (select query_id, count(*) filter (rank % 2 = 1) as cited, count(*) filter (rank % 2 = 1 and rank <= 8) as backed from top group by 1),
g as (select query_id, count(*) filter (rank % 2 = 1) as hit from hits group by 1)
select query_id, round(case when n_gold = 0 then 1.0::double when coalesce(cited, 0) = 0 then 0.0 else coalesce(hit, 0) / n_gold::double end, 6) as coverage,
 round(case when coalesce(cited, 0) = 0 then 1.0::double else backed / cited::double end, 6) as provenance, coalesce(cited, 0)::bigint as citations,
 round(case when n_ret = 0 then 1.0::double else cited / n_ret::double end, 6) as chunk_coverage from base left join c using (query_id) left join g using (query_id)""",
    "pairwise_triplet_metrics": """with d as (select doc_id, source, lang, quality, ln(length(text) + 1.0::double) as score, row_number() over (partition by source, lang, quality order by doc_id) as nth from documents join labels using (doc_id)),
t as (select p.lang, p.score as pos, n.score as neg, case when p.score >= n.score then 1 else 2 end as rank from d p join d n using (source, lang, nth) where p.quality = 1 and n.quality = 0)
select lang, count(*) as pairs, round(avg(case when rank = 1 then 1.0::double else 0.0 end), 6) as accuracy, round(avg(pos - neg), 6) as margin, round(avg(1.0::double / rank), 6) as mrr, round(avg(1.0::double / log2(rank + 1)), 6) as ndcg from t group by 1""",
    "latency_percentiles": """select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95, round(quantile_disc(value, 0.99), 6) as p99,
round(count(*) / greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 1)::double, 9) as per_second, round(avg(case when value > 90 then 1.0::double else 0.0 end), 6) as error_rate from events group by 1""",
    "run_comparison": f"""with one as (with {_bm25_sql(_ALL_DOCS, _ALL_Q)} select query_id, max(score) as a from sc group by 1), two as (with {_bm25_sql(m.PASSAGES_SQL, m.QUESTIONS_SQL)} select query_id, max(score) as b from sc group by 1),
d as (select round(coalesce(a, 0) - coalesce(b, 0), 6) as x from one full join two using (query_id))
select case when x > 0 then 'better' when x < 0 then 'worse' else 'same' end as outcome, count(*) as n from d group by 1""",
    "timeline_coverage": f"""with c as (select * from {m.CHUNKS_SQL}), l as (select lecture_id, max(ts) as duration from c group by 1)
select lecture_id, round((max(ts) - min(ts)) / max(duration), 6) as span, count(distinct least(9, floor(10 * ts / duration))) as tenths from c join l using (lecture_id) where duration > 0 and regexp_matches(text, '(?i)the') group by 1""",
}
