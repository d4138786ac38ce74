"""Queries that plan, fill contexts, validate, clean, sample and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions import text as X
from quillspan.operators import context as C
from quillspan.operators import datasets as D
from quillspan.operators import lexical
from quillspan.plans import mapping as m
from quillspan.plans.retrieval import _RANK, _bm25_sql

#: Questions of every kind, put to the planner.
ASKED = [
    "What are the prerequisites of paging?", "Explain how does caching relate to locality", "Summarize the lecture", "give an overview of virtual memory", "",
    "quiz me on paging", "Create a quiz for this lecture", "make flashcards", "notes please", "What is the difference between TCP and UDP?", "define entropy",
    "why is the sky blue", "which nodes are fully connected layers", "is the graph connected to the table", "learning path", "what was said about diagrams on this slide",
    "summarize lecture 3", "main ideas", "Compare heap vs. stack", "what does latency mean", "tell me about threads", "topics covered", "leads to overfitting", "prior section detail",
]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed questions, and every benchmark item."""
    fixed_ones = spark.createDataFrame([(-i - 1, q) for i, q in enumerate(ASKED)], "query_id long, query string")
    return fixed_ones.union(m.questions(spark, sf_dir).select("query_id", "query"))


def routing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.planned(_asked(spark, sf_dir))


ROUTES = ["graph+vector", "graph_only", "vector_only"]


def routing_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected (by the question's number) against planned routes, all nine cells."""
    p = C.planned(_asked(spark, sf_dir))
    want = F.element_at(F.array(*map(F.lit, ROUTES)), (F.pmod(F.col("query_id"), F.lit(3)) + 1).cast("int"))
    c = p.groupBy(want.alias("expected")).pivot("route", ROUTES).count().fillna(0)
    every = spark.createDataFrame([(r,) for r in ROUTES], "expected string").join(c, "expected", "left").fillna(0)
    return every.unpivot("expected", ROUTES, "route", "n").select("expected", "route", F.col("n").cast("long").alias("n"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical.best(m.passages(spark, sf_dir), m.questions(spark, sf_dir), 15)
    d = m.chunks(spark, sf_dir).select("lecture_id", "chunk_id", "ts", "text")
    return top.join(d, ["lecture_id", "chunk_id"]).select("query_id", F.col("chunk_id").alias("block_id"), "ts", F.round(C.block_score(F.lit(0.0), F.col("score")), 6).alias("score"), "text")


def context_budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each item within what 6000 characters leave beside graph lines."""
    f = C.filled(_blocks(spark, sf_dir), C.budgets(6000)[1])
    return f.select("query_id", "block_id", "position", "used", F.length("kept").alias("kept_chars"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


def noise_filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as on-screen text: markup off, URLs and handles out, noise marked."""
    p = m.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("t"))
    clean = X.sanitize_ocr(F.col("t"))
    return p.select("page_id", F.length(clean).alias("chars"), X.is_ocr_noise(clean).alias("noise"), X.is_ocr_noise(F.substring(clean, 1, 12)).alias("noise_head"))


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several tables that break a rule, by rule."""
    d = m.table(spark, sf_dir, "documents")
    a = m.atoms(spark, sf_dir)
    li = m.table(spark, sf_dir, "lineitem")
    out = D.violations(d, "doc_id", {"text_blank": F.trim("text") != "", "n_chars": F.col("n_chars") == F.length("text"), "short": F.length("text") >= 100})
    out = out.union(D.violations(a, "lecture_id", {"end_after_start": F.col("end") > F.col("start"), "start_positive": F.col("start") >= 0}))
    out = out.union(D.violations(li, "l_orderkey", {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1}))
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_key").alias("keys"))


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: m.table(spark, sf_dir, n)
    out = D.orphans(t("labels"), "doc_id", t("documents"), "doc_id", "labels.doc_id").union(D.orphans(t("embeddings"), "vec_id", t("documents"), "doc_id", "embeddings.vec_id"))
    out = out.union(D.orphans(t("documents"), "doc_id", t("labels"), "doc_id", "documents.unlabelled")).union(D.orphans(t("lineitem").select("l_orderkey"), "l_orderkey", t("orders"), "o_orderkey", "lineitem.order"))
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows"))


def dedupe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and first words as extracted names: clauses dropped, the first of each name kept."""
    d = m.table(spark, sf_dir, "documents").filter("text is not null")
    w = F.split("text", "\\s+")
    names = F.array(F.get(w, F.lit(0)), F.array_join(F.slice(w, 1, 2), " "), F.get(F.split("text", "\\n"), F.lit(0)))
    e = d.select("doc_id", F.posexplode(names).alias("pos", "name")).filter("name is not null")
    e = e.filter(~X.is_fragment(F.col("name"))).withColumn("norm", F.lower(F.trim("name")))
    return D.keep_first(e, ["norm"], ["doc_id", "pos"]).select("norm", "name", "doc_id", "pos")


def _triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each good document of a source a bad one of the same source, both by hash order."""
    d = m.table(spark, sf_dir, "documents").join(m.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "text")
    order = D.hash_order("t42", F.col("doc_id"))
    w = Window.partitionBy("source", "quality").orderBy(order, "doc_id")
    d = d.withColumn("nth", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source", "quality")))
    pos = d.filter("quality = 1").select("source", F.col("doc_id").alias("positive"), "text", "nth")
    neg = d.filter("quality = 0").select("source", F.col("doc_id").alias("negative"), F.col("nth").alias("k"), F.col("n").alias("n_neg"))
    sizes = neg.select("source", "n_neg").distinct()
    return pos.join(sizes, "source").withColumn("k", F.col("nth") % F.col("n_neg")).join(neg.drop("n_neg"), ["source", "k"]).select("source", "positive", "negative", F.col("text").alias("query"))


def triplet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triplets(spark, sf_dir).select("source", "positive", "negative")


def dedupe_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets by the hash of their texts: one of each, with the number of sources it came from."""
    t = _triplets(spark, sf_dir).withColumn("hash", F.sha1(F.concat_ws("|", F.lower("query"), F.col("negative").cast("string")).cast("binary")))
    return t.groupBy("hash").agg(F.min("positive").alias("positive"), F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group_split(m.table(spark, sf_dir, "documents"), "source", 0.2, "split-7")


def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70, 15 and 15 of 100 conversations by place."""
    c = m.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = D.placed(c, "conv_id")
    return c.select("conv_id", F.when(F.col("place") < F.floor(F.col("places") * 0.7), "train").when(F.col("place") < F.floor(F.col("places") * 0.85), "dev").otherwise("test").alias("split"))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source in hash order: the operator's own limit."""
    return D.balanced(m.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3, "smoke", "doc_id")


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a model would write them: whole, fenced, with a stray backslash, cut off, or no array."""
    e = m.table(spark, sf_dir, "events").select("event_id", "props")
    raw = F.element_at(F.array(F.concat(F.lit("["), "props", F.lit("]")), F.concat(F.lit("```json\n["), "props", F.lit("]\n```")), F.concat(F.lit('[{"a":"\\d"},'), "props", F.lit("]")), F.concat(F.lit("["), "props", F.lit(',{"k":')), F.lit("nothing")), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", D.json_repair(raw).alias("r")).select("event_id", "r.status", F.size("r.items").alias("items"))


def entity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of part names: clauses, length, generic words, repeated names."""
    e = m.entities(spark, sf_dir).withColumn("norm", X.cluster_name(F.col("name")))
    e = e.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("norm")))
    generic = F.exists(F.split("norm", " "), lambda w: w.isin(fixed.GENERIC_NAMES))
    flags = F.array(F.when(X.is_fragment(F.col("name")), "FRAGMENT"), F.when((F.size(F.split("name", " ")) > 6) | (F.length("name") > 45), "EXCESSIVE_LENGTH"), F.when(generic, "GENERIC"), F.when(F.col("same") > 1, "DUPLICATE"))
    return e.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sorted into outcomes by ordered rules."""
    e = m.table(spark, sf_dir, "events")
    k = F.when((F.col("event_type") == "error") & (F.col("value") > 50), "lost_after_retrieval").when(F.col("event_type") == "error", "retrieval_miss").when(F.col("value") < 5, "refused_with_evidence").otherwise("ok")
    return e.groupBy(k.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def benchmark_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release rules of the benchmark, and whether it meets them."""
    b = m.table(spark, sf_dir, "benchmark")
    norm = X.normalize_name(F.coalesce("text", F.lit("")))
    s = b.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(norm).alias("d"), F.countDistinct(F.col("item_id") % 20).alias("l"))
    rule = lambda name, met: F.struct(F.lit(name).alias("rule"), met.alias("met"))
    rules = F.array(rule("at_least_100", F.col("n") >= 100), rule("distinct_queries", F.col("n") == F.col("d")), rule("two_lectures", F.col("l") >= 2))
    return s.select(F.explode(rules).alias("r")).select("r.rule", "r.met")


def timestamp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.chunks(spark, sf_dir).select("chunk_id", X.timestamp_text(F.col("ts")).alias("label"))


def ext_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events of each type in windows of six hours."""
    from quillspan.streaming.windows import tumbling

    e = m.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = tumbling(e, "ts", "6 hours", ["event_type"])
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: documents by every combination of source and language."""
    d = m.table(spark, sf_dir, "documents")
    return d.cube("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _any(q: str, patterns: list[str]) -> str:
    return " or ".join(f"regexp_matches({q}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns)


def _sum(q: str, patterns: list[str]) -> str:
    parts = []
    for p in patterns:
        if p.startswith("(?<!"):  # no look-behind here: the excluded phrases are taken out first
            q2 = f"regexp_replace({q}, 'fully[\\s-]connect(s|ed|ing|ion|ions)?\\b', ' ', 'g')"
            parts.append(f"case when regexp_matches({q2}, '\\bconnect(s|ed|ing|ion|ions)?\\b') then 1 else 0 end")
        else:
            parts.append(f"case when regexp_matches({q}, '{p.replace(chr(39), chr(39) * 2)}') then 1 else 0 end")
    return " + ".join(parts)


_KINDS = [(fixed.LEARNING_PATH_PATTERNS, "learning_path", "true", "structured"), (fixed.QUIZ_PATTERNS, "quiz", "true", "structured"), (fixed.FLASHCARD_PATTERNS, "flashcards", "true", "structured"), (fixed.NOTES_PATTERNS, "notes", "true", "structured"), (fixed.SUMMARY_PATTERNS, "summary", "true", "detailed"), (fixed.COMPARISON_PATTERNS, "comparison", "false", "comparative"), (fixed.DEFINITION_PATTERNS, "definition", "false", "concise"), (fixed.REASONING_PATTERNS, "reasoning", "false", "detailed")]
_CASE = lambda i: " ".join(f"when {_any('q', k[0])} then " + ("'" + k[i] + "'" if k[i] not in ("true", "false") else k[i]) for k in _KINDS)
_PLANNED = f"""asked(query_id, query) as (values {', '.join(f"({-i - 1}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(ASKED))}),
a as (select query_id, lower(coalesce(query, '')) as q from (select * from asked union all select item_id, text from benchmark)),
s as materialized (select query_id, q, {_sum('q', fixed.GRAPH_PATTERNS)} as g, {_sum('q', fixed.VECTOR_PATTERNS)} as v from a),
k as (select *, case when trim(q) = '' then 'factual_qa' {_CASE(1)} when g > 0 and v > 0 then 'conceptual' else 'factual_qa' end as intent, case when trim(q) = '' then 'concise' {_CASE(3)} when g > 0 and v > 0 then 'detailed' else 'concise' end as style,
 case when trim(q) = '' then false {_CASE(2)} else false end and len(list_filter(regexp_extract_all(q, '[a-z0-9]+'), lambda t: not list_contains([{', '.join(repr(w) for w in fixed.SCOPE_WORDS)}], t) and not regexp_full_match(t, '[0-9]+'))) = 0 as wide from s),
planned as (select query_id, case when trim(q) = '' then 'vector_only' when g > 0 and v > 0 then 'graph+vector' when g > 0 then 'graph_only' else 'vector_only' end as route, intent, wide as is_lecture_wide, style as answer_style,
 floor(g / greatest(g + v, 1)::double * 100 + 0.5) / 100 as graph_weight, case when wide then 3 else 2 end as graph_depth, case when trim(q) = '' then 5 else 15 end as top_k, case when trim(q) = '' then 4000 else 6000 end as context_budget, {_any('q', fixed.VISUAL_PATTERNS)} as need_visual from k)"""
_FRAG = f"""(trim(name) = '' or (regexp_matches(trim(name), '[.!?]\\s|\\.$') and not ({' or '.join(f"ends_with(trim(name), '{e}')" for e in fixed.ABBREVIATION_ENDS)})) or regexp_matches(lower(trim(name)), '^({'|'.join(fixed.FRAGMENT_OPENERS)})\\b') or regexp_matches(trim(name), '\\s[;—]\\s') or len(regexp_split_to_array(trim(name), '\\s+')) > 12)"""
_TRIP = """d as (select doc_id, source, quality, text, md5('t42:' || doc_id) as h from documents join labels using (doc_id)),
n as (select *, row_number() over (partition by source, quality order by h, doc_id) - 1 as nth, count(*) over (partition by source, quality) as n from d),
trip as (select p.source, p.doc_id as positive, q.doc_id as negative, p.text as query from n p join n q on p.source = q.source and q.quality = 0 and q.nth = p.nth % q.n where p.quality = 1)"""
_NOISE = lambda t: f"(trim({t}) = '' or (len(regexp_split_to_array(trim({t}), '\\s+')) < 5 and not regexp_matches({t}, '[A-Za-z]')) or {_any(t, fixed.NOISE_PATTERNS)})"

QUERIES = {f.__name__: f for f in (routing_plan, routing_confusion, context_budget_fill, noise_filter_pages, schema_violations, fk_violations, dedupe_entities, triplet_pairs, dedupe_triplets, group_split, positional_split, balanced_sample, json_repair, entity_audit, error_taxonomy, benchmark_profile, timestamp_labels, ext_event_windows, ext_cube)}
ORACLES = {
    "routing_plan": f"with {_PLANNED} select * from planned",
    "routing_confusion": f"""with {_PLANNED}, r(x) as (values {', '.join(f"('{x}')" for x in ROUTES)}), c as (select {ROUTES!r}[((query_id % 3 + 3) % 3 + 1)::int] as expected, route, count(*) as n from planned group by 1, 2)
select e.x as expected, r.x as route, coalesce(n, 0) as n from r e cross join r left join c on c.expected = e.x and c.route = r.x""",
    "context_budget_fill": f"""with {_bm25_sql(m.PASSAGES_SQL, m.QUESTIONS_SQL)}, top as (select * from (select *, {_RANK} as rank from sc) where rank <= 15),
b0 as (select query_id, chunk_id as block_id, c.ts, round(score, 6) as score, c.text from top join {m.CHUNKS_SQL} c using (lecture_id, chunk_id)),
b as (select * from (select *, row_number() over (partition by query_id, text order by score desc, block_id) as o from b0) where o = 1),
u as (select *, (sum(length(text) + 7) over (partition by query_id order by score desc, block_id rows unbounded preceding))::bigint as used, row_number() over (partition by query_id order by score desc, block_id) as r from b),
k0 as (select *, {C.budgets(6000)[1]} as budget from u where used <= {C.budgets(6000)[1]} or r = 1),
k as (select *, left(text, budget - 7) as head, instr(reverse(left(text, budget - 7)), ' .') as cut from k0),
f as (select *, case when used <= budget or length(text) <= budget - 7 then text when cut > 0 and length(head) - cut - 1 > (budget - 7) // 2 then left(head, length(head) - cut) else head end as kept from k)
select query_id, block_id, row_number() over (partition by query_id order by ts, block_id) as position, used, length(kept) as kept_chars, md5(kept) as kept_md5 from f""",
    "noise_filter_pages": f"""with t as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as t from pages), c as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?:https?://|www\\.)\\S+', ' ', 'g'), '\\b@[A-Za-z0-9_]+\\b', ' ', 'g'), '\\s+', ' ', 'g')) as c from t),
h as (select *, substr(c, 1, 12) as h from c) select page_id, length(c) as chars, {_NOISE('c')} as noise, {_NOISE('h')} as noise_head from h""",
    "schema_violations": f"""with a as (select * from {m.ATOMS_SQL}), v as (
select 'text_blank' as rule_id, doc_id::varchar as k from documents where not coalesce(trim(text) <> '', false) union all select 'n_chars', doc_id::varchar from documents where not coalesce(n_chars = length(text), false) union all select 'short', doc_id::varchar from documents where not coalesce(length(text) >= 100, false)
union all select 'end_after_start', lecture_id::varchar from a where not coalesce("end" > start, false) union all select 'start_positive', lecture_id::varchar from a where not coalesce(start >= 0, false)
union all select 'quantity', l_orderkey::varchar from lineitem where not coalesce(l_quantity <= 45, false) union all select 'discount', l_orderkey::varchar from lineitem where not coalesce(l_discount < 0.1::double, false))
select rule_id, count(*) as rows, count(distinct k) as keys from v group by 1""",
    "fk_violations": """with v as (select 'labels.doc_id' as rule_id from labels where doc_id not in (select doc_id from documents) union all select 'embeddings.vec_id' from embeddings where vec_id not in (select doc_id from documents)
union all select 'documents.unlabelled' from documents where doc_id not in (select doc_id from labels) union all select 'lineitem.order' from lineitem where l_orderkey not in (select o_orderkey from orders)) select rule_id, count(*) as rows from v group by 1""",
    "dedupe_entities": f"""with w as (select doc_id, text, regexp_split_to_array(text, '\\s+') as w from documents where text is not null),
e as (select doc_id, p as pos, case p when 0 then w[1] when 1 then array_to_string(w[1:2], ' ') else string_split(text, chr(10))[1] end as name from w, unnest(range(3)) u(p)),
f as (select *, lower(trim(name)) as norm from e where name is not null and not {_FRAG})
select norm, name, doc_id, pos from (select *, row_number() over (partition by norm order by doc_id, pos) as n from f) where n = 1""",
    "triplet_pairs": f"with {_TRIP} select source, positive, negative from trip",
    "dedupe_triplets": f"with {_TRIP} select sha1(lower(query) || '|' || negative) as hash, min(positive) as positive, count(*) as n, count(distinct source) as sources from trip group by 1",
    "group_split": """with g as (select source, count(*) as n from documents group by 1), o as (select *, coalesce(sum(n) over (order by md5('split-7:' || source), source rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total, count(*) over () as groups from g)
select source, n, case when before < total * 0.2::double and groups > 1 then 'dev' else 'train' end as split from o""",
    "positional_split": "with c as (select conv_id, row_number() over (order by conv_id) - 1 as i, count(*) over () as n from (select distinct conv_id from conversations)) select conv_id, case when i < floor(n * 0.7::double) then 'train' when i < floor(n * 0.85::double) then 'dev' else 'test' end as split from c",
    "balanced_sample": "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('smoke:' || doc_id), doc_id) as n from documents) where n <= 3",
    "entity_audit": f"""with e as (select p_name as name, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[-_]+', ' ', 'g'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) as norm from part), f as (select *, count(*) over (partition by norm) as same from e),
i as (select 'FRAGMENT' as issue from f where {_FRAG} union all select 'EXCESSIVE_LENGTH' from f where len(string_split(name, ' ')) > 6 or length(name) > 45 union all select 'GENERIC' from f where list_has_any(string_split(norm, ' '), [{', '.join(repr(w) for w in fixed.GENERIC_NAMES)}]) union all select 'DUPLICATE' from f where same > 1)
select issue, count(*) as n from i group by 1""",
    "error_taxonomy": "select case when event_type = 'error' and value > 50 then 'lost_after_retrieval' when event_type = 'error' then 'retrieval_miss' when value < 5 then 'refused_with_evidence' else 'ok' end as outcome, count(*) as n, round(avg(value), 6) as mean from events group by 1",
    "benchmark_profile": "with s as (select count(*) as n, count(distinct trim(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) as d, count(distinct item_id % 20) as l from benchmark) select 'at_least_100' as rule, n >= 100 as met from s union all select 'distinct_queries', n = d from s union all select 'two_lectures', l >= 2 from s",
    "timestamp_labels": f"select chunk_id, printf('%02d:%02d:%02d', floor(ts)::bigint // 3600, floor(ts)::bigint % 3600 // 60, floor(ts)::bigint % 60) as label from {m.CHUNKS_SQL}",
    "ext_event_windows": "select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "ext_cube": "select source, lang, count(*) as n, sum(length(text)) as chars from documents group by cube (source, lang)",
}
