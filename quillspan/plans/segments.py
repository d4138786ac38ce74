"""Queries over texts of segments and over ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import segments as S
from quillspan.plans import mapping as m


def written_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as titles that a model wrote, with label, marks and quotes."""
    c = m.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.written_title(F.concat(F.lit("\"Caption 2: ## "), "text", F.lit(".\""))).alias("title"))


def repetitive_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, and names of parts said five times over, that are noise."""
    c = m.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    p = m.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(5)).alias("text"))
    return c.union(p).select("id", S.is_repetitive(F.col("text")).alias("noise"))


def rendered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what was said, read and seen; odd ids have text on the slide."""
    c = m.chunks(spark, sf_dir)
    ocr = F.when(F.col("chunk_id") % 2 == 1, F.concat(F.lit(" "), "lecture_id"))
    seen = F.concat(F.lit("### Educational  Slide Description\n"), "lecture_id", F.lit("\n\n\n\nx\n#### Background - blue grid"))
    return c.select("chunk_id", F.md5(S.rendered(F.col("chunk_id"), F.col("ts"), F.col("text"), ocr, seen)).alias("rendered"))


def caption_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = m.entities(spark, sf_dir)
    caption = F.concat(F.translate("name", " ", ","), F.lit("; a\n"), F.upper("type"), F.lit(", "), "name")
    return p.select("entity_id", F.array_join(S.caption_objects(caption), "|").alias("objects"))


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in four plurals."""
    plural = F.element_at(F.array(*map(F.lit, ["s", "ies", "ses", "ss"])), (F.col("entity_id") % 4 + 1).cast("int"))
    return m.entities(spark, sf_dir).select("entity_id", F.array_join(S.name_variants(F.concat("name", plural)), "|").alias("variants"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user asks, their events are what was found, in order of ids; purchases are relevant."""
    e = m.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("arrival"), F.when(F.col("event_type") != "error", F.col("value")).alias("score"), (F.col("event_type") == "purchase").alias("relevant"))


def ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked_scores(_ranked(spark, sf_dir))


def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a value from 20 on are in the pool, from 60 on in the context; every third user's answer refuses."""
    r = _ranked(spark, sf_dir).withColumns({"in_pool": F.coalesce(F.col("score") >= 20, F.lit(False)), "in_context": F.coalesce(F.col("score") >= 60, F.lit(False)), "refused": F.col("query_id") % 3 == 0})
    return S.outcomes(r)


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
QUERIES = {f.__name__: f for f in (written_titles, repetitive_noise, rendered_chunks, caption_objects, name_variants, ranked_scores, answer_outcomes)}
ORACLES = {
    "written_titles": f"""with a as (select conv_id, turn, rtrim(trim({_STRIP.format("'\"Caption 2: ## ' || text || '.\"'")}, '"'''), '.') as t from conversations),
b as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(?i)^\\s*(?:title|caption|segment|topic|heading)\\s*\\d*\\s*[:\\-.]\\s*', ''), '[#*`_>]+', '', 'g'), '\\s+', ' ', 'g') as t from a)
select conv_id, turn, case when coalesce(trim(t), '') = '' then 'Untitled Segment' else array_to_string(string_split(trim(t), ' ')[1:8], ' ') end as title from b""",
    "repetitive_noise": """with t as (select conv_id || ':' || turn as id, text from conversations union all select p_partkey::varchar, repeat(p_name || ' ', 5) from part),
w as (select id, regexp_extract_all(lower(coalesce(text, '')), '\\b[a-z]+\\b') as w from t)
select id, len(w) = 0 or (len(w) >= 4 and len(list_distinct(w)) / len(w) < 0.4) or (len(list_distinct(w)) = 1 and length(w[1]) <= 3) as noise from w""",
    "rendered_chunks": f"""select chunk_id, md5('--- [Chunk: ' || chunk_id || ' | Timestamp: ' || printf('%.2f', ts) || 's] ---' || chr(10) || chr(10)
 || case when {_STRIP.format("coalesce(text, '')")} = '' then 'SPOKEN TRANSCRIPT: (None)' else 'SPOKEN TRANSCRIPT:' || chr(10) || {_STRIP.format("text")} end
 || case when chunk_id % 2 = 1 then chr(10) || chr(10) || 'SLIDE / OCR TEXT:' || chr(10) || lecture_id else '' end
 || chr(10) || chr(10) || 'VISUAL CONTEXT:' || chr(10) || lecture_id || chr(10) || chr(10) || 'x') as rendered from {m.CHUNKS_SQL}""",
    "caption_objects": """with i as (select p_partkey as entity_id, regexp_split_to_array(replace(p_name, ' ', ',') || '; a' || chr(10) || upper(p_type) || ', ' || p_name, '[,\\n;]') as a from part),
x as (select entity_id, k, lower(trim(a[k])) as v from i, unnest(range(1, len(a) + 1)) u(k)),
f as (select entity_id, v, min(k) as k from x where length(v) between 2 and 49 group by 1, 2), r as (select *, row_number() over (partition by entity_id order by k) as n from f)
select p_partkey as entity_id, coalesce(o, '') as objects from part left join (select entity_id, string_agg(v, '|' order by k) as o from r where n <= 20 group by 1) g on g.entity_id = p_partkey""",
    "name_variants": """with n as (select p_partkey as entity_id, p_name || ['s', 'ies', 'ses', 'ss'][(p_partkey % 4 + 1)::int] as v from part), l as (select *, lower(string_split(v, ' ')[-1]) as w from n)
select entity_id, array_to_string(list_filter([v, case when w like '%ies' and length(w) > 4 then v[:-4] || 'y' end, case when w like '%es' and length(w) > 3 then v[:-3] end, case when w like '%s' and w not like '%ss' and length(w) > 2 then v[:-2] end], lambda x: x is not null), '|') as variants from l""",
    "ranked_scores": """with r as (select user_id as query_id, row_number() over (partition by user_id order by event_id) as n, case when event_type <> 'error' then value end as s, event_type = 'purchase' as ok from events),
g as (select query_id, 1.0::double / min(case when ok then n end) as mrr, max(case when n = 1 then s end) as top1, avg(case when n <= 3 then s end) as top_mean, min(s) as least, max(s) as most, avg(s) as mean from r group by 1)
select query_id, round(coalesce(mrr, 0), 6) as mrr, round(coalesce(top1, 0), 6) as top1, round(coalesce(top_mean, 0), 6) as top_mean, round(coalesce(least, 0), 6) as least, round(coalesce(most, 0), 6) as most, round(coalesce(mean, 0), 6) as mean from g""",
    "answer_outcomes": """select user_id as query_id, case when max(value) >= 60 then case when user_id % 3 = 0 then 'refused_with_evidence' else 'ok' end when max(value) >= 20 then 'lost_after_retrieval' else 'retrieval_miss' end as outcome
from events where event_type = 'purchase' group by user_id""",
}
