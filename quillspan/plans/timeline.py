"""Queries over ordered utterances: alignment, merging, segments, windows, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import clean_transcript as cleaned
from quillspan.functions.text import cosine, tokens
from quillspan.operators import sequence as S
from quillspan.plans import mapping as m


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as intervals, views as marks, on each user's own clock."""
    e = m.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("lecture_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    t0 = F.min("ts").over(Window.partitionBy("lecture_id"))
    e = e.withColumn("at", F.round((F.unix_micros("ts") - F.unix_micros(t0)) / 1e6 / 60.0, 6))
    atoms = e.filter("event_type = 'purchase'").select("lecture_id", F.col("event_id").alias("seq"), F.col("at").alias("start"), F.round(F.col("at") + F.col("value"), 6).alias("end"))
    return atoms, e.filter("event_type = 'view'").select("lecture_id", F.col("event_id").alias("mark_id"), "at")


def nearest_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_in_interval(*_marks(spark, sf_dir), slack=2.0, bucket=120.0)


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was clicked and what failed last, as two captions filled on their own."""
    e = m.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", F.col("props")).otherwise("").alias("visual"), F.when(F.col("event_type") == "error", F.col("props")).otherwise("").alias("ocr"))
    return S.forward_fill(e, "user_id", "event_id", ["visual", "ocr"])


def merge_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = m.atoms(spark, sf_dir)
    g = a.join(S.merge_atoms(a), ["lecture_id", "seq"])
    return g.groupBy("lecture_id", "chunk").agg(
        F.count(F.lit(1)).alias("atoms"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def clean_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with filler put in, and cleaned."""
    c = m.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    dirty = F.concat(F.lit("So, um, "), F.regexp_replace("text", "\\. ", ". Okay, uh, you know "), F.lit(" , , hmm"))
    return c.select("conv_id", "turn", cleaned(dirty).alias("cleaned"))


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = m.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), (F.col("vec_id") % 8).cast("string")).alias("lecture_id"), F.col("vec_id").alias("seq"), "embedding")
    w = Window.partitionBy("lecture_id").orderBy("seq")
    v = v.withColumn("sim", F.round(cosine(F.col("embedding"), F.lag("embedding").over(w)), 9)).drop("embedding")
    t = v.groupBy("lecture_id").agg(S.similarity_threshold(F.col("sim"))[0].alias("threshold"))
    return v.join(t, "lecture_id").withColumn("threshold", F.round("threshold", 9))


def segment_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.segment_boundaries(_adjacent(spark, sf_dir))
    start, end = 15.0 * F.min("seq"), 15.0 * F.max("seq")
    g = s.groupBy("lecture_id", "segment").agg(F.count(F.lit(1)).alias("items"), start.alias("start"), F.when(end > start, end).otherwise(start + 0.1).alias("end"))
    return g.select("lecture_id", F.format_string("seg_%03d", "segment").alias("segment_id"), "items", "start", "end")


def extraction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = m.atoms(spark, sf_dir).select("lecture_id", "seq", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return S.extraction_windows(a, 300, 1)


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn was retrieved; blocks take neighbours of the same speaker pair."""
    a = m.atoms(spark, sf_dir).filter("seq % 3 <> 1").select("lecture_id", "seq", F.floor(F.col("seq") / 8).cast("string").alias("segment"), F.col("start").alias("ts"), F.length("text").alias("n"))
    b = a.join(S.merge_adjacent(a.drop("n")), ["lecture_id", "seq"])
    return b.groupBy("lecture_id", "block").agg(F.count(F.lit(1)).alias("members"), F.min("ts").alias("ts"), F.max("n").cast("long").alias("score"))


def timeline_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = m.chunks(spark, sf_dir).select("lecture_id", F.col("chunk_id").alias("seq"), "ts")
    return S.timeline_buckets(c).select("lecture_id", "seq", "ts", "bucket")


def timeline_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = m.chunks(spark, sf_dir).select("lecture_id", F.col("chunk_id").alias("seq"), "ts")
    return S.timeline_clusters(c, top_k=5).select("lecture_id", "seq", "ts")


STOP = "the and for with was this that not are his her from".split()


def keyword_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of conversations: what users say weighs 3, what assistants say 1."""
    c = m.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", 3.0).otherwise(1.0).alias("weight"), "text")
    return S.keyword_titles(c, STOP)


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated and counted tokens of each chunk."""
    return m.passages(spark, sf_dir).select("chunk_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("estimate"), F.size(tokens(F.col("text"))).cast("long").alias("counted"))


_A = f"(select lecture_id, seq, text, start, \"end\", row_number() over (partition by lecture_id order by seq) as i from {m.ATOMS_SQL})"
_DIRTY = "'So, um, ' || regexp_replace(coalesce(text, ''), '\\. ', '. Okay, uh, you know ', 'g') || ' , , hmm'"
_C = m.CHUNKS_SQL

QUERIES = {f.__name__: f for f in (nearest_in_interval, forward_fill, merge_atoms, clean_transcript, segment_boundaries, extraction_windows, merge_adjacent, timeline_buckets, timeline_clusters, keyword_titles, token_estimates)}
ORACLES = {
    "nearest_in_interval": """with e as (select event_id, user_id as lecture_id, event_type, value, round((epoch_us(ts) - epoch_us(min(ts) over (partition by user_id))) / 1e6::double / 60.0::double, 6) as "at" from events),
a as (select lecture_id, event_id as seq, "at" as start, round("at" + value, 6) as e from e where event_type = 'purchase'), v as (select * from e where event_type = 'view'),
n as (select a.lecture_id, a.seq, v.event_id as mark_id, v."at", row_number() over (partition by a.lecture_id, a.seq order by round(abs(v."at" - (a.start + a.e) / 2), 6), v.event_id) as r from a join v on v.lecture_id = a.lecture_id and v."at" >= a.start - 2 and v."at" <= a.e + 2)
select a.lecture_id, a.seq, mark_id, "at" from a left join n on n.lecture_id = a.lecture_id and n.seq = a.seq and r = 1""",
    "forward_fill": """select event_id, user_id, last_value(case when event_type = 'click' and trim(props) <> '' then props end ignore nulls) over w as visual, last_value(case when event_type = 'error' and trim(props) <> '' then props end ignore nulls) over w as ocr
from events window w as (partition by user_id order by event_id rows unbounded preceding)""",
    "merge_atoms": f"""with recursive a as materialized {_A},
f as (select lecture_id, i, 0 as chunk, length(text)::bigint as now, "end" as last, regexp_matches(trim(text), '[.!?]$') as stop from a where i = 1
 union all select a.lecture_id, a.i, chunk + case when new then 1 else 0 end, case when new then length(a.text) else now + length(a.text) end, a."end", regexp_matches(trim(a.text), '[.!?]$')
 from f join a on a.lecture_id = f.lecture_id and a.i = f.i + 1, lateral (select now >= {S.LEAST} and (now + length(a.text) > {S.MOST} or a.start - last > {S.GAP} or (now >= {S.WANTED} and stop)) as new))
select a.lecture_id, chunk, count(*) as atoms, min(start) as start, max("end") as "end", string_agg(text, ' ' order by seq) as text from a join f using (lecture_id, i) group by 1, 2""",
    "segment_boundaries": """with recursive v0 as (select 's' || (vec_id % 8) as lecture_id, vec_id as seq, embedding::double[] as e from embeddings),
v as (select lecture_id, seq, round(list_inner_product(e, lag(e) over (partition by lecture_id order by seq)), 9) as sim, row_number() over (partition by lecture_id order by seq) as i, count(*) over (partition by lecture_id) as n from v0),
t as (select lecture_id, round(coalesce(least(greatest(avg(sim) - stddev_pop(sim), 0.3), 0.85), 0.5), 9) as thr from v group by 1),
f as (select lecture_id, 1::bigint as i, 1 as len, 1 as seg from v where i = 1
 union all select f.lecture_id, v.i, case when new then 1 else f.len + 1 end, seg + case when new then 1 else 0 end
 from f join v on v.lecture_id = f.lecture_id and v.i = f.i + 1 join t on t.lecture_id = f.lecture_id, lateral (select v.n > 3 and ((v.sim < thr and f.len + 1 >= 3) or f.len + 1 >= 30) as new)),
c as (select lecture_id, seg, count(*) as n from f group by 1, 2),
tail as (select lecture_id, seg, sum(n) over (partition by lecture_id order by seg desc) as left_from, n, max(seg) over (partition by lecture_id) as top from c),
lastok as (select lecture_id, max(seg) as last_seg from tail where left_from >= 3 or seg = 1 group by 1),
g as (select f.lecture_id, least(seg, last_seg) as seg, seq from f join lastok using (lecture_id) join v using (lecture_id, i))
select lecture_id, printf('seg_%03d', seg) as segment_id, count(*) as items, 15.0::double * min(seq) as start, case when max(seq) > min(seq) then 15.0::double * max(seq) else 15.0::double * min(seq) + 0.1::double end as "end" from g group by lecture_id, seg""",
    "extraction_windows": f"""with recursive a as materialized (select lecture_id, i, greatest(1, length(text) // 4)::bigint as tokens from {_A}),
p as materialized (select lecture_id, i, tokens, sum(tokens) over (partition by lecture_id order by i)::bigint as s, count(*) over (partition by lecture_id) as n from a),
w as (select lecture_id, 1::bigint as window_no, 1::bigint as first, (select greatest(1, max(p.i)) from p where p.lecture_id = x.lecture_id and p.s <= 300) as last, n from p x where i = 1
 union all select w.lecture_id, window_no + 1, nf, (select greatest(nf, coalesce(max(p.i), 0)) from p where p.lecture_id = w.lecture_id and p.i >= nf and p.s - (select q.s - q.tokens from p q where q.lecture_id = w.lecture_id and q.i = nf) <= 300), n
 from w, lateral (select first + greatest(1, coalesce(last, 1) - first + 1 - 1) as nf) where coalesce(last, 1) < n)
select lecture_id, window_no as "window", first, coalesce(last, 1) as last, (select sum(tokens) from p where p.lecture_id = w.lecture_id and i between first and coalesce(last, 1))::bigint as tokens from w""",
    "merge_adjacent": f"""with recursive a as materialized (select *, row_number() over (partition by lecture_id order by ts, seq) as i from (select lecture_id, seq, seq // 8 as segment, start as ts, length(text) as n from {m.ATOMS_SQL} where seq % 3 <> 1)),
f as (select lecture_id, i, 1 as block, ts, segment from a where i = 1
 union all select a.lecture_id, a.i, block + case when same then 0 else 1 end, case when same then f.ts else a.ts end, case when same then f.segment else a.segment end
 from f join a on a.lecture_id = f.lecture_id and a.i = f.i + 1, lateral (select f.segment = a.segment and abs(a.ts - f.ts) <= 30 as same))
select lecture_id, block, count(*) as members, min(a.ts) as ts, max(n)::bigint as score from a join f using (lecture_id, i) group by 1, 2""",
    "timeline_buckets": f"""with r as (select lecture_id, chunk_id as seq, ts, count(*) over w as n, min(ts) over w as a, max(ts) over w as z, row_number() over (partition by lecture_id order by ts, chunk_id) - 1 as i from {_C} window w as (partition by lecture_id)),
b as (select lecture_id, seq, ts, case when n <= 8 then i when a = z then case when i % greatest(1, n // 8) = 0 and i < 8 * greatest(1, n // 8) then i // greatest(1, n // 8) end else least(floor((ts - a) / ((z - a) / 8)), 7)::bigint end as bucket from r)
select lecture_id, seq, ts, bucket from (select *, row_number() over (partition by lecture_id, bucket order by ts, seq) as f from b where bucket is not null) where f = 1""",
    "timeline_clusters": f"""with r as (select lecture_id, chunk_id as seq, ts, count(*) over (partition by lecture_id) as n, row_number() over (partition by lecture_id order by ts, chunk_id) - 1 as i from {_C})
select lecture_id, seq, ts from r where n <= 16 or exists (select 1 from range(2) t(k) where i >= least(floor(k * n / 2.0), n - 8) and i < least(floor(k * n / 2.0), n - 8) + 8)""",
    "keyword_titles": f"""with f as (select conv_id as lecture_id, turn as pos, case when role = 'user' then 3.0 else 1.0 end as weight, regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*') as ws from conversations),
w as (select lecture_id, pos, weight, ws[k] as word, k from f, unnest(range(1, len(ws) + 1)) u(k)),
g as (select lecture_id, lower(word) as lw, sum(weight) as s, min((pos, k)) as p, arg_min(word, (pos, k)) as word from w where length(word) >= 3 and lower(word) not in ({', '.join(repr(x) for x in STOP)}) group by 1, 2),
r as (select *, row_number() over (partition by lecture_id order by s desc, p) as r from g)
select lecture_id, string_agg(word, ' ' order by r) as title from r where r <= 6 group by 1""",
    "token_estimates": "select doc_id as chunk_id, greatest(1, length(text) // 4)::bigint as estimate, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}'))::bigint as counted from documents",
    "clean_transcript": f"""with d as (select conv_id, turn, {_DIRTY} as t from conversations),
a as (select conv_id, turn, regexp_replace(regexp_replace(t, '(?i)\\b(?:um|uh|uhm|hmm|hm|mhm|erm)\\b[,;]?\\s*', '', 'g'), '(?i)\\b(?:you know|I mean|kind of|sort of|like,)\\s*', '', 'g') as t from d),
b as (select conv_id, turn, regexp_replace(regexp_replace(t, '(?i)^(?:So,?\\s+|Okay,?\\s+|OK,?\\s+|All right\\.?\\s*|Right,?\\s+|And so,?\\s+|Well,?\\s+)', ''), '(?i)([.!?])\\s*(?:So,?\\s+|Okay,?\\s+|OK,?\\s+|All right\\.?\\s*|Right,?\\s+|And so,?\\s+|Well,?\\s+)', '\\1', 'g') as t from a)
select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, ',(\\s*,)+', ',', 'g'), '^\\s*,\\s*', ''), '\\s{{2,}}', ' ', 'g'), ' ') as cleaned from b""",
}
