"""The queries of the training-data operators, over the tables of sf_dir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import exact_dedup, fingerprints, language_id, lattice, lm_scores, minhash, mixing, packing, prefix_trie, token_counts, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintained(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"))


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op3_embedding_neardup"] = f"""
with recursive v as (
  select row_number() over () as r, vec_id, label, embedding::double[] as e,
         label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings),
u as (select r, vec_id, label, len(e) as d, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v where ok),
p as materialized (select a.r as a, b.r as b from u a join u b on a.label = b.label and a.d = b.d and a.r <> b.r where list_inner_product(a.e, b.e) >= {lattice.THRESHOLD}),
reach as (select r as a, r as b from v union select reach.a, p.b from reach join p on reach.b = p.a),
c as (select reach.a, min(v.vec_id) as component_id from reach join v on v.r = reach.b group by reach.a),
n as (select a, count(*) as n_links from p group by a)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id is not distinct from component_id as kept
from v join c on c.a = v.r left join n on n.a = v.r
"""

#: Every quotient of every seat is listed and ranked here.
ORACLES["op4_source_mixing"] = f"""
with d as (
  select row_number() over () as r, doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as size,
         md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as h
  from documents),
s0 as (select source, sum(size)::bigint as source_size, count(*) as source_rows from d group by source),
s1 as (select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as weight, ({mixing.MOST_REPEATS} * source_size)::double as cap from s0),
s2 as (select *, (sum(source_size) over ())::double as total, sum(weight) over () as weights,
              coalesce(sum(cap) over w, 0) as caps_before, coalesce(sum(weight) over w, 0) as weights_before,
              row_number() over (order by cap / weight, source is null, source) as nth
       from s1 window w as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
s3 as (select *, (total - caps_before) / (weights - weights_before) as level from s2),
s as (select source, source_size, least(cap, coalesce((select arg_min(level, nth) from s3 where level * weight <= cap) * weight, cap)) as target,
             greatest(1, ceil((source_size + source_rows) / {mixing.SHARD_WORDS}.0))::bigint as shards from s3),
placed as (select d.*, s.source_size, s.target, (('0x' || substr(h, 1, 8))::bigint % s.shards) as shard from d join s on d.source is not distinct from s.source),
laid as (select *, (sum(size) over (partition by source, shard order by substr(h, 9, 24), doc_id, size, r rows unbounded preceding))::bigint - size as start from placed),
sh as (select source, shard, sum(size)::bigint as words from placed group by all),
house as (select round(sum(target) / {mixing.BLOCK_WORDS})::bigint as n from s),
q1 as (select s.source, row_number() over (order by target / (2 * k + 1) desc, s.source is null, s.source) as place from s, house, lateral (select unnest(range(n)) as k) where target > 0),
seats as (select source, count(*) as n from q1 where place <= (select n from house) group by source),
q2 as (select sh.source, shard, seats.n, row_number() over (partition by sh.source order by words::double / (2 * k + 1) desc, shard) as place
       from sh join seats on sh.source is not distinct from seats.source, lateral (select unnest(range(seats.n)) as k) where words > 0),
quota0 as (select source, shard, count(*) as n from q2 where place <= n group by all),
quota as (select sh.source, sh.shard, words, case when words > 0 then least(coalesce(n, 0) * {mixing.BLOCK_WORDS}, {mixing.MOST_REPEATS} * words) else 0 end as wanted,
                 ('0x' || substr(md5('{mixing.SEED}:start:' || coalesce(sh.source, 'null') || ':' || sh.shard), 1, 8))::bigint % greatest(1, words // {mixing.BLOCK_WORDS}) * {mixing.BLOCK_WORDS} as b
          from sh left join quota0 on sh.source is not distinct from quota0.source and sh.shard = quota0.shard),
run as (select *, case when words > 0 then wanted // words else 0 end as rounds, wanted - case when words > 0 then wanted // words else 0 end * words as len from quota)
select doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(start + size, least(b + len, words)) - greatest(start, b)) + greatest(0, least(start + size, b + len - words) - start))::bigint as taken
from laid join run on laid.source is not distinct from run.source and laid.shard = run.shard
"""

def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _sketches_sql(words: str, source: str) -> str:
    """Rows (nth, s): the sketch of each row's words, by shingle."""
    last = fingerprints.SHINGLE - 1
    return f"""
  select nth, list_sort(list(distinct h))[1 : {fingerprints.K}] as s from (
    select nth, substr(md5(array_to_string({words}[i : i + {last}], ' ')), 1, {fingerprints.HEX}) as h
    from (select nth, {words}, unnest(range(1, case when len({words}) = 0 then 1 else greatest(1, len({words}) - {last}) + 1 end)) as i from {source}))
  group by nth"""


def _near_sql(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1 : {fingerprints.K}]"
    return f"case when len({union}) = 0 then 1.0::double else len(list_filter(list_intersect({a}, {b}), lambda v: v <= list_max({union})))::double / len({union}) end"


ORACLES["op9_fingerprints"] = f"""
with d as materialized (select row_number() over (order by doc_id desc nulls last, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint desc, text) as nth, count(*) over () as n, doc_id, coalesce(text, '') as text, {_words_sql("coalesce(text, '')")} as words from documents),
t as materialized ({_sketches_sql("words", "d")}),
e as materialized (select a.nth, a.doc_id, b.nth as nth_next, length(a.text) as n_chars, edited, {_words_sql("edited")} as words
      from d a join d b on b.nth = a.nth % a.n + 1, lateral (select substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) as edited)),
u as materialized ({_sketches_sql("words", "e")}),
f as materialized (select e.*, coalesce(t.s, []) as s, coalesce(v.s, []) as s_next, coalesce(u.s, []) as s_edited
      from e left join t on t.nth = e.nth left join t v on v.nth = e.nth_next left join u on u.nth = e.nth)
select doc_id, n_chars::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(s, '') as fingerprint, array_to_string(s_edited, '') as edited_fingerprint,
       {_near_sql("s", "s_edited")} as near_edited, {_near_sql("s", "s_next")} as near_next,
       case when len(s) < {fingerprints.K} then len(s)::double else {fingerprints.K - 1} * 281474976710656.0 / (('0x' || substr(s[-1], 1, 12))::bigint::double + 1.0) end as distinct_shingles
from f
"""


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: Every prefix is a list here; h's crc32 comes from a table of the 256 remainders.
ORACLES["op12_prefix_trie"] = f"""
with recursive bits as (select n::bigint as n, n::bigint as v, 0 as i from range(256) t(n) union all select n, case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end, i + 1 from bits where i < 8),
crcs as materialized (select list(v order by n) as c from bits where i = 8),
t as materialized (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(r) || ':' || r || x), r, x) - 1 as pos, r || chr(1) || x as said, strlen(x) as bytes
  from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null)),
c0 as (select conv_id, count(*) as n from t group by 1),
crc as (select conv_id, 4294967295::bigint as v, 1 as i from c0 union all select conv_id, xor(v >> 8, c[xor(v, ascii(substr(conv_id::varchar, i, 1))::bigint) % 256 + 1]), i + 1 from crc, crcs where i <= length(conv_id::varchar)),
c as (select c0.*, xor(v, 4294967295) % {prefix_trie.HEAD} as h, conv_id - conv_id % {prefix_trie.GROUP} as base from c0 join crc using (conv_id) where i = length(conv_id::varchar) + 1),
full_ as (select c.conv_id, 0 as part, t.pos, said, bytes from c join t on t.conv_id = base and t.pos < h union all select c.conv_id, 1, t.pos, said, bytes from c join t on t.conv_id = c.conv_id and t.pos >= h),
l as materialized (select c.conv_id, coalesce(list(said order by part, pos) filter (said is not null), []) as seq, coalesce(list(bytes order by part, pos) filter (said is not null), []) as b from c left join full_ using (conv_id) group by 1),
p as materialized (select conv_id, d, md5(array_to_string(seq[1 : d], chr(2)) || chr(2) || d) as k, len(seq) = d as ends, case when d > 0 then b[d] else 0 end as bytes from l, lateral (select unnest(range(len(seq) + 1)) as d)),
n as materialized (select d, k, min(conv_id) as conv_id, count(*) as n, any_value(bytes) as bytes, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as e from p group by d, k),
up as (select n.*, q.k as parent, o.conv_id as parent_conv_id from n left join p q on q.conv_id = n.conv_id and q.d = n.d - 1 left join n o on o.d = q.d and o.k = q.k),
kids as (select parent as k, count(*) as n_children from up where parent is not null group by 1),
own as materialized (select up.*, coalesce(n_children, 0) as n_children, (n - 1) * bytes as s from up left join kids on kids.k = up.k),
below as (select q.d, q.k, sum(case when n_children = 0 then 1 else 0 end) as leaves, sum(s) as s from own join p q on q.conv_id = own.conv_id and q.d <= own.d group by all)
select own.conv_id, own.d as depth, parent_conv_id, n as n_convs, n_children, leaves::bigint as n_leaves, below.s::bigint as saved_tokens, sha256(e) as ends_sha256
from own join below on own.d = below.d and own.k = below.k
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES |= {
    "op1_token_counts": op1_token_counts,
    "op2_lm_scores": op2_lm_scores,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_source_mixing": op4_source_mixing,
    "op5_packing": op5_packing,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_id": op10_language_id,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_embedding_whitening": op13_embedding_whitening,
}
