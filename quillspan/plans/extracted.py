"""Queries over names, types, evidence and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.operators import context as C
from quillspan.operators import extraction as E
from quillspan.operators import fuzzy
from quillspan.plans import curation, knowledge
from quillspan.plans import mapping as m

RAW_TYPES = ["Concept", " formula", "ALGORITHM", "variable", "TextElement", "LectureSegment", "gadget", "diagram "]
RAW_RELATIONS = ["explains", "USED_BY", " Derived_From", "modifies", "prerequisite_of", ""]


def _pick(values: list[str], by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def type_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as a model might write them, for every part, and what becomes of them."""
    p = m.table(spark, sf_dir, "part").select("p_partkey", _pick(RAW_TYPES, F.col("p_partkey")).alias("raw"), _pick(RAW_RELATIONS, F.col("p_partkey")).alias("rel"))
    return p.groupBy("raw", "rel").agg(F.first(E.entity_type(F.col("raw"))).alias("entity_type"), F.first(E.relation_type(F.col("rel"))).alias("relation_type"), F.count(F.lit(1)).alias("n"))


def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = curation._asked(spark, sf_dir)
    return q.select("query_id", F.array_join(E.query_entities(F.coalesce("query", F.lit(""))), "|").alias("entities"))


def fuzzy_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on parts: the three best of all names.  Every id divisible by 20 asks."""
    e = m.entities(spark, sf_dir).select("entity_id", "name")
    q = e.filter("entity_id % 20 = 0").select(F.col("entity_id").alias("query_id"), F.concat(F.lit("what is the "), F.lower("name"), F.lit("s like")).alias("asked"))
    found = fuzzy.best_names(q.withColumnRenamed("asked", "query"), e.withColumnRenamed("entity_id", "node"))
    return found.select("query_id", F.col("node").alias("entity_id"), "score", "rank")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, some of which refuse, by role."""
    c = m.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    answer = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Sorry, I CANNOT answer: "), F.coalesce("text", F.lit("")))).when(F.col("turn") % 7 == 0, F.lit("There is no evidence.")).otherwise(F.col("text"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(E.refused(answer).cast("long")).alias("refused"))


def evidence_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from a document (every fourth altered) against that document: empty quotes pass."""
    d = m.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    cut = F.substring("text", 5, 40)
    quote = F.when(F.col("doc_id") % 9 == 0, F.lit("")).when(F.col("doc_id") % 4 == 0, F.concat(cut, F.lit(" qqq"))).otherwise(F.concat(F.lit("  "), cut, F.lit("!")))
    whole = E.quoted(F.col("text"))
    return d.select("doc_id", ((E.quoted(quote) == "") | F.contains(whole, E.quoted(quote))).alias("verified"))


def used_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which passages of a filled context of 2000 characters are in its text."""
    b = curation._blocks(spark, sf_dir)
    return E.used_constituents(C.filled(b, 2000), b.select("query_id", "block_id", F.col("block_id").alias("chunk_id"), "text"))


def wide_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.capped_blocks(curation._blocks(spark, sf_dir), 6000)


def entity_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a window (orders' parts) by nearness, within 60 characters."""
    li = m.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(m.entities(spark, sf_dir), F.col("l_partkey") == F.col("entity_id"))
    items = li.select(F.col("l_orderkey").alias("window_id"), F.col("l_linenumber").alias("pos"), (3 - F.col("l_partkey") % 3).cast("int").alias("tier"), F.length("name").alias("cost"))
    return E.pruned(_one_each(items), 60)


def _one_each(items: DataFrame) -> DataFrame:
    """One item per window and place."""
    return items.groupBy("window_id", "pos").agg(F.max("tier").alias("tier"), F.max("cost").alias("cost"))


def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with at least 20 texts give their first 30; equal texts count once."""
    d = m.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("t"))
    return E.merged_sources(d, "source", "doc_id", F.sha1(F.lower("t").cast("binary")), 20, 30)


def prerequisite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the scored prerequisites, by kind."""
    s = knowledge.scored_pairs(spark, sf_dir)
    names = m.entities(spark, sf_dir)
    s = s.join(names.select(F.col("entity_id").alias("src"), F.col("name").alias("src_name")), "src").join(names.select(F.col("entity_id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    s = s.withColumn("discourse", F.when((F.col("src") + F.col("dst")) % 11 == 0, 0.9).otherwise(0.0))
    return E.prerequisite_issues(s, ["steel", "Brass"]).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of 64 pixels, a second apart in each of eight lectures."""
    e = m.table(spark, sf_dir, "embeddings").filter("embedding is not null")
    f = e.select(F.concat(F.lit("k"), (F.col("vec_id") % 8).cast("string")).alias("lecture_id"), F.floor(F.col("vec_id") / 8).cast("double").alias("ts"), F.transform("embedding", lambda x: x.cast("double") * 100 + 128).alias("pixels"))
    return E.keyframes(f)


_QUOTED = lambda t: f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_STOPS = _LIST(fixed.ENTITY_STOPWORDS)
_TYPES = " ".join(f"when '{k.lower()}' then '{v}'" for k, v in ({t: t for t in fixed.ENTITY_TYPES} | fixed.ENTITY_TYPE_ALIASES).items())
_BLOCKS = f"""{curation._bm25_sql(m.PASSAGES_SQL, m.QUESTIONS_SQL)}, top as (select * from (select *, {curation._RANK} as rank from sc) where rank <= 15),
b0 as (select query_id, chunk_id as block_id, c.ts, round(score, 6) as score, c.text from top join {m.CHUNKS_SQL} c using (lecture_id, chunk_id))"""

QUERIES = {f.__name__: f for f in (type_normalisation, query_entities, fuzzy_entity_scores, refusals, evidence_verification, used_chunks, wide_caps, entity_pruning, source_merge, prerequisite_audit, keyframes)}
ORACLES = {
    "type_normalisation": f"""with p as (select {_LIST(RAW_TYPES)}[(p_partkey % {len(RAW_TYPES)} + 1)::int] as raw, {_LIST(RAW_RELATIONS)}[(p_partkey % {len(RAW_RELATIONS)} + 1)::int] as rel from part)
select raw, rel, case lower(trim(raw)) {_TYPES} else 'Concept' end as entity_type, case when list_contains({_LIST(fixed.RELATIONS)}, upper(trim(rel))) then upper(trim(rel)) end as relation_type, count(*) as n from p group by raw, rel""",
    "query_entities": f"""with asked(query_id, query) as (values {', '.join(f"({-i - 1}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(curation.ASKED))}),
a as (select query_id, regexp_replace(query, '[À-ɏ]', '_', 'g') as query from (select * from asked union all select item_id, coalesce(text, '') from benchmark)),
p as (select query_id, regexp_split_to_array(unnest(regexp_extract_all(query, '\\b[A-Z][a-zA-Z]{{2,}}(?:\\s+[A-Z][a-zA-Z]+)*\\b|\\b[A-Z]{{2,}}\\b')), '\\s+') as w from a),
g as (select query_id, w, list_filter(range(1, len(w) + 1), lambda i: not list_contains({_STOPS}, lower(w[i]))) as good from p),
n as (select query_id, array_to_string(w[list_min(good) : list_max(good)], ' ') as e from g where len(good) > 0),
t as (select query_id, lower(unnest(regexp_extract_all(query, '[a-zA-Z]{{3,}}'))) as e from a),
u as (select distinct query_id, e from (select * from n where length(e) >= 2 union all select * from t where not list_contains({_STOPS}, e)))
select a.query_id, coalesce(string_agg(e, '|' order by e), '') as entities from a left join u using (query_id) group by a.query_id""",
    "refusals": f"""with a as (select role, lower(case when turn % 5 = 0 then 'Sorry, I CANNOT answer: ' || coalesce(text, '') when turn % 7 = 0 then 'There is no evidence.' else coalesce(text, '') end) as x from conversations)
select role, count(*) as n, (count(*) filter ({' or '.join(f"contains(x, '{p}')" for p in fixed.REFUSALS)}))::bigint as refused from a group by role""",
    "evidence_verification": f"""with d as (select doc_id, {_QUOTED('text')} as whole, {_QUOTED("case when doc_id % 9 = 0 then '' when doc_id % 4 = 0 then substr(text, 5, 40) || ' qqq' else '  ' || substr(text, 5, 40) || '!' end")} as quote from documents where text is not null)
select doc_id, quote = '' or contains(whole, quote) as verified from d""",
    "used_chunks": f"""with {_BLOCKS}, b as (select * from (select *, row_number() over (partition by query_id, text order by score desc, block_id) as o from b0) where o = 1),
u as (select *, sum(length(text) + 7) over (partition by query_id order by score desc, block_id rows unbounded preceding) as used, row_number() over (partition by query_id order by score desc, block_id) as r from b),
k as (select *, left(text, 1993) as head, instr(reverse(left(text, 1993)), ' .') as cut from u where used <= 2000 or r = 1),
f as (select query_id, block_id, case when used <= 2000 or length(text) <= 1993 then text when cut > 0 and length(head) - cut - 1 > 996 then left(head, length(head) - cut) else head end as kept from k)
select query_id, block_id, block_id as chunk_id from f join b0 using (query_id, block_id) where contains(kept, trim(substr(text, 1, 40)))""",
    "wide_caps": f"with {_BLOCKS}, n as (select query_id, block_id, count(*) over (partition by query_id) as n from b0) select query_id, block_id, case when n > 1 then greatest(300, floor((6000 - (n - 1) * 7) / n::double))::bigint end as cap from n",
    "entity_pruning": """with i as (select l_orderkey as window_id, l_linenumber as pos, max((3 - l_partkey % 3)::int) as tier, max(length(p_name)) as cost from lineitem join part on l_partkey = p_partkey group by 1, 2),
k as (select *, sum(cost) over w as used, row_number() over w as r from i window w as (partition by window_id order by tier desc, pos rows unbounded preceding))
select window_id, pos, tier, 'E' || (row_number() over (partition by window_id order by pos)) as alias from k where used <= 60 or r <= 2""",
    "source_merge": """with r as (select doc_id, source, lower(text) as t, count(*) over (partition by source) as n, row_number() over (partition by source order by doc_id) as r from documents),
u as (select *, n >= 20 and r <= 30 as used from r), k as (select *, used and row_number() over (partition by used, t order by source, doc_id) = 1 as kept from u)
select source, count(*) as provided, (count(*) filter (used))::bigint as used, (count(*) filter (kept))::bigint as kept from k group by source""",
    "prerequisite_audit": f"""with {knowledge._CONF}, j as (select s.src, s.dst, a.p_name as sn, b.p_name as dn, s.graph, s.confidence, c.t_src, c.t_dst, case when (s.src + s.dst) % 11 = 0 then 0.9 else 0.0 end as disc
 from scored s join c on c.src = s.src and c.dst = s.dst join part a on a.p_partkey = s.src join part b on b.p_partkey = s.dst),
l as (select *, src = dst or sn = dn as loop from j),
i as (select 'SELF_LOOP' as issue from l where loop union all select 'TEMPORAL_INVERSION' from l where not loop and t_src > t_dst union all select 'UNSUPPORTED' from l where not loop and not (confidence >= 0.65 and (disc > 0 or graph > 0)) union all select 'NON_PEDAGOGICAL' from l where not loop and (contains(lower(dn), 'steel') or contains(lower(dn), 'brass')))
select issue, count(*) as n from i group by 1""",
}
