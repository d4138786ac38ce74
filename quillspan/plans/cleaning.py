"""Queries of cleaning and naming: issues and deletes of packages, aliases, counts of extraction, titles of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.operators import cleaning as C
from quillspan.operators import containment as N
from quillspan.operators import datasets as D
from quillspan.operators import titles as T
from quillspan.plans import audits
from quillspan.plans import mapping as m
from quillspan.sources.scratch import written


def _package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of lectures: a text's longest word is related to its second longest; every fifth text's, to the text's beginning."""
    c = m.passages(spark, sf_dir).filter("lecture_id is not null and text is not null")
    start = F.regexp_extract("text", "^\\s*((?:\\S+\\s+){0,7}\\S+)", 1)
    c = audits.two_longest(c).select("lecture_id", F.col("first").alias("src"), F.when(F.col("chunk_id") % 5 == 0, start).otherwise(F.col("second")).alias("dst"))
    r = written(c.filter("src is not null and dst <> ''").distinct(), "package")
    names = r.select("lecture_id", F.col("src").alias("entity_id")).union(r.select("lecture_id", "dst")).distinct()
    return names.withColumn("name", F.col("entity_id")), r


def entity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each part, as a concept of its brand; relations inside a brand keep it from being an orphan."""
    e = m.table(spark, sf_dir, "part").select(F.col("p_brand").alias("lecture_id"), F.col("p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("So that "), "p_name")).when(F.col("p_partkey") % 51 == 0, "Overview").otherwise(F.col("p_name")).alias("name"))
    lecture = e.select("lecture_id", "entity_id")
    r = m.relations(spark, sf_dir).select("src", "dst").join(lecture.withColumnRenamed("entity_id", "src"), "src").join(lecture.withColumnRenamed("entity_id", "dst"), ["dst", "lecture_id"])
    return C.entity_issues(e, r, ["lecture_id"])


def package_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that are left of every lecture's package, numbered again."""
    entities, relations = _package(spark, sf_dir)
    texts = m.passages(spark, sf_dir).filter("lecture_id is not null and text is not null").select("lecture_id", F.col("chunk_id").alias("text_id"), "text")
    said = N.evidence(relations.select("lecture_id", F.col("src").alias("source"), F.col("dst").alias("target")), texts, audits.PROSE_INDICATORS, ["lecture_id"])
    rows = said.select("lecture_id", F.col("source").alias("src"), F.col("target").alias("dst"), "tier")
    _, left = C.cleaned(entities, rows, ["lecture_id"], ["src", "dst"])
    return left.select("lecture_id", "relation_id", "src", "dst", "tier")


def _aliased(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(relations, aliases) of orders as windows: parts are E1, E2 ...; some ends are ids already, some no alias."""
    li = m.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("window_id"), "l_linenumber", F.col("l_partkey").cast("string").alias("entity_id"))
    w = Window.partitionBy("window_id").orderBy("l_linenumber", F.col("entity_id").cast("long"))
    li = li.withColumns({"nth": F.row_number().over(w), "_next": F.lead("entity_id").over(w)})
    named = lambda n: F.concat(F.lit("E"), n.cast("string"))
    dst = F.when(F.col("window_id") % 3 == 1, F.col("_next")).when((F.col("window_id") % 3 == 2) & (F.col("nth") == 1), F.lit("E99")).otherwise(named(F.col("nth") + 1))
    relations = li.filter("_next is not null").select("window_id", "nth", named(F.col("nth")).alias("src"), dst.alias("dst"))
    return relations, li.select("window_id", named(F.col("nth")).alias("alias"), "entity_id")


def relations_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of every window with ids for aliases."""
    relations, aliases = _aliased(spark, sf_dir)
    return C.remapped(relations, aliases, aliases.select("window_id", "entity_id"), ["window_id"])[0]


def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses and items of the stage that is their type: a user's later events are duplicates, small values fragments."""
    e = m.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "event_id", "user_id", "value", "props")
    raw = F.element_at(F.array(F.concat(F.lit("["), "props", F.lit("]")), F.concat(F.lit('[{"a":"\\d"},'), "props", F.lit("]")), F.concat(F.lit("["), "props", F.lit(',{"k":')), F.lit("nothing")), (F.col("event_id") % 4 + 1).cast("int"))
    responses = e.select("stage", D.json_repair(raw)["status"].alias("status"))
    items = C.first_of_each(e, ["stage", "user_id"], ["event_id"])
    fragment = F.col("value") < 5
    accepted = ~F.col("duplicate") & ~fragment & (F.col("value") >= 20)
    items = items.select("stage", accepted.alias("accepted"), (accepted & (F.col("user_id") % 4 == 0)).alias("normalized"), (~F.col("duplicate") & ~fragment & ~accepted).alias("rejected"), F.col("duplicate").alias("duplicates"), (~F.col("duplicate") & fragment).alias("fragments"))
    return C.extraction_counts(responses, items, "stage")


def title_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of their conversation's segment: some with a slide, some with a description, some that say nothing of their own."""
    c = m.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    kind, late = F.col("segment_id") % 5, F.col("pos") > 0
    ocr = F.when(kind == 0, F.concat(F.lit("Please SUBSCRIBE\n 12 + 3\n"), F.when(late, F.concat(F.lit('"* '), F.substring("text", 1, 20), F.lit('"'))).otherwise("")))
    seen = F.when(kind == 1, F.when(late, F.concat(F.lit("### "), "text")).otherwise("The image shows nothing. More."))
    said = F.when(kind == 3, "t then They could have been there with them and the other one").when(kind == 4, "ea ea ea ea").otherwise(F.col("text"))
    return c.select("segment_id", "pos", ocr.alias("ocr_text"), seen.alias("visual_context"), said.alias("transcript"))


def title_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every segment and the source that it is from."""
    return T.titles(title_chunks(spark, sf_dir), "segment_id")


_CLAUSE = " or ".join(f"regexp_matches(n, '{p}')" for p in fixed.CLAUSE_PATTERNS)
_FRAGMENT = f"(trim(n) = '' or (regexp_matches(n, '[.!?]\\s|\\.$') and not ({' or '.join(f'''n like '%{a}' ''' for a in fixed.ABBREVIATION_ENDS)})) or regexp_matches(lower(n), '^({'|'.join(fixed.FRAGMENT_OPENERS)})\\b') or regexp_matches(n, '\\s[;—]\\s'))"
_LONG = "(len(list_filter(regexp_split_to_array(trim(n), '\\s+'), lambda w: w <> '')) > 6 or length(trim(n)) > 45)"
_ISSUES = {"FRAGMENT": f"({_CLAUSE})", "EXCESSIVE_LENGTH": f"not ({_CLAUSE}) and {_LONG}", "GENERIC_STOPWORD": f"norm in ({', '.join(repr(w) for w in fixed.GENERIC_NAMES)})", "ORPHAN": "not related", "DUPLICATE": "same > 1"}

#: What letters, digits and their marks are to the query; RE2 ends words at any that is not ASCII.
_WORD = "\\p{L}\\p{Mn}\\p{Nd}_"


def _as_query(sql: str) -> str:
    """Patterns with the query's word ends and blanks (which a vertical tab is) in place of RE2's."""
    ends = sql.replace("\\b(", f"(^|[^{_WORD}])(").replace(")\\b", f")([^{_WORD}]|$)")
    return ends.replace("\\s", "[\\s\\x0B]").replace("\\S", "[^\\s\\x0B]")


QUERIES = {f.__name__: f for f in (entity_issues, package_cleaned, relations_remapped, extraction_counts, title_cascade)}
ORACLES = {
    "entity_issues": f"""with p as (select p_brand as lecture_id, p_partkey as entity_id, case when p_partkey % 50 = 0 then 'So that ' || p_name when p_partkey % 51 = 0 then 'Overview' else p_name end as n from part),
r as (select src, dst from {m.RELATIONS_SQL} x join p a on a.entity_id = src join p b on b.entity_id = dst and a.lecture_id = b.lecture_id),
ends as (select src as id from r union select dst from r), q as (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '[-_]+', ' ', 'g'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) as norm, entity_id in (select id from ends) as related from p),
e as (select *, count(*) over (partition by lecture_id, norm) as same from q)
{' union all '.join(f"select lecture_id, entity_id, '{k}' as issue from e where {v}" for k, v in _ISSUES.items())}""",
    "package_cleaned": _as_query(f"""with l as (select source as lecture_id, doc_id, text, list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda x: {{'n': -length(x), 'w': x}})) as l from documents where source is not null and text is not null),
tr as materialized (select distinct lecture_id, src as source, dst as target from (select lecture_id, l[1].w as src, case when doc_id % 5 = 0 then regexp_extract(text, '^\\s*((?:\\S+\\s+){{0,7}}\\S+)', 1) else l[2].w end as dst from l) where src is not null and dst <> ''),
s as materialized (select lecture_id, doc_id, lower(text) as text, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss from l),
j as (select tr.*, list_filter(ss, lambda q: contains(lower(q), lower(trim(tr.source))) and contains(lower(q), lower(trim(target))))[1] as f, doc_id
      from tr join s on s.lecture_id = tr.lecture_id and contains(text, lower(trim(tr.source))) and contains(text, lower(trim(target)))),
b as (select lecture_id, source, target, max(case when f is null then 1 when regexp_matches(f, '{audits.PROSE_INDICATORS}') then 3 else 2 end) as tier from j group by all),
ok as (select *, {' and '.join(f"(select not (({_CLAUSE}) or {_LONG} or {_FRAGMENT}) from (select {end} as n))" for end in ('source', 'target'))} as fine from b where tier >= 2)
select lecture_id, printf('rel_%06d', row_number() over (partition by lecture_id order by source, target)) as relation_id, source as src, target as dst, tier from ok where fine"""),
    "relations_remapped": """with li as (select l_orderkey as window_id, l_partkey::varchar as entity_id, row_number() over w as nth, lead(l_partkey::varchar) over w as nx from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey))
select window_id, nth, entity_id as src, nx as dst from li where nx is not null and not (window_id % 3 = 2 and nth = 1)""",
    "extraction_counts": """with e as (select event_type as stage, event_id % 4 as k, user_id % 4 as u, row_number() over (partition by event_type, user_id order by event_id) > 1 as dup, value from events),
f as (select *, not dup and value < 5 as frag, not dup and value >= 20 as acc from e)
select stage, count(*) as requests, count(*) filter (k = 0) as valid, count(*) filter (k in (1, 2)) as repaired, count(*) filter (k = 3) as failed, count(*) filter (acc) as accepted, count(*) filter (acc and u = 0) as normalized,
 count(*) filter (not dup and not frag and not acc) as rejected, count(*) filter (dup) as duplicates, count(*) filter (frag) as fragments, round(count(*) filter (k = 0) / count(*)::double, 4) as parse_ok, round(count(*) filter (k in (1, 2)) / count(*)::double, 4) as parse_repaired from f group by 1""",
}
