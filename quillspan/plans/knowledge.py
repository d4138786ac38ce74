"""Queries over the entity graph: traversal, prerequisites, audits, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions import text as X
from quillspan.operators import fuzzy
from quillspan.operators import graph as G
from quillspan.operators import nearby
from quillspan.operators.containment import contained
from quillspan.operators.spread import spread
from quillspan.plans import mapping as m


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per ordered pair, with a number; its type is the most frequent (first by name)."""
    r = m.relations(spark, sf_dir).filter("src <> dst")
    p = r.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("n"))
    p = p.groupBy("src", "dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "relation"))["relation"].alias("relation"), F.sum("n").alias("n"))
    return p.withColumn("edge_id", F.col("src") * 1000000 + F.col("dst"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, name: every entity whose id is divisible by 20 asks for its name."""
    return m.entities(spark, sf_dir).filter("entity_id % 20 = 0").select(F.col("entity_id").alias("query_id"), F.lower("name").alias("name"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, node: an asked name is one query, whoever asks it; exact matches are its seeds."""
    e = m.entities(spark, sf_dir).select(F.col("entity_id").alias("node"), F.lower("name").alias("name"))
    return e.join(_asked(spark, sf_dir).select("name").distinct(), "name").select(F.col("name").alias("query_id"), "node")


def _for_all(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """The rows found for a name, for each that asks it."""
    return found.withColumnRenamed("query_id", "name").join(_asked(spark, sf_dir), "name").drop("name")


def graph_traverse_out_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, e = _seeds(spark, sf_dir), _edges(spark, sf_dir)
    out = G.trail_counts(seeds, e).withColumn("direction", F.lit("out"))
    back = G.trail_counts(seeds, e, backward=True).withColumn("direction", F.lit("in"))
    found = out.union(back).groupBy("query_id", "node", "direction").agg(F.min("hops").alias("hops"), F.sum("n").alias("trails"))
    return _for_all(spark, sf_dir, found).select("query_id", "node", "direction", "hops", "trails")


def graph_partial_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that no name equals are looked for inside all names; one hop from there.  Every id divisible by 20 asks."""
    e = m.entities(spark, sf_dir).select(F.col("entity_id").alias("node"), F.lower("name").alias("name"))
    asked = e.filter("node % 20 = 0").select(F.col("node").alias("query_id"), F.element_at(F.split("name", "[^a-z0-9]+"), -1).alias("term")).filter("length(term) > 0")
    # a term is looked for once, whoever asks it
    terms = asked.select("term").distinct().join(e, F.col("term") == F.col("name"), "left_anti")
    found = contained(e.select(F.col("name").alias("text_id"), F.col("name").alias("text")).distinct(), terms.select(F.col("term").alias("name")))
    part = found.select(F.col("name").alias("term"), F.col("text_id").alias("name")).join(e, "name").select("term", "node")
    near = part.join(_edges(spark, sf_dir).select(F.col("src").alias("node"), "dst"), "node", "left")
    by_term = near.groupBy("term").agg(F.countDistinct("node").alias("seeds"), F.countDistinct("dst").alias("neighbours"))
    return asked.join(by_term, "term").select("query_id", "seeds", "neighbours")


def graph_fuzzy_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names: the three entities of the best fuzzy scores (X14), ties by name.  Every id divisible by 20 asks all names."""
    e = m.entities(spark, sf_dir).select(F.col("entity_id").alias("node"), F.lower("name").alias("name"))
    q = e.filter("node % 20 = 0").select(F.col("node").alias("query_id"), F.concat(F.substring("name", 1, 3), F.lit("x"), F.expr("substring(name, 5)")).alias("asked"))
    return fuzzy.best_names(q.withColumnRenamed("asked", "query"), e).select("query_id", "node", "score", "rank")


def prereq_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of prerequisites that lead to a concept, each earlier concept at its least depth."""
    e = _edges(spark, sf_dir).filter("relation = 'PREREQUISITE_OF'")
    p = G.least_depth(G.simple_paths_back(_seeds(spark, sf_dir), e))
    return _for_all(spark, sf_dir, p.groupBy("query_id", "node", "depth").agg(F.count(F.lit(1)).alias("paths"))).select("query_id", "node", "depth", "paths")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs with an edge either way, with counts and weights both ways and first places."""
    r = m.relations(spark, sf_dir).filter("src <> dst")
    table = spark.createDataFrame([(k, f, b) for k, (f, b) in fixed.PREREQUISITE_WEIGHTS.items()], "relation string, along double, against double")
    w = r.join(F.broadcast(table), "relation")  # a row for each type
    along = w.select("src", "dst", F.col("along").alias("w"), F.lit(1).cast("long").alias("f"), F.lit(0).cast("long").alias("b"))
    against = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("against").alias("w"), F.lit(0).cast("long").alias("f"), F.lit(1).cast("long").alias("b"))
    # at most two rows for each line, one for each end
    n = 2 * m.table(spark, sf_dir, "lineitem").count()
    p = spread(along.union(against), n, "src", "dst").groupBy("src", "dst").agg(F.max("w").alias("graph"), F.sum("f").alias("n_fwd"), F.sum("b").alias("n_rev"))
    ends = r.select(F.col("src").alias("node"), "order_id").union(r.select("dst", "order_id"))
    first = ends.groupBy("node").agg((F.min("order_id") * 15.0).alias("t"))
    at = lambda c: first.select(F.col("node").alias(c), F.col("t").alias(f"t_{c}"))
    # both sides are dealt alike: a side that was not would have the other dealt again, into as few tasks as it has itself
    met = lambda d, c: spread(d, n, c).join(spread(at(c), n, c), c)
    return met(met(p, "src"), "dst").select("src", "dst", "graph", "n_fwd", "n_rev", "t_src", "t_dst")


def prereq_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on candidate pairs: a pair against time needs graph evidence; a counted reason otherwise."""
    c = _candidates(spark, sf_dir)
    reason = F.when((F.col("t_src") > F.col("t_dst")) & (F.col("graph") < 0.8), "backward").when((F.col("n_fwd") == 0) & (F.abs(F.col("t_src") - F.col("t_dst")) > 45 * 60), "far").otherwise("accepted")
    return c.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("graph"), 6).alias("graph"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    cue = F.when((F.col("src") + F.col("dst")) % 11 == 0, 0.9).otherwise(0.0)
    return c.withColumn("confidence", G.confidence(cue, F.col("graph"), F.col("src") % 5 == 0, F.col("t_src") < 3000, F.col("t_src"), F.col("t_dst")))


def prereq_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).filter("confidence >= 0.65").select("src", "dst", "graph", F.round("confidence", 4).alias("confidence"))


def lecture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites between concepts of one lecture (a part's brand): others are none, as lectures are kept apart."""
    lecture = m.table(spark, sf_dir, "part").select(F.col("p_brand").alias("lecture_id"), F.col("p_partkey").alias("src"))
    e = scored_pairs(spark, sf_dir).filter("confidence >= 0.65").select("src", "dst", "confidence")
    return e.join(lecture, "src").join(lecture.withColumnRenamed("src", "dst"), ["lecture_id", "dst"]).select("lecture_id", "src", "dst", "confidence")


def dag_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites of every lecture without their cycles."""
    return G.acyclic(lecture_pairs(spark, sf_dir))


def dag_is_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on or behind cycles before and after dag_enforced, of all lectures."""
    before = lecture_pairs(spark, sf_dir)
    both = G.validated(before).withColumn("enforced", F.lit(False)).union(G.validated(G.acyclic(before)).withColumn("enforced", F.lit(True)))
    return both.groupBy("enforced").agg(F.sum("edges").alias("edges"), F.sum("on_cycles").alias("on_cycles"))


def cycle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on cycles of any length, with the least part of their strong component."""
    return G.strong_components(_edges(spark, sf_dir))


def node_degree_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degrees(m.entities(spark, sf_dir), _edges(spark, sf_dir))
    return d.withColumn("orphan", F.col("degree") == 0)


def graph_distance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks that mention their parts, ranked by distance from the asked parts; ten per query."""
    li = m.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("chunk_id")).distinct()
    best = nearby.best_by_distance(li, _edges(spark, sf_dir), _seeds(spark, sf_dir), 10)
    return _for_all(spark, sf_dir, best).select("query_id", "chunk_id", "score", "rank")


def graph_lines_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the edges around the asked parts, in stored direction, within 600 characters."""
    e, s = _edges(spark, sf_dir), _seeds(spark, sf_dir)
    near = s.join(e, F.col("node") == F.col("src")).union(s.join(e, F.col("node") == F.col("dst")))
    line = F.concat(F.col("src").cast("string"), F.lit(" --"), "relation", F.lit("--> "), F.col("dst").cast("string"))
    found = G.budgeted_lines(near.select("query_id", F.col("edge_id").alias("pos"), line.alias("line")), 600)
    return _for_all(spark, sf_dir, found).select("query_id", "pos", "line", "used")


def _triples(spark: SparkSession, sf_dir: str, column: str = "predicate") -> DataFrame:
    """Extracted and gold triples over part names, with free predicates."""
    words = sorted(w for t in (fixed.PREDICATES, fixed.INVERTED_PREDICATES) for v in t.values() for w in v.split())
    pick = F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col("src") * 31 + F.col("line"), F.lit(len(words))) + 1).cast("int"))
    return m.relations(spark, sf_dir).select("order_id", "line", F.col("src").cast("string").alias("source"), pick.alias(column), F.col("dst").cast("string").alias("target"))


def predicate_table(spark: SparkSession) -> DataFrame:
    rows = [(w, k, i) for i, t in ((False, fixed.PREDICATES), (True, fixed.INVERTED_PREDICATES)) for k, v in t.items() for w in v.split()]
    return spark.createDataFrame(rows, "clean string, canonical string, inverted boolean")


def canonical(triples: DataFrame) -> DataFrame:
    """Triples with canonical predicates; an inverted one swaps its ends, an unknown one is upper-cased."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("predicate")), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    t = triples.withColumn("clean", clean).join(predicate_table(triples.sparkSession), "clean", "left")
    a, b = X.normalize_name(F.col("source")), X.normalize_name(F.col("target"))
    inv = F.coalesce("inverted", F.lit(False))
    return t.select(F.when(inv, b).otherwise(a).alias("a"), F.coalesce("canonical", F.upper(F.trim("predicate"))).alias("rel"), F.when(inv, a).otherwise(b).alias("b"), "order_id")


def dual_relation_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction (orders not divisible by 3) against gold (not by 5): exact on given predicates, and canonical."""
    t = _triples(spark, sf_dir)
    exact = t.select(F.col("source").alias("a"), F.col("predicate").alias("rel"), F.col("target").alias("b"), "order_id")
    out = []
    for name, rows in (("exact", exact), ("canonical", canonical(t))):
        p = rows.filter("order_id % 3 <> 0").select("a", "rel", "b").distinct()
        g = rows.filter("order_id % 5 <> 0").select("a", "rel", "b").distinct()
        both = p.select("*", F.lit(1).alias("p"), F.lit(0).alias("g")).union(g.select("*", F.lit(0), F.lit(1))).groupBy("a", "rel", "b").agg(F.max("p").alias("p"), F.max("g").alias("g"))
        tp, np_, ng = F.sum(F.col("p") * F.col("g")), F.sum("p"), F.sum("g")
        out.append(both.agg(tp.alias("tp"), np_.alias("predicted"), ng.alias("gold"), F.round(2.0 * tp / (np_ + ng), 6).alias("f1")).withColumn("kind", F.lit(name)))
    return out[0].union(out[1])


def gold_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in the plural against the names themselves: exact first, then by singular tokens."""
    e = m.entities(spark, sf_dir)
    gold = e.select(F.col("entity_id").alias("gold_id"), X.normalize_name(F.col("name")).alias("exact"), X.lemma_key(F.col("name")).alias("lemma"))
    said = F.when(F.col("entity_id") % 2 == 0, F.concat(F.upper("name"), F.lit("s"))).otherwise(F.concat(F.lit(" "), "name"))
    p = e.select("entity_id", X.normalize_name(said).alias("exact"), X.lemma_key(said).alias("lemma"))
    # a spelling's least id is found once, so an entity meets one row of it, however many share it
    least = lambda key: gold.groupBy(key).agg(F.min("gold_id").alias(f"_{key}"))
    found = p.join(least("exact"), "exact", "left").join(least("lemma"), "lemma", "left").groupBy("entity_id").agg(F.min("_exact").alias("_exact"), F.min("_lemma").alias("_lemma"))
    stage = F.when(F.col("_exact").isNotNull(), "EXACT").otherwise("LEMMA")
    return found.select("entity_id", F.coalesce("_exact", "_lemma").alias("gold_id"), stage.alias("stage")).filter("gold_id is not null")


def ontology_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = m.relations(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def relation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of relations whose known entities end at id 1800: dangling ends, repeats, loops, against the order of ids."""
    r = m.relations(spark, sf_dir)
    known = m.entities(spark, sf_dir).filter("entity_id <= 1800").select("entity_id")
    r = r.join(known.select(F.col("entity_id").alias("src"), F.lit(True).alias("s")), "src", "left").join(known.select(F.col("entity_id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    nth = F.row_number().over(Window.partitionBy("src", "relation", "dst").orderBy("order_id", "line"))
    r = r.withColumn("nth", nth)
    flags = F.array(F.when(F.col("s").isNull() | F.col("d").isNull(), "DANGLING"), F.when(F.col("nth") > 1, "DUPLICATE"), F.when(F.col("src") == F.col("dst"), "SELF_LOOP"), F.when((F.col("relation") == "INTRODUCED_BEFORE") & (F.col("src") > F.col("dst")), "INVERTED"))
    issue = F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("issue")
    return r.select("relation", issue).groupBy("relation", "issue").agg(F.count(F.lit(1)).alias("n"))


def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frequent words as relation ends: 3 if a sentence has both and a verb, 2 a sentence, 1 a chunk, 0 nothing."""
    words = ["the", "and", "that", "with", "this", "for"]
    c = m.passages(spark, sf_dir).filter("text is not null").select("lecture_id", F.lower("text").alias("text")).withColumn("sentences", F.split("text", "(?<=[.!?])\\s+"))

    def tier_of(a: str, b: str):
        first = F.get(F.filter("sentences", lambda x: F.contains(x, F.lit(a)) & F.contains(x, F.lit(b))), F.lit(0))
        both = F.contains("text", F.lit(a)) & F.contains("text", F.lit(b))
        return F.when(~both, 0).when(first.isNull(), 1).when(first.rlike("\\b(is|was|are|by)\\b"), 3).otherwise(2)

    made = [(a, b) for a in words for b in words if a < b]
    per_chunk = c.select("lecture_id", *[tier_of(a, b).alias(f"{a}|{b}") for a, b in made])
    # one row per lecture and pair leaves each task
    wide = per_chunk.groupBy("lecture_id").agg(*[F.max(F.col(f"{a}|{b}")).alias(f"{a}|{b}") for a, b in made])
    return wide.select("lecture_id", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("tier")) for a, b in made])))


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of the components that can be measured; a relation type's components are its share, its span and (for three types) its repeats."""
    r = m.relations(spark, sf_dir)
    g = r.groupBy("relation").agg((1 - F.avg(F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0))).alias("c1"), (F.countDistinct("src") / F.count(F.lit(1))).alias("c2"), F.when(F.length(F.first("relation")) > 10, F.countDistinct("dst") / F.count(F.lit(1))).alias("c3"))
    parts = [("c1", 40.0), ("c2", 35.0), ("c3", 25.0)]
    got = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    most = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return g.select("relation", F.round(got, 6).alias("score"), most.alias("measurable"), F.round(100 * got / most, 6).alias("percent"))


_R = m.RELATIONS_SQL
_EDGES = f"""(select src, dst, arg_min(relation, (-n, relation)) as relation, sum(n)::bigint as n, src * 1000000 + dst as edge_id from (select src, dst, relation, count(*) as n from {_R} where src <> dst group by all) group by 1, 2)"""
_SEEDS = "(select a.p_partkey as query_id, b.p_partkey as node from part a join part b on lower(a.p_name) = lower(b.p_name) where a.p_partkey % 20 = 0)"
_W = ", ".join(f"('{k}', {a}::double, {b}::double)" for k, (a, b) in fixed.PREREQUISITE_WEIGHTS.items())
_CAND = f"""r as materialized (select * from {_R} where src <> dst), w(relation, along, against) as (values {_W}),
p as (select src, dst, max(w) as graph, sum(f)::bigint as n_fwd, sum(b)::bigint as n_rev from (select src, dst, along as w, 1 as f, 0 as b from r join w using (relation) union all select dst, src, against, 0, 1 from r join w using (relation)) group by 1, 2),
t as (select node, min(order_id) * 15.0::double as t from (select src as node, order_id from r union all select dst, order_id from r) group by 1),
c as (select p.*, a.t as t_src, b.t as t_dst from p join t a on a.node = src join t b on b.node = dst)"""
_CONF = f"""{_CAND}, s as (select *, case when (src + dst) % 11 = 0 then 0.9::double else 0.0 end as cue from c),
k as (select *, least(1.0::double, greatest(cue, graph) + 0.25::double * least(cue, graph)) as meaning, least(1.0::double, case when src % 5 = 0 then 0.7::double else 0.0 end + case when t_src < 3000 then 0.3::double else 0.0 end) as prom,
 case when t_src = t_dst then 0.5::double when t_src < t_dst then 1.0::double / (1.0::double + abs(t_dst - t_src) / 600.0::double) else 0.4::double / (1.0::double + abs(t_dst - t_src) / 600.0::double) end as tm from s),
scored as (select src, dst, graph, case when cue = 0 and graph = 0 then 0.0 else floor(least(1.0::double, greatest(0.0::double, 0.7::double * meaning + 0.15::double * prom + 0.15::double * tm)) * 10000.0::double + 0.5::double) / 10000.0::double end as confidence from k)"""
_WORDS = sorted(w for t in (fixed.PREDICATES, fixed.INVERTED_PREDICATES) for v in t.values() for w in v.split())
_PT = ", ".join(f"('{w}', '{k}', {i})" for i, t in (("false", fixed.PREDICATES), ("true", fixed.INVERTED_PREDICATES)) for k, v in t.items() for w in v.split())
_TRIPLES = f"(select order_id, src::varchar as source, [{', '.join(repr(w) for w in _WORDS)}][((src * 31 + line) % {len(_WORDS)} + 1)::int] as predicate, dst::varchar as target from {_R})"


def _singular_sql(t: str) -> str:
    out = t
    for suffix, put in reversed(fixed.PLURAL_RULES):
        made = f"left({t}, length({t}) - {len(suffix)}) || '{put}'"
        out = f"case when {t} like '%{suffix}' then case when length({made}) >= 3 then {made} else {t} end else {out} end"
    return f"case when length({t}) <= 3 then {t} else {out} end"


def _norm_sql(n: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({n})), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _lemma_sql(n: str) -> str:
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({_norm_sql(n)}, '[\\s_-]+'), lambda t: t <> ''), lambda t: {_singular_sql('t')}), ' ')"


def _trails_sql(name: str, a: str, b: str) -> str:
    return f"""{name} as (select query_id, node as start, node, 0 as hops, []::bigint[] as path from seeds
 union all select query_id, start, e.{b}, hops + 1, list_append(path, e.edge_id) from {name} t join e on t.node = e.{a} where hops < 3 and not list_contains(path, e.edge_id))"""


QUERIES = {f.__name__: f for f in (graph_traverse_out_in, graph_partial_seed, graph_fuzzy_seed, prereq_backtrack, prereq_candidates, prereq_confidence, dag_enforced, dag_is_acyclic, cycle_pairs, node_degree_orphans, graph_distance_rank, graph_lines_budget, dual_relation_f1, gold_name_match, ontology_mix, relation_audit, evidence_tiers, composite_score)}
ORACLES = {
    "graph_traverse_out_in": f"""with recursive e as materialized (select * from {_EDGES}), seeds as (select * from {_SEEDS}), {_trails_sql('fwd', 'src', 'dst')}, {_trails_sql('bwd', 'dst', 'src')}
select query_id, node, direction, min(hops) as hops, count(*) as trails from (select *, 'out' as direction from fwd union all select *, 'in' from bwd) where hops > 0 and node <> start group by all""",
    "graph_partial_seed": f"""with e as (select p_partkey as node, lower(p_name) as name from part), terms as (select node as query_id, regexp_split_to_array(name, '[^a-z0-9]+')[-1] as term from e where node % 20 = 0),
part_seeds as (select query_id, node from terms join e on contains(name, term) where length(term) > 0 and term not in (select name from e))
select query_id, count(distinct s.node) as seeds, count(distinct t.dst) as neighbours from part_seeds s left join {_EDGES} t on t.src = s.node group by 1""",
    "prereq_backtrack": f"""with recursive e as materialized (select * from {_EDGES} where relation = 'PREREQUISITE_OF'),
p as (select query_id, node, 0 as depth, [node] as path from {_SEEDS} union all select query_id, e.src, depth + 1, list_append(path, e.src) from p join e on p.node = e.dst where depth < 3 and not list_contains(path, e.src)),
q as (select *, min(depth) over (partition by query_id, node) as md from p where depth > 0)
select query_id, node, depth, count(*) as paths from q where depth = md group by all""",
    "prereq_candidates": f"""with {_CAND} select case when t_src > t_dst and graph < 0.8 then 'backward' when n_fwd = 0 and abs(t_src - t_dst) > 2700 then 'far' else 'accepted' end as outcome, count(*) as pairs, round(avg(graph), 6) as graph from c group by 1""",
    "prereq_confidence": f"with {_CONF} select src, dst, graph, round(confidence, 4) as confidence from scored where confidence >= 0.65",
    "node_degree_orphans": f"""with e as (select * from {_EDGES}), d as (select node, count(*) as n from (select src as node from e union all select dst from e) group by 1)
select p_partkey as entity_id, coalesce(n, 0) as degree, coalesce(n, 0) = 0 as orphan from part left join d on node = p_partkey""",
    "graph_distance_rank": f"""with b as materialized (select src as a, dst as b from {_EDGES} union all select dst, src from {_EDGES}), s as (select * from {_SEEDS}),
w as (select query_id, node as entity, 3.0::double as w from s union all select query_id, b.b, 1.5 from s join b on b.a = s.node union all select query_id, c.b, 0.5 from s join b on b.a = s.node join b c on c.a = b.b where c.b <> s.node),
li as (select distinct l_partkey, l_orderkey from lineitem), sc as (select query_id, l_orderkey as chunk_id, sum(w) as score from w join li on l_partkey = entity group by 1, 2)
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc) where rank <= 10""",
    "graph_lines_budget": f"""with l as (select query_id, min(edge_id) as pos, line from (select query_id, edge_id, src || ' --' || relation || '--> ' || dst as line from {_SEEDS} s join {_EDGES} e on s.node = e.src or s.node = e.dst) group by query_id, line)
select * from (select query_id, pos, line, (sum(length(line) + 1) over (partition by query_id order by pos))::bigint as used from l) where used <= 600""",
    "dual_relation_f1": f"""with t as materialized (select * from {_TRIPLES}), pt(clean, canonical, inverted) as (values {_PT}),
c as (select 'exact' as kind, source as a, predicate as rel, target as b, order_id from t union all
 select 'canonical', case when inverted then target else source end, coalesce(canonical, upper(trim(predicate))), case when inverted then source else target end, order_id from t left join pt on clean = predicate),
g as (select kind, a, rel, b, max(case when order_id % 3 <> 0 then 1 else 0 end) as p, max(case when order_id % 5 <> 0 then 1 else 0 end) as g from c group by kind, a, rel, b)
select kind, sum(p * g)::bigint as tp, sum(p)::bigint as predicted, sum(g)::bigint as gold, round(2.0::double * sum(p * g) / (sum(p) + sum(g)), 6) as f1 from g group by kind""",
    "gold_name_match": f"""with e as (select p_partkey as id, p_name as name, case when p_partkey % 2 = 0 then upper(p_name) || 's' else ' ' || p_name end as said from part),
g as (select id, {_norm_sql('name')} as exact, {_lemma_sql('name')} as lemma from e), p as (select id, {_norm_sql('said')} as exact, {_lemma_sql('said')} as lemma from e),
one as (select p.id, min(g.id) as gold_id from p join g using (exact) group by 1),
two as (select p.id, min(g.id) as gold_id from p join g using (lemma) where p.id not in (select id from one) group by 1)
select id as entity_id, gold_id, 'EXACT' as stage from one union all select id, gold_id, 'LEMMA' from two""",
    "ontology_mix": f"select relation, count(*) as n, round(count(*) / (sum(count(*)) over ())::double, 6) as share from {_R} group by 1",
    "relation_audit": f"""with r as (select *, row_number() over (partition by src, relation, dst order by order_id, line) as nth, src > 1800 or dst > 1800 or src not in (select p_partkey from part) or dst not in (select p_partkey from part) as dangling from {_R}),
i as (select relation, 'DANGLING' as issue from r where dangling union all select relation, 'DUPLICATE' from r where nth > 1 union all select relation, 'SELF_LOOP' from r where src = dst union all select relation, 'INVERTED' from r where relation = 'INTRODUCED_BEFORE' and src > dst)
select relation, issue, count(*) as n from i group by 1, 2""",
    "evidence_tiers": """with w(x) as (values ('the'), ('and'), ('that'), ('with'), ('this'), ('for')), pairs as (select l.x as a, r.x as b from w l join w r on l.x < r.x),
c as (select source as lecture_id, doc_id as chunk_id, lower(text) as text from documents where text is not null),
s as (select lecture_id, chunk_id, text, list_zip(ss, range(len(ss))) as ss from (select *, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss from c)),
j as (select lecture_id, chunk_id, a, b, list_filter(ss, lambda q: contains(q[1], a) and contains(q[1], b))[1][1] as f from s join pairs on contains(text, a) and contains(text, b)),
t as (select lecture_id, a, b, max(case when f is null then 1 when regexp_matches(f, '\\b(is|was|are|by)\\b') then 3 else 2 end) as tier from j group by 1, 2, 3)
select lecture_id, a, b, coalesce(tier, 0) as tier from (select distinct lecture_id from c) cross join pairs left join t using (lecture_id, a, b)""",
    "composite_score": f"""with g as (select relation, 1 - avg(case when src = dst then 1.0::double else 0.0 end) as c1, count(distinct src) / count(*)::double as c2, case when length(relation) > 10 then count(distinct dst) / count(*)::double end as c3 from {_R} group by 1),
s as (select relation, coalesce(c1 * 40, 0) + coalesce(c2 * 35, 0) + coalesce(c3 * 25, 0) as got, 75.0::double + case when c3 is null then 0 else 25 end as most from g)
select relation, round(got, 6) as score, most as measurable, round(100 * got / most, 6) as percent from s""",
}
