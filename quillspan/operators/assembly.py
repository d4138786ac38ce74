"""From retrieved candidates to a context: pool, scores, blocks, budget, sources.

A query's pool is bounded by the retrievers' top k, so a query's candidates may meet
in one array; queries are independent and spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import is_ocr_noise, sanitize_ocr, timestamp_text, truncated
from quillspan.operators.context import SEPARATOR, block_score
from quillspan.operators.sequence import timeline_buckets

JOIN = "\n\n---\n\n"
#: The columns of a candidate, but query_id and arrival.
CANDIDATE = ["lecture_id", "chunk_id", "segment_id", "ts", "score", "transcript", "ocr_text", "visual_context"]


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def is_filler(transcript: Column, ocr: Column, visual: Column, least: int = 15) -> Column:
    """A short transcript with nothing on the slide and nothing to see."""
    return (F.length(F.trim(F.coalesce(transcript, F.lit("")))) < least) & _blank(ocr) & _blank(visual)


def hybrid_applies(lecture_id: Column, lecture_wide: Column, enabled: Column) -> Column:
    """Lexical results are fused in if enabled, but not without a lecture, nor for a sample of a lecture's time."""
    return ~_blank(lecture_id) & ~F.coalesce(lecture_wide, F.lit(False)) & F.coalesce(enabled, F.lit(False))


def passage_text(transcript: Column, ocr: Column, visual: Column, need_visual: Column) -> Column:
    """What is scored and what is read: labelled parts, slides without their noise, pictures only where asked for; blank if nothing is left."""
    clean = sanitize_ocr(F.coalesce(ocr, F.lit("")))
    part = lambda label, text, on: F.when(on, F.concat(F.lit(f"[{label}] "), text))
    said, seen = F.trim(F.coalesce(transcript, F.lit(""))), F.trim(F.coalesce(visual, F.lit("")))
    return F.concat_ws(" ", part("Transcript", said, said != ""), part("OCR", clean, (clean != "") & ~is_ocr_noise(clean)), part("Visual", seen, (seen != "") & need_visual))


def pooled(vectors: DataFrame, graph: DataFrame) -> DataFrame:
    """query_id, arrival and CANDIDATE: vector results in order, then graph results, each chunk once; rows without a chunk have no text to score and stay out."""
    v = vectors.select("query_id", F.lit(0).alias("_leg"), "arrival", *CANDIDATE)
    every = v.unionByName(graph.select("query_id", F.lit(1).alias("_leg"), "arrival", *CANDIDATE)).filter(~_blank(F.col("chunk_id").cast("string")))
    once = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("_leg", "arrival"))
    every = every.withColumn("_n", once).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_leg", "arrival"))
    return every.withColumn("arrival", place).drop("_leg", "_n")


def in_order(query: Column, passage: Column, arrival: Column) -> Column:
    """The scorer that leaves the order as it is."""
    return -arrival.cast("double")


def shared_words(query: Column, passage: Column, arrival: Column) -> Column:
    """A scorer for tests: how many distinct words of the query the passage has."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    return F.size(F.array_intersect(words(query), words(passage))).cast("double")


def reranked(pool: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column, Column], Column] | None = in_order) -> DataFrame:
    """pool with passage, rerank_score and rank.  queries: query_id, query, need_visual.

    scorer(query, passage, arrival) gives a column: built-in functions, or a pandas UDF
    around a model (a cross-encoder's predict takes the first two).  Each candidate
    keeps its own id, so equal passages stay apart; equal scores stay in order of
    arrival.  Without a scorer the retriever's own score counts and the order stays.
    """
    p = pool.join(queries.select("query_id", "query", "need_visual"), "query_id")
    p = p.withColumn("passage", passage_text(F.col("transcript"), F.col("ocr_text"), F.col("visual_context"), F.col("need_visual")))
    score = F.coalesce("score", F.lit(0.0)) if scorer is None else scorer(F.col("query"), F.col("passage"), F.col("arrival"))
    p = p.withColumn("rerank_score", score)
    order = Window.partitionBy("query_id").orderBy(*([] if scorer is None else [F.desc("rerank_score")]), "arrival")
    return p.withColumn("rank", F.row_number().over(order)).drop("query", "need_visual")


def graph_lines(rows: DataFrame) -> DataFrame:
    """query_id, isolated, hops, arrival, pos, line of graph results (query_id, arrival, start_name, related_name, rel_types, edges, hops, direction).

    A line for each hop in its stored direction, or one for the whole result if it has
    no edges, or the name of a node without neighbours.
    """
    name = lambda c: F.trim(F.coalesce(c, F.lit("")))
    r = rows.withColumns({"_s": name(F.col("start_name")), "_r": name(F.col("related_name"))}).filter("_s <> ''")
    arrow = lambda a, kind, b: F.concat(F.lit("[Graph] "), a, F.lit(" -"), kind, F.lit("-> "), b)
    kind = lambda c: F.when(name(c) == "", F.lit("RELATED")).otherwise(name(c))
    hops = F.filter(F.transform(F.coalesce("edges", F.array().cast(rows.schema["edges"].dataType)), lambda e: F.when((name(e["source"]) != "") & (name(e["target"]) != ""), arrow(name(e["source"]), kind(e["relation"]), name(e["target"])))), lambda x: x.isNotNull())
    kinds = kind(F.array_join("rel_types", ","))
    whole = F.when(F.col("direction") == "in", arrow(F.col("_r"), kinds, F.col("_s"))).otherwise(arrow(F.col("_s"), kinds, F.col("_r")))
    lines = F.when(F.col("_r") == "", F.array(F.concat(F.lit("[Graph] "), "_s"))).when(F.size(hops) > 0, hops).otherwise(F.array(whole))
    return r.select("query_id", (F.col("_r") == "").alias("isolated"), F.coalesce("hops", F.lit(0)).alias("hops"), "arrival", F.posexplode(lines).alias("pos", "line"))


def graph_context(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """query_id, graph_text: distinct lines, nodes without neighbours last, short ways first, up to the first that goes over a quarter of the budget (1500 at most)."""
    order = F.struct("isolated", "hops", "arrival", "pos")
    lines = graph_lines(rows).groupBy("query_id", "line").agg(F.min(order).alias("_o"))
    w = Window.partitionBy("query_id").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.least(F.lit(1500), F.greatest(F.lit(0), F.floor(F.col("budget") * 0.25)))
    lines = lines.join(budgets.select("query_id", "budget"), "query_id").withColumn("_used", F.sum(F.length("line") + 1).over(w)).filter(F.col("_used") <= limit)
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"]), "\n").alias("graph_text"))


def blocks(ranked: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Neighbours merged: query_id, block, ts, score, transcript, ocr_text, visual_context, parts (chunk_id, snippet).

    ranked: query_id, rank, rerank_score and CANDIDATE.  A chunk counts once, rows without
    one each time.  In order of time a row joins the block before it if lecture and
    segment don't differ (blank fits any) and the block began at most `seconds` before.
    A block's score is its best row's.
    """
    once = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))
    r = ranked.withColumn("_n", once).filter((F.col("_n") == 1) | _blank(F.col("chunk_id").cast("string")))
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    said = F.when(F.coalesce("transcript", F.lit("")) != "", F.col("transcript")).otherwise(F.coalesce("ocr_text", F.lit("")))
    row = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), "rank", text("lecture_id"), text("segment_id"), text("chunk_id"), F.col("rerank_score").alias("best"), "score", text("transcript"), text("ocr_text"), text("visual_context"), F.trim(F.substring(said, 1, 40)).alias("snippet"))
    a = r.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("a"))
    fits = lambda x, y: (x == "") | (y == "") | (x == y)

    def number(s: Column, x: Column) -> Column:
        same = s["ts"].isNotNull() & fits(s["seg"], x["segment_id"]) & fits(s["lec"], x["lecture_id"]) & (F.abs(x["ts"] - s["ts"]) <= seconds)
        b = F.when(same, s["b"]).otherwise(s["b"] + 1).cast("int")
        held = lambda k, v: F.when(same, s[k]).otherwise(v).alias(k)
        return F.struct(F.concat(s["out"], F.array(b)).alias("out"), b.alias("b"), held("ts", x["ts"]), held("seg", x["segment_id"]), held("lec", x["lecture_id"]))

    zero = F.expr("struct(cast(array() as array<int>) as out, cast(0 as int) as b, cast(null as double) as ts, '' as seg, '' as lec)")
    a = a.withColumn("_b", F.aggregate("a", zero, number)["out"])
    z = a.select("query_id", F.explode(F.arrays_zip("a", "_b")).alias("z")).groupBy("query_id", F.col("z._b").alias("block")).agg(F.sort_array(F.collect_list("z.a")).alias("r"))
    joined = lambda c: F.array_join(F.filter(F.transform("r", lambda x: x[c]), lambda x: x != ""), " ").alias(c)
    better = lambda s, x: F.when(F.coalesce(x, F.lit(0.0)) > F.coalesce(s, F.lit(0.0)), x).otherwise(s)
    best = F.aggregate(F.slice("r", 2, 1 << 20), F.col("r")[0]["best"], lambda s, x: better(s, x["best"]))
    parts = F.filter(F.transform("r", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["snippet"].alias("snippet"))), lambda x: x["chunk_id"] != "")
    return z.select("query_id", "block", F.col("r")[0]["ts"].alias("ts"), block_score(best, F.col("r")[0]["score"]).alias("score"), joined("transcript"), joined("ocr_text"), joined("visual_context"), parts.alias("parts"))


def assembled(ranked: DataFrame, plans: DataFrame, least: int = 300) -> DataFrame:
    """query_id, position, kept, used (chunk ids in the text): the passages of each query's context.

    plans: query_id, is_lecture_wide, need_visual, budget.  Blocks are taken by score -
    of a lecture-wide query one from each eighth of the time, in order of time, each cut to an
    equal share, `least` at least - without repeated texts, up to the first that
    doesn't fit; a first one that doesn't is cut at a sentence.  They are read in order
    of time.
    """
    b = blocks(ranked).join(plans.select("query_id", "is_lecture_wide", "need_visual", "budget"), "query_id")
    few = timeline_buckets(b.filter("is_lecture_wide").withColumnsRenamed({"query_id": "lecture_id", "block": "seq"})).withColumnsRenamed({"lecture_id": "query_id", "seq": "block"})
    b = b.filter("not is_lecture_wide").unionByName(few.select(*b.columns))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    cap = F.greatest(F.lit(least), F.floor((F.col("budget") - SEPARATOR * (n - 1)) / n))
    b = b.withColumn("_cap", F.when(F.col("is_lecture_wide") & (n > 1), cap))
    b = b.withColumn("text", passage_text(F.col("transcript"), F.col("ocr_text"), F.col("visual_context"), F.col("need_visual"))).filter("trim(text) <> ''")
    by_score = F.when(F.col("is_lecture_wide"), F.lit(0.0)).otherwise(-F.col("score"))
    first = F.row_number().over(Window.partitionBy("query_id", "text").orderBy(by_score, "block"))
    b = b.withColumn("_f", first).filter("_f = 1")
    b = b.withColumn("text", F.when(F.col("_cap").isNotNull(), truncated(F.col("text"), F.col("_cap"))).otherwise(F.col("text")))
    order = Window.partitionBy("query_id").orderBy(by_score, "block")
    b = b.withColumns({"_used": F.sum(F.length("text") + SEPARATOR).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_r": F.row_number().over(order)})
    b = b.filter((F.col("_used") <= F.col("budget")) | (F.col("_r") == 1))
    kept = F.when(F.col("_used") > F.col("budget"), truncated(F.col("text"), F.greatest(F.col("budget"), F.lit(0)))).otherwise(F.col("text"))
    b = b.withColumn("kept", kept)
    used = F.transform(F.filter("parts", lambda p: (p["snippet"] == "") | F.contains(F.col("kept"), p["snippet"])), lambda p: p["chunk_id"])
    return b.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("block")).alias("position"), "ts", "score", "kept", used.alias("used"))


def contexts(ranked: DataFrame, graph: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, context) for every plan, and ranked with in_context: the graph's lines first, then the passages in what they leave of the budget.

    plans: query_id, is_lecture_wide, need_visual, budget.
    """
    p = plans.join(graph_context(graph, plans), "query_id", "left").withColumn("graph_text", F.coalesce("graph_text", F.lit("")))
    rest = F.when(F.col("graph_text") == "", F.col("budget")).otherwise(F.greatest(F.lit(0), F.col("budget") - F.length("graph_text") - SEPARATOR))
    found = assembled(ranked, p.withColumn("budget", rest))
    text = found.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "kept"))), lambda x: x["kept"]), JOIN).alias("_text"))
    whole = p.join(text, "query_id", "left").select("query_id", F.concat_ws(JOIN, F.when(F.col("graph_text") != "", F.col("graph_text")), F.when(F.coalesce("_text", F.lit("")) != "", F.col("_text"))).alias("context"))
    used = found.select("query_id", F.explode("used").alias("chunk_id")).distinct().withColumn("in_context", F.lit(True))
    tagged = ranked.join(used.withColumn("chunk_id", F.col("chunk_id").cast(ranked.schema["chunk_id"].dataType)), ["query_id", "chunk_id"], "left").withColumn("in_context", F.coalesce("in_context", F.lit(False)))
    return whole, tagged


def sources(tagged: DataFrame) -> DataFrame:
    """query_id, position, chunk_id, timestamp (HH:MM:SS), segment_id: what an answer may cite, by rank; only what is in the context."""
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))
    t = tagged.filter("in_context").withColumn("_n", first).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return t.select("query_id", place.alias("position"), "chunk_id", timestamp_text(F.coalesce("ts", F.lit(0.0))).alias("timestamp"), F.coalesce(F.col("segment_id").cast("string"), F.lit("")).alias("segment_id"))


def path_names(graph: DataFrame) -> DataFrame:
    """query_id, names: start and related names of graph results in order, each once."""
    pair = F.struct("arrival", F.array("start_name", "related_name").alias("names"))
    a = graph.groupBy("query_id").agg(F.sort_array(F.collect_list(pair)).alias("a"))
    names = F.filter(F.flatten(F.transform("a", lambda x: x["names"])), lambda n: n.isNotNull() & (n != ""))
    return a.select("query_id", F.array_distinct(names).alias("names"))
