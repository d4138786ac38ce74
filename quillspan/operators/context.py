"""Contexts within a budget of characters, and query plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions.text import truncated, word_tokens

SEPARATOR = 7


def block_score(rerank: Column, score: Column) -> Column:
    """The rerank score, else the score, else 0; a zero counts as missing."""
    zero = lambda c: F.when(c != 0, c)
    return F.coalesce(zero(rerank), zero(score), F.lit(0.0))


def budgets(total: int) -> tuple[int, int]:
    """Characters for graph lines and for passages."""
    graph = min(1500, total // 4)
    return graph, total - graph - SEPARATOR


def filled(blocks: DataFrame, budget: int) -> DataFrame:
    """blocks (query_id, block_id, ts, score, text): distinct texts by score while they fit, each costing its length and a separator; a first block that is too long is truncated.  Adds kept, used, position (by time)."""
    once = F.row_number().over(Window.partitionBy("query_id", "text").orderBy(F.desc("score"), "block_id"))
    b = blocks.withColumn("_o", once).filter("_o = 1").drop("_o")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "block_id")
    b = b.withColumn("used", F.sum(F.length("text") + SEPARATOR).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_r", F.row_number().over(order))
    b = b.filter((F.col("used") <= budget) | (F.col("_r") == 1))
    b = b.withColumn("kept", F.when(F.col("used") > budget, truncated(F.col("text"), budget - SEPARATOR)).otherwise(F.col("text")))
    return b.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "block_id"))).drop("_r")


def _count(q: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(q.rlike(p), 1).otherwise(0) for p in patterns])


def planned(queries: DataFrame) -> DataFrame:
    """query_id, query -> route, intent, is_lecture_wide, answer_style, weights, depth, top_k, budget, need_visual; a blank query has the default plan."""
    q = F.lower(F.coalesce("query", F.lit("")))
    blank = F.trim(q) == ""
    g, v = _count(q, fixed.GRAPH_PATTERNS), _count(q, fixed.VECTOR_PATTERNS)
    rules = [
        (fixed.LEARNING_PATH_PATTERNS, "learning_path", True, "structured"),
        (fixed.QUIZ_PATTERNS, "quiz", True, "structured"),
        (fixed.FLASHCARD_PATTERNS, "flashcards", True, "structured"),
        (fixed.NOTES_PATTERNS, "notes", True, "structured"),
        (fixed.SUMMARY_PATTERNS, "summary", True, "detailed"),
        (fixed.COMPARISON_PATTERNS, "comparison", False, "comparative"),
        (fixed.DEFINITION_PATTERNS, "definition", False, "concise"),
        (fixed.REASONING_PATTERNS, "reasoning", False, "detailed"),
    ]
    kind = lambda intent, wide, style: F.struct(F.lit(intent).alias("intent"), F.lit(wide).alias("wide"), F.lit(style).alias("style"))
    chosen = F.when((F.col("g") > 0) & (F.col("v") > 0), kind("conceptual", False, "detailed")).otherwise(kind("factual_qa", False, "concise"))
    for patterns, *what in reversed(rules):
        chosen = F.when(_count(q, patterns) > 0, kind(*what)).otherwise(chosen)
    topics = F.exists(F.regexp_extract_all(q, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(fixed.SCOPE_WORDS) & ~t.rlike("^[0-9]+$"))
    p = queries.withColumns({"g": g, "v": v}).withColumn("k", F.when(blank, kind("factual_qa", False, "concise")).otherwise(chosen))
    wide = F.col("k.wide") & ~topics
    total = F.greatest(F.col("g") + F.col("v"), F.lit(1))
    weight = F.floor(F.col("g") / total * 100 + 0.5) / 100
    route = F.when((F.col("g") > 0) & (F.col("v") > 0), "graph+vector").when(F.col("g") > 0, "graph_only").otherwise("vector_only")
    return p.select(
        "query_id",
        F.when(blank, "vector_only").otherwise(route).alias("route"),
        F.col("k.intent").alias("intent"),
        wide.alias("is_lecture_wide"),
        F.col("k.style").alias("answer_style"),
        weight.alias("graph_weight"),
        F.when(wide, 3).otherwise(2).alias("graph_depth"),
        F.when(blank, 5).otherwise(15).alias("top_k"),
        F.when(blank, 4000).otherwise(6000).alias("context_budget"),
        (_count(q, fixed.VISUAL_PATTERNS) > 0).alias("need_visual"),
    )


def extracted_entities(text: Column) -> Column:
    """Words of a query that can name an entity: three letters or more, no stop words."""
    return F.array_distinct(F.filter(word_tokens(text), lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]") & ~t.isin(fixed.ENTITY_STOPWORDS)))
