"""Names, types, evidence and frames that come out of models: matching, normalising, checking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed

SSIM_C1, SSIM_C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def entity_type(raw: Column) -> Column:
    """The canonical entity type in any case; an alias's type; else Concept."""
    low = F.lower(F.trim(raw))
    table = {t.lower(): t for t in fixed.ENTITY_TYPES} | fixed.ENTITY_TYPE_ALIASES
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), low), F.lit("Concept"))


def relation_type(raw: Column) -> Column:
    """The canonical relation type in any case, else null: the relation is rejected."""
    up = F.upper(F.trim(raw))
    return F.when(up.isin(fixed.RELATIONS), up)


def query_entities(query: Column) -> Column:
    """Mentions in a query, sorted: capitalised phrases and acronyms without stop words at their ends, and significant words in lower case."""
    stop = fixed.ENTITY_STOPWORDS
    phrases = F.regexp_extract_all(query, F.lit("\\b[A-Z][a-zA-Z]{2,}(?:\\s+[A-Z][a-zA-Z]+)*\\b|\\b[A-Z]{2,}\\b"), F.lit(0))

    def stripped(p: Column) -> Column:
        w = F.split(p, "\\s+")
        good = F.filter(F.transform(w, lambda x, i: F.when(~F.lower(x).isin(stop), i + 1)), lambda x: x.isNotNull())
        first, last = F.array_min(good), F.array_max(good)
        return F.when(F.size(good) > 0, F.array_join(F.slice(w, first, last - first + 1), " ")).otherwise("")

    named = F.filter(F.transform(phrases, stripped), lambda p: F.length(p) >= 2)
    words = F.filter(F.transform(F.regexp_extract_all(query, F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.lower), lambda t: ~t.isin(stop))
    return F.array_sort(F.array_distinct(F.concat(named, words)))


def refused(answer: Column, phrases: list[str] | None = None) -> Column:
    """Whether an answer says that it can't answer; the phrases are a parameter."""
    a, out = F.lower(F.coalesce(answer, F.lit(""))), F.lit(False)
    for p in phrases or fixed.REFUSALS:
        out = out | F.contains(a, F.lit(p))
    return out


def quoted(text: Column) -> Column:
    """Lower case without punctuation, blanks collapsed (ASCII): what evidence is compared by."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_\\s]", ""), "\\s+", " "))


def used_constituents(blocks: DataFrame, constituents: DataFrame, snippet: int = 40) -> DataFrame:
    """query_id, block_id, chunk_id of the constituents whose first characters are in what was kept of their block."""
    j = constituents.join(blocks.select("query_id", "block_id", "kept"), ["query_id", "block_id"])
    return j.filter(F.contains("kept", F.trim(F.substring("text", 1, snippet)))).select("query_id", "block_id", "chunk_id")


def capped_blocks(blocks: DataFrame, budget: int, separator: int = 7, least: int = 300) -> DataFrame:
    """query_id, block_id, cap: the most characters of each block of a lecture-wide context; a single block has no cap."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    cap = F.greatest(F.lit(least), F.floor((budget - (n - 1) * separator) / n))
    return blocks.select("query_id", "block_id", F.when(n > 1, cap).cast("long").alias("cap"))


def pruned(items: DataFrame, budget: int, least: int = 2) -> DataFrame:
    """items (window_id, pos, tier, cost) kept by tier and place while their costs fit, always `least`; in original order, with aliases."""
    order = Window.partitionBy("window_id").orderBy(F.desc("tier"), "pos")
    k = items.withColumns({"used": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_r": F.row_number().over(order)})
    k = k.filter((F.col("used") <= budget) | (F.col("_r") <= least))
    alias = F.row_number().over(Window.partitionBy("window_id").orderBy("pos"))
    return k.select("window_id", "pos", "tier", F.concat(F.lit("E"), alias.cast("string")).alias("alias"))


def merged_sources(rows: DataFrame, source: str, order: str, identity: Column, least: int, most: int) -> DataFrame:
    """source, provided, used, kept: sources of at least `least` rows give their first `most`; of equal rows the first source's stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy(source))
    r = rows.withColumns({"_n": n, "_r": F.row_number().over(Window.partitionBy(source).orderBy(order)), "_id": identity})
    r = r.withColumn("_used", (F.col("_n") >= least) & (F.col("_r") <= most))
    first = F.row_number().over(Window.partitionBy("_used", "_id").orderBy(source, order))
    r = r.withColumn("_kept", F.col("_used") & (first == 1))
    count = lambda c: F.sum(F.col(c).cast("long"))
    return r.groupBy(source).agg(F.count(F.lit(1)).alias("provided"), count("_used").alias("used"), count("_kept").alias("kept"))


def prerequisite_issues(edges: DataFrame, markers: list[str]) -> DataFrame:
    """edges (src, dst, src_name, dst_name, t_src, t_dst, confidence, discourse, graph) with their issues; a loop has no other."""
    loop = (F.col("src") == F.col("dst")) | (F.col("src_name") == F.col("dst_name"))
    weak = ~((F.col("confidence") >= 0.65) & ((F.col("discourse") > 0) | (F.col("graph") > 0)))
    marked = F.lit(False)
    for x in markers:
        marked = marked | F.contains(F.lower("dst_name"), F.lit(x.lower()))
    rest = F.array(F.when(F.col("t_src") > F.col("t_dst"), "TEMPORAL_INVERSION"), F.when(weak, "UNSUPPORTED"), F.when(marked, "NON_PEDAGOGICAL"))
    issues = F.when(loop, F.array(F.lit("SELF_LOOP"))).otherwise(F.filter(rest, lambda x: x.isNotNull()))
    return edges.select("src", "dst", F.explode(issues).alias("issue"))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two grey images from their whole means, variances and covariance."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    m, n = a.mean(), b.mean()
    return float((2 * m * n + SSIM_C1) * (2 * ((a - m) * (b - n)).mean() + SSIM_C2) / ((m * m + n * n + SSIM_C1) * (a.var() + b.var() + SSIM_C2)))


def keyframes(frames: DataFrame, cooldown: float = 2.0, longest: float = 30.0, alike: float = 0.75) -> DataFrame:
    """frames (lecture_id, ts, pixels) -> lecture_id, ts: the first frame; then, after a cooldown, one unlike the last chosen, or after `longest` any.

    What is chosen depends on the frame chosen before, so a lecture is one task.
    """

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for r in rows.sort_values("ts").itertuples():
            if last is None or (r.ts - last.ts >= cooldown and (r.ts - last.ts >= longest or ssim(r.pixels, last.pixels) < alike)):
                kept.append((r.lecture_id, r.ts))
                last = r
        return pd.DataFrame(kept, columns=["lecture_id", "ts"])

    return frames.groupBy("lecture_id").applyInPandas(chosen, "lecture_id string, ts double")
