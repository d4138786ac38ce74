"""Retrieval, answer and citation metrics as columns; each has its own rule for empty inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.functions.fixed import ANSWER_STOPWORDS


def ranked(ids: Column) -> Column:
    """A ranking without blanks, each id at its first place."""
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x.cast("string") != "")))


def _hits(expected: Column, retrieved: Column, k: Column | int | None = None) -> Column:
    top = ranked(retrieved) if k is None else F.slice(ranked(retrieved), F.lit(1), k if isinstance(k, Column) else F.lit(k))
    return F.size(F.array_intersect(top, expected)).cast("double")


def _empty(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) <= 0


def precision_at(expected: Column, retrieved: Column, k: int) -> Column:
    return F.when(_empty(expected) | _empty(retrieved), 0.0).otherwise(_hits(expected, retrieved, k) / k)


def r_precision(expected: Column, retrieved: Column) -> Column:
    n = F.size(F.array_distinct(expected))
    return F.when(_empty(expected) | _empty(retrieved), 0.0).otherwise(_hits(expected, retrieved, F.greatest(n, F.lit(1))) / n)


def recall_at(expected: Column, retrieved: Column, k: int) -> Column:
    return F.when(_empty(expected), 1.0).when(_empty(retrieved), 0.0).otherwise(_hits(expected, retrieved, k) / F.size(F.array_distinct(expected)))


def hit_at(expected: Column, retrieved: Column, k: int) -> Column:
    return F.when(_empty(expected), 1.0).when(_empty(retrieved), 0.0).otherwise(F.when(_hits(expected, retrieved, k) > 0, 1.0).otherwise(0.0))


def reciprocal_rank(expected: Column, retrieved: Column, k: int | None = None) -> Column:
    """One over the place of the first expected id; 0 if there is none or either side is empty."""
    r = ranked(retrieved)
    r = r if k is None else F.slice(r, 1, k)
    first = F.array_min(F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull()))
    return F.when(_empty(expected) | _empty(retrieved), 0.0).otherwise(F.coalesce(1.0 / first, F.lit(0.0)))


def ndcg_at(expected: Column, retrieved: Column, k: int) -> Column:
    gain = F.aggregate(F.transform(F.slice(ranked(retrieved), 1, k), lambda x, i: F.when(F.array_contains(expected, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(F.array_distinct(expected)), F.lit(k)))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return F.when(_empty(expected), 1.0).when(_empty(retrieved), 0.0).otherwise(gain / ideal)


def context_recall(expected: Column, context: Column) -> Column:
    return F.when(_empty(expected), 1.0).when(_empty(context), 0.0).otherwise(_hits(expected, context) / F.size(F.array_distinct(expected)))


def token_f1(truth: Column, answer: Column) -> Column:
    """Harmonic mean of precision and recall over the multiset of common tokens."""
    a, b = X.word_tokens(truth), X.word_tokens(answer)
    return F.transform(
        F.array(F.struct(a.alias("a"), b.alias("b"))),
        lambda s: F.transform(
            F.array(F.aggregate(F.array_distinct(s["a"]), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(s["a"], lambda x: x == w)), F.size(F.filter(s["b"], lambda x: x == w))))),
            lambda c: F.when(c == 0, 0.0).otherwise(2.0 * c / (F.size(s["a"]) + F.size(s["b"]))),
        )[0],
    )[0]


def lexical_jaccard(truth: Column, answer: Column) -> Column:
    """Jaccard similarity of content stems; 1 if both are empty, 0 if one is."""
    return F.transform(
        F.array(F.struct(X.content_stems(truth).alias("a"), X.content_stems(answer).alias("b"))),
        lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), 1.0)
        .when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))),
    )[0]


def keyword_recall(keywords: Column, answer: Column) -> Column:
    """Share of keywords in an answer: as they are, by all their content words (or stems), or with or without a final s."""
    text, own = F.lower(F.coalesce(answer, F.lit(""))), X.word_tokens(answer)

    def hit(kw: Column) -> Column:
        low = F.lower(kw)
        parts = F.filter(X.word_tokens(kw), lambda t: ~t.isin(ANSWER_STOPWORDS))
        every = (F.size(parts) > 0) & F.forall(parts, lambda t: F.array_contains(own, t) | F.contains(text, X.answer_stem(t)))
        s = F.when(low.endswith("s"), F.contains(text, F.substring(low, F.lit(1), F.length(low) - 1))).otherwise(F.lit(False)) | F.contains(text, F.concat(low, F.lit("s")))
        return (kw.isNotNull() & (kw != "")) & (F.contains(text, low) | every | s)

    return F.when(_empty(keywords) | (text == ""), 0.0).otherwise(F.size(F.filter(keywords, hit)) / F.size(keywords))


def citation_coverage(expected: Column, cited: Column) -> Column:
    return F.when(_empty(expected), 1.0).when(_empty(cited), 0.0).otherwise(F.size(F.filter(expected, lambda x: F.array_contains(cited, x))) / F.size(expected))


def citation_precision(cited: Column, context: Column) -> Column:
    """Share of cited ids that were in the context; without citations 1 only if there was no context."""
    return F.when(_empty(cited), F.when(_empty(context), 1.0).otherwise(0.0)).otherwise(F.size(F.filter(cited, lambda x: F.array_contains(context, x))) / F.size(cited))


def chunk_coverage(cited: Column, reranked: Column) -> Column:
    return F.when(_empty(reranked), F.when(_empty(cited), 1.0).otherwise(0.0)).otherwise(F.size(F.array_distinct(cited)) / F.size(reranked))


def summary(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, nearest-rank p95, least, greatest and number of each metric, nulls left out."""
    long = rows.unpivot(by or [], metrics, "metric", "value").filter("value is not null")
    p95 = F.expr("percentile_disc(0.95) within group (order by value)")
    return long.groupBy(*(by or []), "metric").agg(F.avg("value").alias("mean"), p95.alias("p95"), F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))
