"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector w for all thresholds
theta_0 < theta_1 < ..., so grades share what they learn.  x counts marker
features of a text: whole words, and five-letter pieces of words (with marks at
both ends), kept where labelled toxic texts have them far more often than clean
ones.  The output is the distribution's mean, the expected severity.

Grades are the labels' own values, in order (0 and below: clean).  Where labels say
only 0 or 1, a toxic text is graded 1, 2 or 3 by its number of words with markers -
one, two or three, more - chosen on the half of the sample that the text isn't in.

Features are taken from the texts inside tasks; the driver sees counts of features
and, for each text of the bounded sample, the numbers of its markers.

Defined results: null and empty texts have grade 0 and the severity of a text
without features; repeated rows get equal results; texts are read whole.
Without a toxic or a clean label every severity is 0.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.llm.language_id import bare
from quillspan.llm.shared import WordTable, chunks_of, cut, kept, sampled_per_class

PIECE = 5


def features(word: str) -> list[str]:
    """A word's own feature and its five-letter pieces, with ^ and $ at its ends."""
    w = bare(word)
    if not w:
        return []
    marked = f"^{w}$"
    return ["=" + w] + list({marked[i : i + PIECE] for i in range(len(marked) - PIECE + 1)})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def likelihood(w: np.ndarray, th: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of grades y under a cumulative-link model, and its slopes in weights and thresholds.

    rows, cols: a text and a marker for each occurrence.
    """
    x = np.bincount(rows, weights=w[cols], minlength=len(y)) if len(rows) else np.zeros(len(y))
    p = sigmoid(x[:, None] - th[None, :])  # P(grade > k)
    full = np.hstack([np.ones((len(y), 1)), p, np.zeros((len(y), 1))])
    each = np.arange(len(y))
    mass = np.maximum(full[each, y] - full[each, y + 1], 1e-12)  # P(grade = y)
    k = np.arange(len(th))[None, :]
    sign = np.where(k == y[:, None] - 1, 1.0, 0.0) - np.where(k == y[:, None], 1.0, 0.0)
    slope = p * (1 - p) * sign / mass[:, None]
    d_x = slope.sum(1) / len(y)
    d_w = np.bincount(cols, weights=d_x[rows], minlength=len(w)) if len(rows) else np.zeros(len(w))
    return float(np.log(mass).mean()), d_w, -slope.sum(0) / len(y)


@dataclass
class OrdinalModel:
    """Weights of marker features, and ascending thresholds between the grades' values (the first is clean)."""

    markers: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Sum of the weights of each word's features."""
        get, w = self.markers.get, self.weights
        return np.array([sum(w[i] for i in map(get, features(x)) if i is not None) for x in words], np.float64)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, markers: list[str], rows: np.ndarray, cols: np.ndarray, y: np.ndarray, values: list[float], steps: int = 1500, rate: float = 0.3) -> OrdinalModel:
        """Maximise the likelihood by AdaGrad, projected so that markers never lower a grade and thresholds stay in order."""
        grades = len(values) - 1
        w, th = np.full(len(markers), 0.5), np.arange(grades) * 1.0 + 1.0
        g_w, g_t = np.full(len(markers), 1e-8), np.full(grades, 1e-8)
        for _ in range(steps):
            _, d_w, d_t = likelihood(w, th, rows, cols, y)
            d_w = d_w - 1e-4 * w
            g_w += d_w**2
            g_t += d_t**2
            w = np.maximum(0.0, w + rate * d_w / np.sqrt(g_w))
            th = np.maximum.accumulate(th + rate * d_t / np.sqrt(g_t) + np.arange(grades) * 1e-6)
        return cls({f: i for i, f in enumerate(markers)}, w, th, np.array(values, float))


def level(hits: np.ndarray, grades: int) -> np.ndarray:
    """Grade of a toxic text by its words with markers: 1 for at most one, and one more each time their number doubles."""
    return np.minimum(1 + np.floor(np.log2(np.maximum(hits, 1))).astype(np.int64), grades)


def _featured(batches: Iterator[pa.RecordBatch], among: set[str] | None) -> Iterator[pa.RecordBatch]:
    """toxic, fold, feature, c: in how many texts of this task each feature is."""
    memo: dict[str, list[str]] = {}
    seen: Counter = Counter()
    for batch in batches:
        for text, toxic, fold in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            found: set[str] = set()
            for w in set(text.split()):
                if w not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[w] = features(w) if among is None else [f for f in features(w) if f in among]
                found.update(memo[w])
            seen.update((toxic > 0, fold, f) for f in found)
    toxic, fold, feature = zip(*seen, strict=True) if seen else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.bool_()), pa.array(fold, pa.int32()), pa.array(feature, pa.string()), pa.array(list(seen.values()), pa.int64())], ["toxic", "fold", "feature", "c"])


def feature_counts(sample: DataFrame, among: set[str] | None = None) -> DataFrame:
    """feature, fold, c: texts of sample (text, toxic, fold) with a feature, of all or of some features."""
    counts = sample.mapInArrow(lambda b: _featured(b, among), "toxic boolean, fold int, feature string, c long")
    return counts.groupBy("feature", "fold").agg(F.sum("c").alias("c"))


def chosen_markers(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least_ratio: float = 8.0) -> list[str]:
    """Features that toxic texts have at least least_ratio times as often, and clean ones hardly ever."""
    lift = lambda f: ((toxic[f] + 0.5) / max(n_toxic, 1)) / ((clean.get(f, 0) + 0.5) / max(n_clean, 1))
    often = max(3, 0.002 * n_toxic)
    return sorted(f for f, c in toxic.items() if c >= often and clean.get(f, 0) <= 0.002 * n_clean + 1 and lift(f) >= least_ratio)


def marked(sample: DataFrame, markers: list[str], by_fold: list[list[str]]) -> DataFrame:
    """toxic, hits (words with a marker of the text's own fold's list), cols (numbers of markers, one for each occurrence) for each text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = {f: i for i, f in enumerate(markers)}, [set(x) for x in by_fold]
        memo: dict[str, tuple[list[int], list[bool]]] = {}
        for batch in batches:
            hits, cols = [], []
            for text, fold in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), strict=True):
                n, at = 0, []
                for w in text.split():
                    if w not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        names = features(w)
                        memo[w] = [number[f] for f in names if f in number], [any(f in x for f in names) for x in own]
                    at += memo[w][0]
                    n += memo[w][1][fold]
                hits.append(n)
                cols.append(at)
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(hits, pa.int64()), pa.array(cols, pa.list_(pa.int32()))], ["toxic", "hits", "cols"])

    return sample.mapInArrow(mark, "toxic int, hits long, cols array<int>")


def predictor(spark, model: OrdinalModel):
    """A column function text -> struct<grade, severity, p_toxic>."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @pandas_udf("struct<grade:int,severity:double,p_toxic:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own, table = kept(name, lambda: (shared.value, WordTable(shared.value.word_rows)))
        parts = []
        for _, words, counts in chunks_of(texts, 120_000, str.split):
            scores = np.zeros(len(counts))
            if words:
                ends = np.cumsum(counts)
                sums = np.concatenate([[0.0], np.cumsum(table.look(words))])
                scores = np.maximum(0.0, sums[ends] - sums[ends - counts])
            p = own.above(scores)
            v = own.values
            parts.append((v[np.sum(p > 0.5, axis=1)], v[0] + p @ np.diff(v), p[:, 0] if p.shape[1] else np.zeros(len(p))))
        if not parts:
            return pd.DataFrame({"grade": [], "severity": [], "p_toxic": []})
        grade, severity, p_toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"grade": grade.astype(np.int32), "severity": severity, "p_toxic": p_toxic})

    return predict.asNondeterministic()  # else a filter and a projection would each run it


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_features: int = 100_000, grades: int = 3, steps: int = 1500) -> OrdinalModel:
    """Fit on a bounded sample: at most per_class texts of each grade, chosen by a hash of doc_id (one text for each id), and the most_features most frequent features of toxic ones.

    A document labelled more than once has its highest label; null ids and labels are left out.
    """
    one = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.greatest(F.max(F.col("toxic").cast("int")), F.lit(0)).alias("toxic"))
    chosen = sampled_per_class(one, "toxic", "doc_id", per_class).select("doc_id", "toxic")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    # chosen: at most per_class rows of two integers for each grade; of rows with one id one is learned from
    labelled = docs.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = cut(labelled.select("text", "toxic", fold), "labelled")
    rows = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    n = lambda toxic, folds: sum(c for (t, f), c in rows.items() if (t > 0) == toxic and f in folds)
    if not n(True, (0, 1)) or not n(False, (0, 1)):
        return OrdinalModel()
    often = feature_counts(sample.filter("toxic > 0")).groupBy("feature").agg(*[F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in (0, 1)])
    often = often.withColumn("c", F.col("c0") + F.col("c1")).filter(F.col("c") >= 3).orderBy(F.desc("c"), "feature").limit(most_features).toArrow()
    toxic = [dict(zip(often["feature"].to_pylist(), often[f"c{k}"].to_pylist(), strict=True)) for k in (0, 1)]
    found = feature_counts(sample.filter("toxic = 0"), set(toxic[0])).toArrow()
    clean: list[dict[str, int]] = [{}, {}]
    for f, k, c in zip(*(found[c].to_pylist() for c in ("feature", "fold", "c")), strict=True):
        clean[k][f] = c
    both = lambda x: {f: x[0].get(f, 0) + x[1].get(f, 0) for f in {*x[0], *x[1]}}
    markers = chosen_markers(both(toxic), both(clean), n(True, (0, 1)), n(False, (0, 1)))
    values = sorted({0, *(t for t, _ in rows)})
    by_fold = [chosen_markers(toxic[1 - k], clean[1 - k], n(True, (1 - k,)), n(False, (1 - k,))) for k in (0, 1)] if len(values) == 2 else [[], []]
    seen = marked(sample, markers, by_fold).toArrow()
    seen = sorted(zip(*(seen[c].to_pylist() for c in ("toxic", "hits", "cols")), strict=True))
    stated = np.array([t for t, _, _ in seen])
    if len(values) == 2:  # only toxic or not
        y, values = np.where(stated > 0, level(np.array([h for _, h, _ in seen]), grades), 0), list(range(grades + 1))
    else:
        y = np.searchsorted(np.array(values), stated)
    row = np.repeat(np.arange(len(seen)), [len(c) for _, _, c in seen])
    return OrdinalModel.fit(markers, row, np.array([i for _, _, c in seen for i in c], np.int64), y, values, steps)


def toxicity_column(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    return predictor(docs.sparkSession, train(docs, labels))(text)


def grade(docs: DataFrame, labels: DataFrame, reject_above: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, grade (most likely by medians), severity (expected grade), p_toxic, rejected (p_toxic above the limit)."""
    d = docs.select("doc_id", "text")
    p = d.select("doc_id", toxicity_column(d, labels, F.col("text")).alias("_p"))
    return p.select("doc_id", "_p.grade", "_p.severity", "_p.p_toxic", (F.col("_p.p_toxic") > reject_above).alias("rejected"))
