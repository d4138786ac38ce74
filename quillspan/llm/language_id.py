"""Language identification of words in code-switched text by a linear-chain CRF.

Every word is a node of a chain whose states are the learned languages.  A
word's potentials are sums of weights of its affixes, character n-grams and
lexicon entries; learned transitions tie neighbours.  Forward-backward over the
whole text gives each word's posterior, and a document's language is the one
with the largest posterior sum.

Defined results: null text, or text without a letter, is `und` with score 0.
Repeated rows get equal results; texts of any length are read whole (long
chains are cut into blocks whose transfer matrices are multiplied, which is
exact).  With no labelled row at all every document is `und`.  Of equally likely
languages the first in code-point order wins; rows with a null id are learned from.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.llm.shared import WordTable, chunks_of, id_remainder, kept, sampled_per_class

UNDETERMINED = "und"
#: Words of a block; steps after which products are scaled again.
BLOCK, SCALED = 128, 4


def bare(word: str) -> str:
    """The word without case and without what isn't a letter at its ends."""
    w = word.lower()
    if w.isalpha():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while b > a and not w[b - 1].isalpha():
        b -= 1
    return w[a:b]


def _key(*letters):
    """One number for up to three letters (numbers or arrays of them)."""
    out = letters[0]
    for x in letters[1:]:
        out = (out << 21) | x
    return out


def features(word: str) -> list[str]:
    """Affix, n-gram and lexicon features; none for a word without letters."""
    w = bare(word)
    if not w:
        return []
    n = len(w)
    out = ["=" + w]
    for k in (1, 2, 3):
        if n > k:
            out += ["<" + w[:k], ">" + w[-k:]]
    out += [w[i : i + 2] for i in range(n - 1)]
    out += [w[i : i + 3] for i in range(n - 2)]
    return out


@dataclass
class ChainCRF:
    """Weights of a linear-chain CRF; train() fits them, posteriors() applies them."""

    states: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    transitions: np.ndarray | None = None
    _lookup: tuple | None = field(default=None, repr=False, compare=False)

    def _tables(self) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[str, int]]:
        """Sorted keys and numbers of the vocabulary's short strings (by length; of four by their first sign too), and of all that begin with `=`."""
        if self._lookup is None or self._lookup[0] is not self.vocabulary:
            short: dict[int, list[tuple[int, int]]] = {2: [], 3: [], ord("<"): [], ord(">"): []}
            for f, i in self.vocabulary.items():
                c = [ord(x) for x in f]
                if len(c) in (2, 3):
                    short[len(c)].append((_key(*c), i))
                elif len(c) == 4 and c[0] in short:
                    short[c[0]].append((_key(*c[1:]), i))
            tables = {}
            for kind, found in short.items():
                found.sort()
                # a last key that nothing has, so that any place is one of the table
                tables[kind] = np.array([k for k, _ in found] + [-1], np.int64), np.array([i for _, i in found] + [-1], np.int64)
            self._lookup = self.vocabulary, tables, {f[1:]: i for f, i in self.vocabulary.items() if f[0] == "="}
        return self._lookup[1:]

    def _known(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number) of all features of bare words, of n letters each, that the vocabulary has: those of features(), for all words at once."""
        tables, lexicon = self._tables()
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), n)
        first = np.cumsum(n) - n
        rest = np.repeat(first + n, n) - np.arange(len(c))  # letters from here to the word's end
        more = np.concatenate([c, np.zeros(3, np.int64)])
        pairs, threes = np.flatnonzero(rest >= 2), np.flatnonzero(rest >= 3)
        asked = [(2, word[pairs], _key(c[pairs], more[pairs + 1])), (3, word[threes], _key(c[threes], more[threes + 1], more[threes + 2]))]
        for k in (1, 2, 3):
            own = np.flatnonzero(n > k)
            for sign, at in (("<", first[own]), (">", first[own] + n[own] - k)):
                letters = [more[at + j] for j in range(k)]
                asked.append((ord(sign), own, _key(*letters)) if k == 3 else (k + 1, own, _key(ord(sign), *letters)))
        owners, numbers = [], []
        for kind, owner, key in asked:
            keys, ids = tables[kind]
            at = np.searchsorted(keys[:-1], key)
            on = keys[at] == key
            owners.append(owner[on])
            numbers.append(ids[at[on]])
        whole = np.fromiter(map(lexicon.get, words, repeat(-1)), np.int64, len(words))
        on = np.flatnonzero((whole >= 0) & (n > 0))
        return np.concatenate([*owners, on]), np.concatenate([*numbers, whole[on]])

    def word_rows(self, words: list[str]) -> np.ndarray:
        """exp of each word's potentials (largest 1), and a last column: 1 if it has a letter."""
        bared = list(map(bare, words))
        n = np.fromiter(map(len, bared), np.int64, len(words))
        owner, numbers = self._known(bared, n)
        sums = np.zeros((len(words), len(self.states)))
        for k in range(len(self.states)):
            sums[:, k] = np.bincount(owner, weights=self.weights[numbers, k], minlength=len(words))
        sums -= sums.max(axis=1, keepdims=True)
        return np.hstack([np.exp(np.maximum(sums, -30.0)), (n > 0).astype(float)[:, None]])

    @classmethod
    def train(cls, texts: list[str], labels: list[str], lexicon: int = 4000, span: int = 48, spans: int = 6000, epochs: int = 4, rate: float = 0.25, seed: int = 7) -> ChainCRF:
        """Maximum likelihood by AdaGrad on spans of words.

        Half of the spans come from one text; the other half switch between texts
        of different languages, so that transitions see switches.  The vocabulary
        keeps features seen at least 3 times, and words among the `lexicon` most
        frequent of a language.
        """
        states = sorted(set(labels))
        model = cls(states)
        rng = np.random.default_rng(seed)
        by_state = [[t.split() for t, y in zip(texts, labels, strict=True) if y == s and t and t.strip()] for s in states]
        seen: Counter = Counter()
        frequent: set[str] = set()
        for docs in by_state:
            words = Counter(w for d in docs for w in d)
            bared = Counter()
            for w, c in words.items():
                for f in features(w):
                    if f[0] == "=":
                        bared[f] += c
                    else:
                        seen[f] += c
            frequent.update(f for f, c in sorted(bared.items(), key=lambda x: (-x[1], x[0]))[:lexicon] if c > 1)
        kept = sorted(frequent) + sorted(f for f, c in seen.items() if c >= 3)
        model.vocabulary = {f: i for i, f in enumerate(kept)}
        s = len(states)
        model.weights, model.transitions = np.zeros((len(kept), s)), np.eye(s) * 2.0
        if s < 2 or not kept:
            return model
        live = [k for k in range(s) if by_state[k]]

        def piece(k: int, n: int) -> list[str]:
            d = by_state[k][rng.integers(len(by_state[k]))]
            a = rng.integers(max(1, len(d) - n + 1))
            return d[a : a + n]

        sequences = []
        for i in range(spans):
            words, ys = [], []
            while len(words) < span:
                k = int(rng.choice(live))
                own = piece(k, span if i % 2 == 0 else int(rng.integers(6, 24)))
                words += own
                ys += [k] * len(own)
                if i % 2 == 0:
                    break
            sequences.append((words[:span], ys[:span]))
        ids: dict[str, np.ndarray] = {}
        get = model.vocabulary.get
        for words, _ in sequences:
            for w in words:
                if w not in ids:
                    ids[w] = np.array([i for i in map(get, features(w)) if i is not None], np.int64)
        g_w, g_t = np.full(model.weights.shape, 1e-6), np.full((s, s), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for start in range(0, len(order), 64):
                model._step([sequences[i] for i in order[start : start + 64]], ids, g_w, g_t, rate, span)
        return model

    def _step(self, batch, ids, g_w, g_t, rate, span) -> None:
        s, n = len(self.states), len(batch)
        lengths = np.array([len(w) for w, _ in batch])
        emit, gold, real = np.zeros((span, n, s)), np.zeros((span, n), np.int64), np.zeros((span, n), bool)
        flat, owner = [], []
        for b, (words, ys) in enumerate(batch):
            for t, (w, y) in enumerate(zip(words, ys, strict=True)):
                flat.append(ids[w])
                owner.append((t * n + b, len(ids[w])))
                gold[t, b], real[t, b] = y, True
        index = np.concatenate(flat)
        rows = np.repeat(np.array([o for o, _ in owner]), np.array([c for _, c in owner]))
        np.add.at(emit.reshape(-1, s), rows, self.weights[index])
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        tr = np.exp(self.transitions)
        fwd, bwd = np.empty((span, n, s)), np.ones((span, n, s))
        a = e[0] / e[0].sum(1, keepdims=True)
        fwd[0] = a
        for t in range(1, span):
            b = (a @ tr) * e[t]
            b /= b.sum(1, keepdims=True)
            a = np.where(real[t][:, None], b, a)
            fwd[t] = a
        b = np.ones((n, s))
        pair = np.zeros((s, s))
        for t in range(span - 1, 0, -1):
            m = (e[t] * b) @ tr.T
            own = fwd[t - 1][:, :, None] * tr[None] * (e[t] * b)[:, None, :]
            own /= own.sum((1, 2), keepdims=True)
            pair += own[real[t]].sum(0)
            m /= m.sum(1, keepdims=True)
            b = np.where(real[t][:, None], m, b)
            bwd[t - 1] = b
        post = fwd * bwd
        post /= post.sum(2, keepdims=True)
        np.subtract.at(post.reshape(-1, s), (np.arange(span * n), gold.ravel()), 1.0)
        d = post.reshape(-1, s)[rows] / n
        grad = np.zeros_like(self.weights)
        np.add.at(grad, index, d)
        touched = np.unique(index)
        grad = grad[touched] + 1e-5 * self.weights[touched]
        g_w[touched] += grad**2
        self.weights[touched] -= rate * grad / np.sqrt(g_w[touched])
        both = real[1:] & real[:-1]
        np.subtract.at(pair, (gold[:-1][both], gold[1:][both]), 1.0)
        pair = pair / n + 1e-4 * self.transitions
        g_t += pair**2
        self.transitions -= 0.2 * rate * pair / np.sqrt(g_t)
        assert len(lengths) == n

    def document_sums(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of the words' posteriors for each document, over words with letters.

        rows: word_rows of all words in order; counts: words of each document.
        """
        s, docs = len(self.states), len(counts)
        out = np.zeros((docs, s))
        if not len(rows):
            return out
        tr = np.exp(self.transitions)
        tr = tr / tr.sum(1, keepdims=True).max()
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        per = -(-counts // BLOCK)
        doc = np.repeat(np.arange(docs), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = starts[doc] + nth * BLOCK
        length = np.minimum(BLOCK, counts[doc] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, doc, nth = begin[order], length[order], doc[order], nth[order]
        n = len(order)
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        e, letters = rows[:, :s], rows[:, s]
        ones = np.ones((s, 1))  # a product with it sums short rows faster than sum() does
        # transfer matrix of each block; potentials are e**-30 at least, so a few steps can't underflow
        move = np.broadcast_to(np.eye(s), (n, s, s)).copy()
        for t in range(int(length[0])):
            k = active[t]
            m = (move[:k].reshape(-1, s) @ tr).reshape(k, s, s) * e[begin[:k] + t][:, None, :]
            move[:k] = m / m.max(axis=(1, 2), keepdims=True) if t % SCALED == SCALED - 1 else m
        move /= move.max(axis=(1, 2), keepdims=True)
        # along the blocks of each document, forward and backward
        where = np.full((docs, int(per.max())), -1)
        where[doc, nth] = np.arange(n)
        first, last = np.empty((n, s)), np.empty((n, s))
        a = np.full((docs, s), 1.0 / s)
        for j in range(where.shape[1]):
            on = where[:, j] >= 0
            w = where[on, j]
            first[w] = a[on]
            m = np.einsum("ns,nst->nt", a[on], move[w])
            a[on] = m / m.sum(1, keepdims=True)
        b = np.ones((docs, s))
        for j in range(where.shape[1] - 1, -1, -1):
            on = where[:, j] >= 0
            w = where[on, j]
            last[w] = b[on]
            m = np.einsum("nst,nt->ns", move[w], b[on])
            b[on] = m / m.max(1, keepdims=True)
        # inside the blocks
        steps = int(length[0])
        fwd = np.zeros((steps, n, s), np.float32)
        a = first
        for t in range(steps):
            k = active[t]
            m = (a[:k] @ tr) * e[begin[:k] + t]
            a[:k] = m / (m @ ones)
            fwd[t, :k] = a[:k]
        sums = np.zeros((n, s))
        b = last
        for t in range(steps - 1, -1, -1):
            k = active[t]
            p = fwd[t, :k] * b[:k]
            at = begin[:k] + t
            sums[:k] += p * (letters[at][:, None] / (p @ ones))
            m = (e[at] * b[:k]) @ tr.T
            b[:k] = m / (m @ ones) if t % SCALED == 0 else m
        np.add.at(out, doc, sums)
        return out


def predictor(spark, model: ChainCRF, name: str):
    """A column function text -> struct<lang, score>; the model is broadcast (its size is bounded by the training sample)."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        crf, table = kept(name, lambda: (shared.value, WordTable(shared.value.word_rows)))
        langs, scores = [], []
        for _, words, counts in chunks_of(texts, 120_000, str.split):
            if crf.states:
                at = table.indices(words)
                rows = table.rows[at] if len(at) else np.zeros((0, len(crf.states) + 1))
                sums = crf.document_sums(rows, counts)
                total, best = sums.sum(1), sums.argmax(1)
            else:
                total = best = np.zeros(len(counts), np.int64)
                sums = np.zeros((len(counts), 1))
            for k in range(len(counts)):
                known = total[k] > 0
                langs.append(crf.states[best[k]] if known else UNDETERMINED)
                scores.append(min(1.0, float(sums[k, best[k]] / total[k])) if known else 0.0)
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict.asNondeterministic()  # else a filter and a projection would each run it


def labelled_sample(docs: DataFrame, per_language: int = 150, most_rows: int = 9600, most_chars: int = 4_000_000) -> DataFrame:
    """text, lang: at most per_language texts of each language that may be learned from, about most_rows in all, of at most most_chars characters a language (but one text).

    Of rows with one id, null included, the text of the least hash stands for all.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    chosen = sampled_per_class(labelled, "lang", "doc_id", per_language, most_rows).withColumnsRenamed({"lang": "_lang", "doc_id": "_id"})
    rows = labelled.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")))  # at most most_rows, or one a language
    one = rows.groupBy("lang", "doc_id", "_share").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("_least")).select("lang", "_share", F.col("_least.t").alias("text"))
    until = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("_share", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return one.withColumn("_until", until).filter((F.col("_until") <= most_chars) | (F.col("_until") == F.length("text"))).select("text", "lang")


def train(docs: DataFrame, per_language: int = 150, most_rows: int = 9600, **options) -> ChainCRF:
    """Fit the CRF on labelled_sample(): a bounded number of whole texts of each language.

    Every language is learned; with more than most_rows / per_language of them each has
    fewer texts, at least one.  Rows whose crc32(doc_id) mod 3 is 1, and rows
    without text or language, are never learned from.
    """
    rows = sorted(labelled_sample(docs, per_language, most_rows).collect())
    return ChainCRF.train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def language_column(docs: DataFrame, text: Column) -> Column:
    """struct<lang, score> for a text column, from a model learned from docs."""
    import uuid

    return predictor(docs.sparkSession, train(docs), uuid.uuid4().hex)(text)


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    d = docs.select("doc_id", "text", "lang")
    return d.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), language_column(d, F.col("text")).alias("_p")).select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
