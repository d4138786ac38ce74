"""Language-model scores: a causal self-attention model on subword ids, trained in numpy.

The model predicts a text's words, lower-cased in A-Z and each with a space before
it, as ids of a public byte-level BPE, then one end.  Only the most frequent ids are
in its vocabulary; any other id is spelled by byte ids, so every text has a
probability.  One layer of causal self-attention over a window of ids gives a state
h; the logit of id v is

    corpus(v | inner context) + u_v . h

where corpus() are smoothed log counts, over all training texts, of ids after up to
three earlier ids of the same word (longer contexts where they are frequent); words'
counts are summed first, and ids are counted once per distinct word.  The softmax is
factored into classes of ids, so a step costs 2 * sqrt(V) logits; it sums to one.

A word's probability is a mixture: `MIX` times its share of all training tokens, from
the table of all counts, plus 1 - MIX times the product over its ids.  That table grows
with the corpus: frequent words' counts go to every task, others come by a join.

Scoring cuts each whole text into windows that overlap by `overlap` ids; a batch of
windows is one masked attention product, and every id is scored in exactly one
window, with at least `overlap` ids before it.

Attention is trained on all positions of all training texts, each in one window: each
task makes a pass over its own windows, the tasks' weights are averaged, and a second
round starts from there.  A large corpus is dealt over the two rounds.

Defined results: null text is empty: its one token is the end.  A null doc_id is not
held out.  Repeated rows are scored each.  Without training texts all counts are 0.
`hot_words` only decides which counts travel by the join.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import _OTHER_BLANKS, cut, id_remainder, kept, words_of
from quillspan.llm.subwords import byte_bpe

HOT_WORDS, CONTEXTS, IDS, CLASSES, WIDTH = 200_000, 4096, 1000, 32, 16
WINDOW, OVERLAP, BATCH, ROUNDS, MIX = 64, 32, 16, 2, 0.1
#: Windows a small corpus is gone through for; characters of a window, about; steps a task makes at least before its batches grow.
LEAST_WINDOWS, WINDOW_CHARS, STEPS = 40_000, 150, 256
LN10 = math.log(10.0)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered_words(text: str) -> list[str]:
    """Words of a text with A-Z lower-cased, and nothing else."""
    return words_of(text.lower() if text.isascii() else text.encode().translate(_LOWER).decode())


def runs(own: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end, first word, end) of runs of whole texts that reach about `most` words; own: words of each text."""
    upto, a = np.append(0, np.cumsum(own)), 0
    while a < len(own):
        z = min(len(own), max(a + 1, int(np.searchsorted(upto, upto[a] + max(most, 1)))))
        yield a, z, int(upto[a]), int(upto[z])
        a = z


def word_runs(texts: pa.Array, most_words: int | None = None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(number of texts, lowered_words of all, words per text) for runs of whole texts of about most_words words, or all at once.

    Arrow's ASCII functions know the same letters and the same six blanks; words become
    Python strings only where that is needed, once for each distinct word.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, own = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "")  # blanks at an end of a text leave empty words
    if not pc.all(real, min_count=0).as_py():
        owner = np.repeat(np.arange(len(own)), own)
        own = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(own)).astype(np.int64)
        words = words.filter(real)
    for a, z, first, last in runs(own, len(words) if most_words is None else most_words):
        yield z - a, words.slice(first, last - first), own[a:z]


@dataclass
class Vocabulary:
    """The ids in use: number -> BPE id; 0 is the end (and the start)."""

    numbers: dict[int, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # numbers of all BPE ids, one after another
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    many: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    opens: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @classmethod
    def choose(cls, counts: dict[str, int], size: int) -> Vocabulary:
        """All 256 bytes, and the most frequent other ids in words with counts."""
        bpe, seen = byte_bpe(), Counter()
        for w, c in counts.items():
            for i in bpe.encode_ordinary(" " + w):
                seen[i] += c
        single = sorted(bpe.encode_single_token(bytes([b])) for b in range(256))
        order = sorted(single, key=lambda i: (-seen[i], i)) + [i for i, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if i not in set(single)][: size - 256]
        order.sort(key=lambda i: (-seen[i], i))
        numbers = {i: k + 1 for k, i in enumerate(order)}
        opens = np.zeros(len(order) + 1, bool)
        opens[0] = True
        for i, k in numbers.items():
            opens[k] = bpe.decode_single_token_bytes(i)[:1] == b" "
        byte = {b: numbers[bpe.encode_single_token(bytes([b]))] for b in range(256)}
        spelt = [[numbers[i]] if i in numbers else [byte[b] for b in bpe.decode_single_token_bytes(i)] for i in range(bpe.n_vocab)]
        many = np.array([len(x) for x in spelt])
        return cls(numbers, np.array([n for x in spelt for n in x]), np.cumsum(many) - many, many, opens)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, one after another, and how many each has.

        Words have no blank, so all are encoded at once: a number that opens with a
        blank begins a word.  Words with blanks outside ASCII are encoded one by one.
        """
        bpe = byte_bpe()
        whole = " ".join(words)
        odd = _OTHER_BLANKS.search(whole)
        if odd:
            ids = [bpe.encode_ordinary(" " + w) for w in words]
            sizes = np.array([int(self.many[i].sum()) for i in ids])
            ids = np.array([i for x in ids for i in x])
        else:
            ids = np.array(bpe.encode_ordinary(" " + whole) if words else [], np.int64)
        many = self.many[ids]
        at = np.repeat(self.first[ids], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        numbers = self.flat[at]
        if not odd:
            starts = np.flatnonzero(self.opens[numbers])
            sizes = np.diff(np.append(starts, len(numbers)))
        return numbers, sizes


def contexts_of(numbers: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The keys of the one, two and three numbers up to each place, 0 where the word has fewer."""
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shifted = lambda k: np.concatenate([np.zeros(k, np.int64), numbers])[: len(numbers)]
    one = 2048 | numbers
    two = np.where(place >= 1, (2048 | shifted(1)) << 11 | numbers, 0)
    three = np.where(place >= 2, ((2048 | shifted(2)) << 11 | shifted(1)) << 11 | numbers, 0)
    return [one, two, three]


@dataclass
class Model:
    vocabulary: Vocabulary
    keys: np.ndarray  # sorted context keys; key k has row k + 2 of corpus; row 0: a word begins, row 1: no key fits
    corpus: np.ndarray  # [CLASSES, contexts, members] log probabilities
    classes: np.ndarray  # [contexts, CLASSES] their log sums
    member: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mask: np.ndarray = field(default_factory=lambda: np.where(np.tri(WINDOW) > 0, 0.0, -1e9).astype(np.float32))

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number, context row of what follows it) for all numbers of words, one after another, and how many each word has."""
        numbers, sizes = self.vocabulary.spell(words)
        rows = np.ones(len(numbers), np.int64)
        if len(self.keys):
            for key in contexts_of(numbers, sizes):  # longer contexts last
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rows = np.where(self.keys[at] == key, at + 2, rows)
        return np.stack([numbers, rows], axis=1).astype(np.uint16), sizes

    def attend(self, x: np.ndarray, skip: int = 0) -> tuple[np.ndarray, tuple]:
        """States of windows of ids [n, w] from place `skip` on, and what the way back needs."""
        p, w = self.weights, x.shape[1]
        q, k, v = np.take(p["q"], x[:, skip:], 0), np.take(p["k"], x, 0), np.take(p["v"], x, 0)  # the last number of each v is 1
        s = q @ k.transpose(0, 2, 1)
        s += self.mask[skip:w, :w]  # what is said of distances; -1e9 for what comes later
        np.exp(s, out=s)
        out = s @ v
        total = out[:, :, WIDTH:]
        return out[:, :, :WIDTH] / total, (q, k, v, s, total)

    def log_probability(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, at: np.ndarray, skip: int = 0) -> np.ndarray:
        """ln P(y) at the flat positions `at` of windows x from place `skip` on; rows: the context rows there."""
        h = np.empty((len(x), x.shape[1] - skip, WIDTH), np.float32)
        for a in range(0, len(x), 64):  # what a few windows need stays in the cache
            h[a : a + 64] = self.attend(x[a : a + 64], skip)[0]
        h = np.take(h.reshape(-1, WIDTH), at, 0)
        c, m = np.divmod(y, self.member)
        order = np.argsort(c.astype(np.int16), kind="stable")  # by class, so that each class's table is used at once
        c, m, h, rows = c[order], m[order], h[order], rows[order]
        logits = np.take(self.classes, rows, axis=0)
        logits += h @ self.weights["uc"].T
        found = logits[np.arange(len(y)), c]
        ones = np.ones(max(CLASSES, self.member), np.float32)  # a product sums rows faster
        sums = np.exp(logits, out=logits) @ ones[:CLASSES]
        ends = np.searchsorted(c, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            a, z = ends[k], ends[k + 1]
            if a < z:
                inner = np.take(self.corpus[k], rows[a:z], axis=0)
                inner += h[a:z] @ self.weights["u"][k].T
                found[a:z] += inner[np.arange(z - a), m[a:z]]
                sums[a:z] *= np.exp(inner, out=inner) @ ones[: self.member]
        out = np.empty(len(y))
        out[order] = found - np.log(sums)
        return out

    def each(self, codes: np.ndarray, counts: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP, batch: int = 384) -> np.ndarray:
        """ln P of all ids of texts, and of each text's end after them; codes: (id, row) pairs of all texts' ids, counts: ids of each text."""
        texts = len(counts)
        size = counts + 1  # inputs: the start, then every id; targets: every id, then the end
        first = np.cumsum(size) - size
        ids, rows = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
        body = np.ones(len(ids), bool)
        body[first] = False
        ids[body], rows[body] = codes[:, 0], codes[:, 1]
        target = np.append(ids[1:], 0)
        target[first[1:] - 1] = 0
        stride = window - overlap
        per = np.maximum(1, -(-(size - overlap) // stride))
        text = np.repeat(np.arange(texts), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        start = nth * stride
        length = np.minimum(window, size[text] - start)
        out = np.zeros(len(ids))
        # later windows give states of their new ids only
        turns = [(0, np.flatnonzero(nth == 0)), (overlap, np.flatnonzero(nth > 0))]
        for skip, some in [(skip, w[a : a + batch]) for skip, w in turns for a in range(0, len(w), batch)]:
            t, s, n = text[some], start[some], length[some]
            wide = int(n.max())
            inside = np.arange(wide)[None, :] < n[:, None]
            place = (first[t] + s)[:, None] + np.where(inside, np.arange(wide)[None, :], 0)
            at = np.flatnonzero(inside[:, skip:])
            where = place[:, skip:].reshape(-1)[at]
            out[where] = self.log_probability(ids[place], rows[where], target[where], at, skip)
        return out

    def scores(self, codes: np.ndarray, counts: np.ndarray, **options) -> np.ndarray:
        """ln P of each text by its ids alone."""
        return np.add.reduceat(self.each(codes, counts, **options), np.cumsum(counts + 1) - counts - 1) if len(counts) else np.zeros(0)

    def begin(self, seed: int = 5) -> None:
        """Random weights, alike everywhere."""
        rng = np.random.default_rng(seed)
        v = CLASSES * self.member
        f32 = lambda *shape, scale=0.1: (rng.normal(size=shape) * scale).astype(np.float32)
        self.weights = {"q": f32(v, WIDTH), "k": f32(v, WIDTH), "v": np.hstack([f32(v, WIDTH, scale=0.3), np.ones((v, 1), np.float32)]), "uc": f32(CLASSES, WIDTH), "u": f32(CLASSES, self.member, WIDTH), "lag": np.zeros(WINDOW, np.float32)}
        self._masked()

    def without_attention(self) -> None:
        """Only the corpus terms: states count for nothing."""
        self.weights["uc"][:], self.weights["u"][:] = 0, 0

    def _masked(self) -> None:
        reach = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0, None)
        self.mask = np.where(np.tri(WINDOW) > 0, self.weights["lag"][reach], -1e9).astype(np.float32)

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self.weights.items():
            self.weights[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        self._masked()

    def windows(self, pieces: Iterable[tuple[str, bool, bool]]) -> np.ndarray:
        """Training windows [n, 3, WINDOW] (input, context row, target; -1: none) of pieces of text (piece, begins its text, ends it)."""
        out = []
        for piece, begins, ends in pieces:
            words = lowered_words(piece)
            words = words[0 if begins else 1 : None if ends else -1]  # a piece may be cut inside its first and last word
            codes = self.coded(words)[0].astype(np.int64)
            ids = np.concatenate([np.zeros(int(begins), np.int64), codes[:, 0], np.zeros(int(ends), np.int64)])[: WINDOW + 1]
            rows = np.concatenate([np.zeros(int(begins), np.int64), codes[:, 1]])[:WINDOW]
            if len(ids) > 1:
                n = len(ids) - 1
                w = np.zeros((3, WINDOW), np.int16)
                w[2] = -1
                w[0, :n], w[1, :n], w[2, :n] = ids[:-1], rows[:n], ids[1:]
                out.append(w)
        return np.stack(out) if out else np.zeros((0, 3, WINDOW), np.int16)

    def every_window(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Training windows, as windows() has them, in which every id of texts and every text's end is the target of one place; codes and counts as in each()."""
        size = counts + 1  # inputs: the start, then every id; targets: every id, then the end
        first = np.cumsum(size) - size
        ids, rows = np.zeros(int(size.sum()), np.int16), np.zeros(int(size.sum()), np.int16)
        body = np.ones(len(ids), bool)
        body[first] = False
        ids[body], rows[body] = codes[:, 0], codes[:, 1]
        target = np.append(ids[1:], 0)[: len(ids)]
        target[first[1:] - 1] = 0
        per = -(-size // WINDOW)
        begin = np.repeat(np.cumsum(per) - per, size) * WINDOW  # where each text's windows begin
        at = begin + np.arange(len(ids)) - np.repeat(first, size)
        out = np.zeros((3, int(per.sum()) * WINDOW), np.int16)
        out[2] = -1
        out[0, at], out[1, at], out[2, at] = ids, rows, target
        return np.ascontiguousarray(out.reshape(3, -1, WINDOW).transpose(1, 0, 2))

    def slopes(self, batch: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean -ln P of the targets of windows, and its slopes in all weights."""
        p, (x, rows, y) = self.weights, batch.astype(np.int64).transpose(1, 0, 2)
        h, (q, k, vv, s, total) = self.attend(x)
        on = np.flatnonzero(y.reshape(-1) >= 0)
        flat, r, t = h.reshape(-1, WIDTH)[on], rows.reshape(-1)[on], y.reshape(-1)[on]
        order = np.argsort(t // self.member, kind="stable")
        on, flat, r, t = on[order], flat[order], r[order], t[order]
        c, m = np.divmod(t, self.member)
        each = np.arange(len(t))
        ones = np.ones(max(CLASSES, self.member), flat.dtype)  # a product sums rows faster
        outer = np.take(self.classes, r, 0) + flat @ p["uc"].T
        np.exp(outer, out=outer)
        outer /= (outer @ ones[:CLASSES])[:, None]
        loss = -np.log(np.maximum(outer[each, c], 1e-30)).sum()
        outer[each, c] -= 1
        outer /= len(t)
        g = {name: np.zeros_like(w) for name, w in p.items()}
        g["uc"] = outer.T @ flat
        d = outer @ p["uc"]
        ends = np.searchsorted(c, np.arange(CLASSES + 1))
        for j in range(CLASSES):
            a, z = ends[j], ends[j + 1]
            if a < z:
                inner = np.take(self.corpus[j], r[a:z], 0) + flat[a:z] @ p["u"][j].T
                np.exp(inner, out=inner)
                inner /= (inner @ ones[: self.member])[:, None]
                loss -= np.log(np.maximum(inner[each[: z - a], m[a:z]], 1e-30)).sum()
                inner[each[: z - a], m[a:z]] -= 1
                inner /= len(t)
                g["u"][j] = inner.T @ flat[a:z]
                d[a:z] += inner @ p["u"][j]
        d_h = np.zeros((x.size, WIDTH), flat.dtype)
        d_h[on] = d
        d_h = d_h.reshape(h.shape)
        d_q, d_k, d_v = np.empty_like(d_h), np.empty_like(d_h), np.empty_like(d_h)
        by_place = np.zeros((x.shape[1], x.shape[1]), flat.dtype)
        for b in range(0, len(x), 16):  # what a few windows need stays in the cache
            own = slice(b, b + 16)
            weights, slope = s[own], d_h[own]
            weights /= total[own]
            d_v[own] = weights.transpose(0, 2, 1) @ slope
            d_s = slope @ vv[own, :, :WIDTH].transpose(0, 2, 1)
            # each row's mean slope is the state's own
            d_s -= np.einsum("nij,nij->ni", slope, h[own])[:, :, None]
            d_s *= weights
            d_q[own], d_k[own] = d_s @ k[own], d_s.transpose(0, 2, 1) @ q[own]
            by_place += d_s.sum(axis=0)
        order = np.argsort(x.reshape(-1), kind="stable")
        ids = x.reshape(-1)[order]
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))

        def to_ids(slope: np.ndarray) -> np.ndarray:
            return np.add.reduceat(slope.reshape(-1, WIDTH)[order], at, axis=0)

        g["v"][ids[at], :WIDTH], g["q"][ids[at]], g["k"][ids[at]] = to_ids(d_v), to_ids(d_q), to_ids(d_k)
        g["lag"] = np.array([np.trace(by_place, -n) for n in range(WINDOW)], np.float32)
        return float(loss) / len(t), g

    def train(self, windows: np.ndarray, batch: int = BATCH, rate: float = 0.01, seed: int = 5, passes: int = 1) -> None:
        """Adam over windows, in a seeded order."""
        rng = np.random.default_rng(seed)
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)]) if len(windows) else np.zeros(0, int)
        steps = -(-len(order) // batch)
        slow = {k: np.zeros_like(x) for k, x in self.weights.items()}
        fast = {k: np.zeros_like(x) for k, x in self.weights.items()}
        for step in range(1, steps + 1):
            _, g = self.slopes(windows[order[(step - 1) * batch : step * batch]])
            now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for name, grad in g.items():
                slow[name] += 0.1 * (grad - slow[name])
                fast[name] += 0.01 * (grad * grad - fast[name])
                self.weights[name] -= np.float32(now / (1 - 0.9**step)) * slow[name] / (np.sqrt(fast[name] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
            self.weights["v"][:, WIDTH] = 1
            self._masked()


def pieces(learned: DataFrame, step: int, length: int = 240) -> DataFrame:
    """piece, begins, ends: one piece of text for about every `step` characters of all texts, at places chosen by hash; made before anything leaves the JVM."""
    t = learned.select("doc_id", "text").filter("text is not null")
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    t = t.withColumns({"_share": share, "_n": F.length("text")}).withColumn("_k", F.floor(F.col("_n") / float(step) + F.col("_share")).cast("int")).filter("_k > 0")
    other = F.pmod(F.xxhash64("doc_id", "_n", F.lit("place")), F.lit(1 << 30)) / float(1 << 30)
    place = lambda i: F.floor((i + other) * F.col("_n") / F.col("_k")).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.struct(F.substring(F.col("text"), place(i) + 1, F.lit(length)).alias("piece"), (place(i) == 0).alias("begins"), (place(i) + length >= F.col("_n")).alias("ends")))
    return t.select(F.inline(made))


def trained(model: Model, learned: DataFrame, rounds: int = ROUNDS, least_windows: int = LEAST_WINDOWS) -> Model:
    """Fit the attention weights over all of learned (doc_id, text): every position of every text is a target.

    Tasks train on their own windows and their weights are averaged, in rounds.  A large corpus is dealt
    over the rounds, so that each text is looked at once; a small one is gone through in each round, and
    again until that is least_windows or four times.
    """
    spark = learned.sparkSession
    model.begin()
    if not rounds:
        return model
    chars = learned.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    windows = max(1, chars // WINDOW_CHARS)
    texts = learned.select("text", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds)).alias("turn")).filter("text is not null")
    parts = rounds if windows >= rounds * least_windows else 1
    passes = min(4, -(-least_windows // windows))
    shared = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    part = 4096
    for turn in range(rounds):
        weights = spark.sparkContext.broadcast(model.packed())

        def local(batches: Iterator[pa.RecordBatch], weights=weights, turn=turn) -> Iterator[pa.RecordBatch]:
            memo = kept(name, lambda: Memo(shared.value, {}))
            own, total, n = memo.model, None, 0
            waiting: list[np.ndarray] = []

            def learn() -> None:
                nonlocal total, n
                known = np.concatenate(waiting)
                own.train(known, batch=int(np.clip(len(known) * passes // STEPS, BATCH, 8 * BATCH)), seed=turn, passes=passes)
                n += len(known)
                total = own.packed()
                waiting.clear()

            own.begin()
            own.unpack(weights.value)
            for batch in batches:
                for _, words, held in word_runs(batch["text"], 200_000):
                    place = memo.places(words)
                    owner = np.repeat(np.arange(len(held)), held)
                    lengths = np.bincount(owner, weights=memo.sizes[place], minlength=len(held)).astype(np.int64)
                    waiting.append(own.every_window(memo.codes(place), lengths))
                    if sum(map(len, waiting)) >= 100_000:
                        learn()
            if waiting:
                learn()
            if n:
                values = [(total[a : a + part] * np.float64(n)).tobytes() for a in range(0, len(total), part)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([n] * len(values), pa.int64()), pa.array(values)], ["part", "n", "values"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, n, v in zip(*(batch[c].to_pylist() for c in ("part", "n", "values")), strict=True):
                    old = sums.setdefault(k, [0, 0.0])
                    sums[k] = [old[0] + n, old[1] + np.frombuffer(v, np.float64)]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tobytes() for _, v in sums.values()])], ["part", "n", "values"])

        schema = "part int, n long, values binary"
        now = texts.filter(F.col("turn") == turn) if parts > 1 else texts
        means = now.select("text").mapInArrow(local, schema).repartition("part").mapInArrow(summed, schema).toArrow().sort_by("part")  # the weights, once
        if means.num_rows:
            model.unpack(np.concatenate([np.frombuffer(v, np.float64) / n for v, n in zip(means["values"].to_pylist(), means["n"].to_pylist(), strict=True)]))
        weights.destroy()
    shared.destroy()
    return model


def word_counts(docs: DataFrame, flush: int = 600_000) -> DataFrame:
    """word, c over all texts of docs (text); the empty word counts the ends.  Counts are summed in each task before they are shuffled."""

    def summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return t.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pack = lambda words, c: pa.RecordBatch.from_arrays([words, c], ["word", "c"])
        for batch in batches:
            for texts, words, _ in word_runs(batch["text"]):
                found = pc.value_counts(words)
                held += [pack(found.field("values"), found.field("counts")), pack(pa.array([""], pa.string()), pa.array([texts], pa.int64()))]
            if sum(map(len, held)) > flush:
                held = summed(held)
                if sum(map(len, held)) > flush // 2:
                    yield from held
                    held = []
        if held:
            yield from summed(held)

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def context_counts(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """context, id, n: what follows one to three ids of a word (-1: the word's end), and what begins a word (context 0), weighted by the words' counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch["word"].to_pylist(), batch["c"].to_numpy()
            real = np.array([w != "" for w in words], bool)
            numbers, sizes = vocabulary.spell([w for w in words if w])
            c, ends = c[real], c[~real]
            last = np.cumsum(sizes) - 1
            after = np.append(numbers[1:], -1)[: len(numbers)]
            after[last] = -1
            weight = np.repeat(c, sizes)
            keys = contexts_of(numbers, sizes)
            key = np.concatenate([*keys, np.zeros(len(c) + len(ends), np.int64)])
            then = np.concatenate([after, after, after, numbers[last - sizes + 1], np.zeros(len(ends), np.int64)])
            n = np.concatenate([weight, weight, weight, c, ends])
            on = np.concatenate([*[k > 0 for k in keys], np.ones(len(c) + len(ends), bool)])
            both, at = np.unique(key[on] * 4096 + then[on] + 1, return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, at, n[on])
            yield pa.RecordBatch.from_arrays([pa.array(both // 4096), pa.array((both % 4096 - 1).astype(np.int32)), pa.array(sums)], ["context", "id", "n"])

    return counts.mapInArrow(count, "context long, id int, n long").groupBy("context", "id").agg(F.sum("n").alias("n"))


def build(counts: DataFrame, hot: dict[str, int]) -> Model:
    """The model's corpus terms; what reaches the driver is bounded by CONTEXTS rows of IDS numbers."""
    vocabulary = Vocabulary.choose({w: c for w, c in hot.items() if w}, IDS)
    size = len(vocabulary.opens)
    member = -(-size // CLASSES)
    stats = cut(context_counts(counts, vocabulary), "contexts")
    totals = stats.filter("context > 0").groupBy("context").agg(F.sum("n").alias("n"))
    # a longer context has a shorter one that is at least as frequent
    top = totals.orderBy(F.desc("n"), "context").limit(CONTEXTS - 2).select("context")
    rows = stats.join(F.broadcast(top), "context").union(stats.filter("context = 0")).toArrow()
    single = stats.filter("context >= 2048 and context < 4096").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    inner = ~vocabulary.opens
    begin, after = np.full(size, 0.0), np.full(size + 1, 0.0)  # the last number stands for a word's end
    for i, n in zip(single["id"].to_pylist(), single["n"].to_pylist(), strict=True):
        after[i] += n
    allowed = np.append(inner, True)
    after = np.where(allowed, after + 0.1, 0.0)
    after /= after.sum()
    by_context: dict[int, np.ndarray] = {}
    for c, i, n in zip(rows["context"].to_pylist(), rows["id"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if c == 0:
            begin[i] += n
        else:
            by_context.setdefault(c, np.zeros(size + 1))[i] += n
    begin = np.where(vocabulary.opens, begin + 0.1, 0.0)
    begin /= begin.sum()
    chances = {}
    for c in sorted(by_context):  # shorter contexts have smaller keys
        top_bit = c.bit_length() - 1
        shorter = (1 << top_bit - 11) | (c & ((1 << top_bit - 11) - 1)) if top_bit > 11 else 0
        own, back = by_context[c], chances.get(shorter, after)
        chances[c] = (own + 4.0 * back) / (own.sum() + 4.0)
    keys = np.array(sorted(chances), np.int64)
    corpus = np.full((len(keys) + 2, CLASSES * member), -40.0, np.float32)
    everything = [np.append(np.where(inner, 1e-9, 0.0), 1.0), after, *(chances[c] for c in sorted(chances))]
    for k, p in enumerate(everything):
        full = p[:size] + p[size] * begin
        corpus[k, :size] = np.log(np.maximum(full / full.sum(), 1e-16))
    corpus = np.ascontiguousarray(corpus.reshape(len(corpus), CLASSES, member).transpose(1, 0, 2))
    sums = np.log(np.stack([np.exp(c.astype(np.float64)).sum(axis=1) for c in corpus], axis=1))
    return Model(vocabulary, keys, corpus, sums.astype(np.float32), member)


class Memo:
    """What one Python worker keeps of words: their codes and counts (-1: not among the frequent); it starts anew past `limit` words."""

    def __init__(self, model: Model, hot: dict[str, int], limit: int = 400_000):
        self.model, self.hot, self.limit = model, hot, limit
        self._anew()

    def _anew(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros((1 << 16, 2), np.uint16)
        self.used = 0
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.counts = np.zeros(0)

    def places(self, words: pa.Array | list[str]) -> np.ndarray:
        """Where each word's codes are; words become strings once for each distinct one."""
        found = (pa.array(words, pa.string()) if isinstance(words, list) else words).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        look = lambda: np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        at = look()
        if len(self.place) > self.limit and (at < 0).any():
            self._anew()
            at = look()
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            codes, sizes = self.model.coded(new)
            while self.used + len(codes) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(codes)] = codes
            self.starts = np.append(self.starts, self.used + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.counts = np.append(self.counts, [self.hot.get(w, -1) for w in new])
            at[missing] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, at[missing].tolist(), strict=True))
            self.used += len(codes)
        return at[found.indices.to_numpy()]

    def codes(self, place: np.ndarray) -> np.ndarray:
        sizes = self.sizes[place]
        at = np.repeat(self.starts[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.flat[at]


def score(docs: DataFrame, hot_words: int = HOT_WORDS, rounds: int = ROUNDS, least_windows: int = LEAST_WINDOWS, mix: float = MIX) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts of the `hot_words` most frequent words go to every task (a bounded table);
    the others of each text are joined with the table of all counts.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "text").withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 1)
    learned = d.filter("not held_out")
    counts = cut(word_counts(learned), "word-counts")
    n, v, n_ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    # at most 20 * hot_words words can be so frequent, so what is ranked is bounded too
    frame = counts.filter(F.col("c") * (20 * hot_words) >= n).orderBy(F.desc("c"), "word").limit(hot_words).toArrow()
    hot = dict(zip(frame["word"].to_pylist(), frame["c"].to_pylist(), strict=True))
    total = n + 0.5 * (v + 1)
    model = trained(build(counts, hot), learned, rounds, least_windows=least_windows)
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((model, hot))

    def scored_run(memo: Memo, words: pa.Array, place: np.ndarray, own: np.ndarray, ids: pa.Array, held: pa.Array, row: int) -> pa.RecordBatch:
        k = len(own)
        sizes, c = memo.sizes[place], memo.counts[place]
        owner = np.repeat(np.arange(k), own)
        lengths = np.bincount(owner, weights=sizes, minlength=k).astype(np.int64)
        each = memo.model.each(memo.codes(place), lengths)
        # a word's ids are one after another; each text's end follows its last word
        ends = np.cumsum(lengths + 1) - 1
        last = each[ends]
        each[ends] = 0.0
        chance = np.exp(np.add.reduceat(each, np.cumsum(sizes) - sizes + owner)) if len(words) else np.zeros(0)
        hot_here = c >= 0
        value = np.log10(np.maximum((1 - mix) * chance + mix * np.maximum(c, 0) / max(n, 1), 1e-300))
        value = np.bincount(owner, weights=np.where(hot_here, value, 0.0), minlength=k)
        value += np.log10(np.maximum((1 - mix) * np.exp(last) + mix * n_ends / max(n, 1), 1e-300))
        base = np.log10((np.maximum(c, 0) + 0.5) / total)
        base = np.bincount(owner, weights=np.where(hot_here, base, 0.0), minlength=k) + math.log10((n_ends + 0.5) / total)
        sure = np.bincount(owner, weights=hot_here, minlength=k).astype(np.int64)
        rare = np.flatnonzero(~hot_here)
        offsets = pa.array(np.concatenate([[0], np.cumsum(own - sure)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + k)), ids, held, pa.array(own + 1), pa.array(sure + (n_ends > 0)), pa.array(base), pa.array(value), pa.ListArray.from_arrays(offsets, words.take(pa.array(rare))), pa.ListArray.from_arrays(offsets, pa.array(chance[rare]))],
            ["row_id", "doc_id", "held_out", "n_tokens", "known", "base", "value", "rare", "chance"],
        )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(name, lambda: Memo(*shared.value))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, held, at = batch["doc_id"], batch["held_out"], 0
            # many words are looked up at once, each distinct one once; fewer are scored at once
            for _, words, own in word_runs(batch["text"], 1_000_000):
                found = memo.places(words)
                for a, z, first, last in runs(own, 200_000):
                    yield scored_run(memo, words.slice(first, last - first), found[first:last], own[a:z], ids.slice(at, z - a), held.slice(at, z - a), row)
                    at, row = at + z - a, row + z - a

    s = d.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(scored, "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, value double, rare array<string>, chance array<double>")
    s = cut(s, "lm-scores")
    rare = s.select("row_id", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("chance").alias("chance")))).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    value = F.log10(F.greatest((1 - mix) * F.col("chance") + mix * c / float(max(n, 1)), F.lit(1e-300)))
    rare = rare.groupBy("row_id").agg(F.sum(F.log10((c + 0.5) / F.lit(total))).alias("rest"), F.sum(value).alias("more"), F.sum((c > 0).cast("long")).alias("seen"))
    out = s.drop("rare", "chance").join(rare, "row_id", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("known", "seen").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "rest").alias("base_score"), plus("value", "more").alias("score"))
