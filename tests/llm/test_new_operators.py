"""Exact dedup, the prefix trie and whitening against plain Python, with nulls, ties, repeats, skew and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import exact_dedup, lookup, prefix_trie, whitening

CLASHING = "size keep_id group_size kept name node depth n x bytes pos own h base idx start a b _row _digest _text _salt".split()


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# exact dedup


def deduplicated(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), nth == 0, sha) for nth, i in enumerate(ids)]
    return sorted(out, key=str)


DOCS = [(1, "a b"), (2, "a  b"), (3, "a\t\r\nb"), (4, " a b"), (5, "a b "), (6, "a b"), (7, None), (8, ""), (9, " "), (10, "\n\n"), (None, "a b"), (None, "only null ids"), (None, "only null ids"), (11, "same"), (11, "same"), (11, "same"), (12, "same"), (13, "long " * 60_000), (14, "long\n" * 60_000), (-3, "w"), (15, "w"), (16, "W")]


@pytest.mark.parametrize("digest", [lookup.content_digest, lambda t: F.substring(lookup.content_digest(t), 1, 1), lambda t: F.lit("one")])
def test_exact_dedup(spark, digest):
    docs = clashing(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(4))
    assert rows(exact_dedup.decide(docs, digest)) == deduplicated(DOCS)


def test_exact_dedup_of_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN", 7)
    made = random.Random(3)
    docs = [(made.randrange(3000), made.choice(["hot text"] * 8 + [f"text {made.randrange(500)}"])) for _ in range(4000)] + [(5, "repeated")] * 100
    got = exact_dedup.decide(spark.createDataFrame(docs, "doc_id long, text string").repartition(9))
    assert rows(got) == deduplicated(docs)
    assert got.filter("kept").groupBy("text_sha256").count().filter("count > 1").isEmpty()


def test_exact_dedup_whole_rows(spark):
    docs = clashing(spark.createDataFrame(DOCS, "doc_id long, text string"))
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    want = {(i, sha) for i, _, _, kept, sha in deduplicated(DOCS) if kept}
    assert sorted(((r.doc_id, hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r.text or "").encode()).hexdigest()) for r in got.collect()), key=str) == sorted(want, key=str)


def test_exact_dedup_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(exact_dedup.decide(none)) == [] and rows(exact_dedup.deduplicated(none)) == []


def test_numbers_have_no_gaps(spark):
    d = lookup.numbered(spark.range(1000).repartition(7), "nth", "numbers")
    assert sorted(r.nth for r in d.collect()) == list(range(1000))


# prefix trie


def trie(conversations):
    """Nodes by listing every prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in conversations:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + said[h:]
    members = defaultdict(list)
    for c, said in sorted(built.items()):
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string"


def test_trie(spark):
    made = random.Random(5)
    said = [(c, t, made.choice(["user", "assistant", None]), made.choice(["yes", "no", "", None, "a longer text é"])) for c in range(-7, 60) if c % 10 for t in range(made.choice([1, 2, 3, 5, 9, 17, 33]))]
    said += [(70, t, "user", f"turn {t}") for t in range(70)] + [(71, t, "user", f"turn {t}") for t in range(65)]
    said += [(80, None, "user", "first"), (80, 1, "user", "tie"), (80, 1, "assistant", "tie"), (80, 1, "user", "tie"), (80, 1, "user", "tie"), (None, 1, "user", "lost"), (81, None, None, None)]
    got = prefix_trie.trie(clashing(spark.createDataFrame(said, TALK).repartition(5)))
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert rows(got) == trie(said)


def test_trie_of_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    said = [(c, t, "user", f"t{t}" if c % 3 or t < 2 else f"own {c}") for c in range(400) for t in range(4)]
    assert rows(prefix_trie.trie(spark.createDataFrame(said, TALK))) == trie(said)


def test_trie_of_nothing(spark):
    assert rows(prefix_trie.trie(spark.createDataFrame([], TALK))) == []


# whitening


def whitened(vectors, components=4):
    d = len(vectors[0][1])
    x = {v: np.floor(256.0 * np.array(e, np.float64)).astype(np.int64) for v, e in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    off = fit - s / n
    cov = off.T @ off / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for v, own in x.items():
        for k in range(min(components, d)):
            out[v, k + 1] = (n, int(((n * own - s) ** 2).sum()), abs((own - s / n) @ axes[:, k]) / np.sqrt(values[k]), values[k] / np.trace(cov))
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED_AT_ONCE", 2)
    made = np.random.default_rng(2)
    basis = made.normal(size=(12, 12)) * np.arange(1, 13)
    vectors = [(i, [float(v) for v in (made.normal(size=12) @ basis * 0.1).astype(np.float32)]) for i in range(300)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(50)]  # copies count once
    inf, nan = float("inf"), float("nan")
    bad = [(2000, None), (2001, []), (2002, [1.0] * 11 + [nan]), (2003, [1.0] * 11 + [inf]), (2004, [1.0] * 11 + [None]), (2005, [1.0] * 5), (2006, [1.0] * 13)]
    d = spark.createDataFrame([(*v, 1) for v in [*vectors, *bad, (None, vectors[0][1])]], VECTORS).repartition(9)
    got = whitening.whitened(clashing(d)).collect()
    want = whitened(vectors)
    assert len(got) == 4 * 351 and {r.vec_id for r in got} == {v for v, _ in vectors} | {None}
    for r in got:
        n, deviation, size, explained = want[r.vec_id if r.vec_id is not None else 0, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signed = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(signed[1000 + i, k] == pytest.approx(signed[i, k], abs=1e-9) for i in range(50) for k in (1, 2, 3, 4))


def test_whitening_without_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, -0.25], 1), (2, [0.5, -0.25], 1)], VECTORS)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(v, k, 1, 0, 0.0, 0.0, 0.0) for v in (1, 2) for k in (1, 2)]
    flat = sorted(whitening.whitened(spark.createDataFrame([(i, [float(i), 7.0], 1) for i in range(3)], VECTORS)).collect())
    assert [abs(round(r.whitened, 6)) for r in flat if r.component == 1] == [1.224745, 0.0, 1.224745]
    assert {r.whitened for r in flat if r.component == 2} == {0.0}


def test_whitening_of_nothing_and_of_huge_entries(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    huge = whitening.whitened(spark.createDataFrame([(1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1), (3, [1.0, 2.0], 1)], VECTORS)).collect()
    assert len(huge) == 6 and {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: 513**2 + 1024**2}
    assert whitening.whole(np.array([1e300, -1e300, -0.001])).tolist() == [2**63 - 1, -(2**63), -1]


def test_eigen():
    made = np.random.default_rng(4)
    for d in (1, 2, 5, 40):
        a = made.normal(size=(3 * d, d)) * np.arange(1, d + 1)
        values, axes = whitening.eigen(a.T @ a)
        want, _ = np.linalg.eigh(a.T @ a)
        assert np.allclose(values, want[::-1], rtol=1e-12)
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12) and np.allclose(a.T @ a @ axes, axes * values, atol=1e-9 * values[0])
