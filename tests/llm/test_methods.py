"""Each method against brute force, a round trip, or held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import components, fingerprints, language_id, lattice, lm_scores, minhash, mixing, packing, queries, token_counts, toxicity, url_filter
from quillspan.llm.shared import word_array, word_count, words_of
from tests.oracle import assert_equal, connection

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert_equal(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLES[name])


@pytest.mark.parametrize("text", ["", " ", "a", " a b\n", "a\u00a0b\x1cc d", "\ta\x0bb\x0cc\r", "x  y", "\x85 z"])
def test_words(spark, text):
    import re

    want = re.findall("[^\x20\x09-\x0d]+", text)
    r = spark.range(1).select(word_array(F.lit(text)).alias("a"), word_count(F.lit(text)).alias("n")).first()
    assert words_of(text) == r["a"] == want and r["n"] == len(want)


def test_rollup_commits_once(spark, tmp_path):
    roll = token_counts.TokenRollup(spark, str(tmp_path / "roll"))
    schema = "op string, source string, lang string, counts map<string,bigint>, old_source string, old_lang string, old_counts map<string,bigint>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    first = make([("insert", "a", "en", {"w": 5}, None, None, None), ("insert", "a", "en", {"w": 7}, None, None, None), ("insert", None, None, {"w": 1}, None, None, None)])
    assert roll.totals().count() == 0
    assert roll.commit("one", first) and not roll.commit("one", first)
    second = make([("revise", "b", "en", {"w": 9}, "a", "en", {"w": 7}), ("delete", None, None, None, "a", "en", {"w": 5})])
    assert roll.commit("two", second)
    want = {("a", 0, 0), ("b", 1, 9), (None, 1, 1)}
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()} == want
    roll.compact()
    assert not roll.commit("one", first) and not roll.commit("two", second)
    assert roll.commit("three", make([("insert", "b", "en", {"w": 1}, None, None, None)]))
    roll.compact()
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()} == {("b", 2, 10), (None, 1, 1)}
    # what a broken commit left doesn't count
    (tmp_path / "roll" / "batch=half").mkdir()
    assert not roll.committed("half") and roll.totals().count() == 2
    with pytest.raises(Exception, match="unknown op"):
        roll.commit("bad", make([("upsert", "a", "en", {"w": 1}, None, None, None)]))


def test_token_counts_of_a_whole_table(spark):
    """Every total recounted with `tokenizers` and a plain split, copies told by equal texts."""
    d = table(spark, "documents")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: dict = {}
    docs = sorted(((r["doc_id"], r["text"] or "", r["source"], r["lang"]) for r in d.collect()))
    first = {}
    for i, text, source, lang in docs:
        own = first.setdefault(text, i) == i
        for name, n in (("byte_bpe_50k@1", len(t.encode(text, add_special_tokens=False).ids)), ("words@1", len(words_of(text)))):
            at = want.setdefault((source, lang, name), [0, 0, 0, 0])
            want[source, lang, name] = [at[0] + 1, at[1] + n, at[2] + own, at[3] + own * n]
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"], r["n_own_docs"], r["n_own_tokens"]] for r in token_counts.maintained(d).collect()}
    assert got == want and len(first) < len(docs)


def small_model():
    texts = ["the cat sat on the mat", "a dog and a cat", "the the the", "zebra crossing"] * 5
    hot = Counter(w for t in texts for w in t.split())
    voc = lm_scores.Vocabulary.choose(hot, 300)
    member = -(-len(voc.opens) // lm_scores.CLASSES)
    rng = np.random.default_rng(1)
    keys = np.unique(lm_scores.contexts_of(*voc.spell(sorted(hot)))[0])
    corpus = rng.normal(size=(lm_scores.CLASSES, len(keys) + 2, member)).astype(np.float32)
    m = lm_scores.Model(voc, keys, corpus, np.log(np.exp(corpus).sum(axis=2)).T.copy(), member)
    m.begin()
    m.train(m.windows([(t, True, True) for t in texts]), batch=8)
    return m, texts


def test_windows_score_each_id_once():
    """Batched windows against one id at a time, and probabilities that sum to one."""
    m, texts = small_model()
    long = " ".join(texts * 4)
    for text in ["", "cat", "the cat sat", long]:
        codes = m.coded(text.split())[0]
        got = m.scores(codes, np.array([len(codes)]))[0]
        ids, ctx = np.concatenate([[0], codes[:, 0]]).astype(np.int64), np.concatenate([[0], codes[:, 1]]).astype(np.int64)
        target = np.append(ids[1:], 0)
        stride = lm_scores.WINDOW - lm_scores.OVERLAP
        want = 0.0
        for i in range(len(ids)):
            start = 0 if i < lm_scores.WINDOW else (i - lm_scores.OVERLAP) // stride * stride
            h = m.attend(ids[None, start : i + 1])[0][0, -1]
            outer = m.classes[ctx[i]] + m.weights["uc"] @ h
            inner = m.corpus[:, ctx[i]] + m.weights["u"] @ h
            p = np.exp(outer) / np.exp(outer).sum()
            p = p[:, None] * np.exp(inner) / np.exp(inner).sum(axis=1, keepdims=True)
            assert p.sum() == pytest.approx(1, abs=1e-4)
            want += math.log(p.reshape(-1)[target[i]])
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_words_are_spelt_alike_alone_and_together():
    m, _ = small_model()
    words = ["the", "c\u00e4t!", "\u00a0x", "it's", "x\u2003y", "\u65e5\u672c\u8a9e", "a" * 300, "\x1c"]
    for own in (words, [w for w in words if "\u00a0" not in w and "\u2003" not in w and w != "\x1c"]):
        numbers, sizes = m.vocabulary.spell(own)
        alone = [m.vocabulary.spell([w]) for w in own]
        assert numbers.tolist() == [n for a, _ in alone for n in a] and sizes.tolist() == [int(s[0]) for _, s in alone]
    memo = lm_scores.Memo(m, {"the": 7}, limit=3)
    for own in (words, words[:2], ["new", "the"], words):
        place = memo.places(own)
        assert memo.codes(place).tolist() == m.coded(own)[0].tolist()
        assert [c == 7 for c in memo.counts[place]] == [w == "the" for w in own]


def test_training_gradients():
    """Slopes against differences, and loss falls on what it learns from."""
    m, texts = small_model()
    windows = m.windows([(" ".join(texts[:8]), True, True), ("at sat on the ma", False, False), ("zebra crossing", False, True), ("", True, True)])
    assert windows.shape == (4, 3, lm_scores.WINDOW) and (windows[1, 2] >= 0).sum() < lm_scores.WINDOW
    m.weights = {k: x.astype(np.float64) for k, x in m.weights.items()}
    _, g = m.slopes(windows)
    rng = np.random.default_rng(3)
    for name, w in m.weights.items():
        big = np.argsort(-np.abs(g[name]).ravel())[:4]
        for i in [*big, rng.integers(w.size)]:
            if name == "v" and i % w.shape[1] == lm_scores.WIDTH:
                continue
            at, loss = np.unravel_index(i, w.shape), []
            for step in (1e-3, -2e-3):
                w[at] += step
                m._masked()
                loss.append(m.slopes(windows)[0])
            w[at] += 1e-3
            m._masked()
            assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=2e-2, abs=2e-5)
    m, texts = small_model()
    score = lambda: sum(m.scores(c := m.coded(t.split())[0], np.array([len(c)]))[0] for t in texts)
    before = score()
    m.train(m.windows([(t, True, True) for t in texts]), batch=8, passes=20)
    assert score() > before


def test_attention_lowers_the_loss_of_held_out_texts(spark, monkeypatch):
    """The model with trained attention, against its corpus terms alone, and against the base."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = lambda rows: sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    whole = lm_scores.score(d, mix=0.0).filter("held_out").collect()
    fit = lm_scores.trained

    def alone(model, learned, rounds, **options):
        model = fit(model, learned, 0, **options)
        model.without_attention()
        return model

    monkeypatch.setattr(lm_scores, "trained", alone)
    bare = lm_scores.score(d, mix=0.0).filter("held_out").collect()
    assert mean(whole) > mean(bare) + 0.1
    assert mean(whole) > sum(r["base_score"] for r in whole) / sum(r["n_tokens"] for r in whole)


def test_training_windows_come_from_all_texts(spark):
    """As many as the texts are long, from each place alike."""
    texts = [(i, " ".join(f"w{j}" for j in range(100 + 40 * i))) for i in range(50)] + [(99, None), (100, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    chars, got = sum(len(t) for _, t in texts if t), lm_scores.pieces(d, 300).collect()
    assert abs(len(got) - chars / 300) <= 15 and all(len(r["piece"]) <= 240 for r in got)
    found = {i for i, t in texts if t and any(r["piece"] in t for r in got)}
    assert len(found) == 50 and any(r["ends"] for r in got)


def test_base_scores(spark):
    d = table(spark, "documents")
    rows = {r["doc_id"]: [*lm_scores.lowered_words(r["text"]), ""] for r in d.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in rows.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    scores = []
    for hot_words in (50, 1):  # with one, even the end's count isn't among them
        got = {r["doc_id"]: r for r in lm_scores.score(d, hot_words=hot_words, rounds=0).collect()}
        for i, ws in rows.items():
            base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held(i), len(ws), sum(w in c for w in ws), n)
            assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        scores.append({i: r["score"] for i, r in got.items()})
    # only the shares of all words, where the mix is all of it
    pure = {r["doc_id"]: r["score"] for r in lm_scores.score(d, hot_words=50, rounds=0, mix=1.0).collect()}
    for i, ws in rows.items():
        if not held(i):
            assert pure[i] == pytest.approx(sum(math.log10(c[w] / n) for w in ws), rel=1e-9)


def test_nearest_lattice_points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    near = lattice.nearest_e8(x)
    others = near[:, None] + lattice.shortest_vectors()[None]
    assert len(lattice.shortest_vectors()) == 240
    assert (((x[:, None] - others) ** 2).sum(2).min(1) >= ((x - near) ** 2).sum(1) - 1e-9).all()
    assert (((x - near) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius


def test_vectors_against_brute_force(spark):
    """Groups of near copies, also one that fills several blocks."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base[i % 30] + rng.normal(size=16) * 0.06 * rng.random() for i in range(240)]).reshape(240, 16)
    x = np.concatenate([x, x[:20], base[:1] + rng.normal(size=(150, 16)) * 0.03])
    label = np.array([i % 2 if i < 260 else 0 for i in range(len(x))])
    d = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x.tolist()), "label": label.tolist()}))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    for block_rows in (2000, 40):
        got = lattice.near_duplicates(d, block_rows=block_rows).toPandas().sort_values("vec_id")
        assert (got.n_links.to_numpy() == link.sum(1)).all()
        comp = np.arange(len(x))
        for _ in range(len(x)):
            comp = np.minimum(comp, np.where(link, comp[None], len(x)).min(1))
        assert (got.component_id.to_numpy() == comp).all()


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[shape]
    root = list(range(100))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert got == want
    # rounds of contraction, with edges dealt over tasks of a few edges each
    spread = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r["node"]: r["component"] for r in components.connected_components(spread, few=2, flush=3).collect()} == want


def test_apportionment(spark):
    rng = random.Random(6)
    votes = [rng.randrange(0, 1000) for _ in range(40)] + [90_000]
    house = 2000
    p = spark.createDataFrame([(i, float(v), house) for i, v in enumerate(votes)], "i int, votes double, house long")
    got = {r["i"]: r["seats"] for r in mixing.sainte_lague(p, [], [F.col("i")]).collect()}
    quotients = sorted(((-v / (2 * s + 1), i) for i, v in enumerate(votes) for s in range(house) if v), key=lambda x: x)[:house]
    assert got == {i: Counter(i for _, i in quotients)[i] for i in range(len(votes))}


def test_targets_stop_at_three_times(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 1000, 3), (None, 500, 4)], "source string, size long, doc_id long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["b"] == 30 and got["a"] == 30 and sum(got.values()) == pytest.approx(1520)
    assert got["c"] == pytest.approx(3 * got[None])  # the fourth source weighs 1 again


def test_mix_is_near_its_targets(spark):
    d = table(spark, "documents").select("doc_id", "source", "text")
    for options in ({}, {"shard_words": 500, "block_words": 16}):
        m = mixing.mix(d, **options).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("k"), F.max("target").alias("t")).collect()
        assert all(abs(r["k"] - r["t"]) <= max(130, 0.03 * r["t"]) for r in m)


def test_packing_round_trip(spark):
    d = table(spark, "documents").select("doc_id", "text")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {r["doc_id"]: np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], "<u4") for r in d.collect()}
    p = packing.pack(d, pool=64).toPandas()
    for i, g in p.sort_values("start").groupby("doc_id"):
        assert (g.start.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() == len(ids[i]) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[i][s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    sums = []
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
        sums.append(int(g.length.sum()))
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sums)


def brute_classes(rows, threshold=0.8):
    bag = lambda t: Counter(tuple(w[i : i + 5]) for w in [words_of(t)] if w for i in range(max(1, len(w) - 4)))
    bags = [bag(t) if t else Counter() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            common = sum((a & b).values())
            if same or (a and b and common / (sum(a.values()) + sum(b.values()) - common) >= threshold):
                root[find(i)] = find(j)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    base = [word() for _ in range(150)]
    for k in range(70):  # a group whose members are more and less alike
        w = list(base)
        for _ in range(k // 12):
            w[rng.randrange(150)] = word()
        rows.append((10_000 + k, " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    rows += [(20_000 + k, " ".join(word() for _ in range(80)) + " " + passage) for k in range(30)]
    rows += [(30_000 + k, ("repeat me " * (50 + k)).strip()) for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_classes(rows)
    for block_rows in (500, 7):
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(d, block_rows=block_rows).collect()} == want


def test_one_large_group_of_near_copies(spark):
    """A thousand edited copies of one text: every class is that of all pairs counted exactly."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(200)], []
    for k in range(1000):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 8, 12, 20))):
            w[rng.randrange(200)] = word()
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), block_rows=100).collect()}
    grams = [{tuple(w[i : i + 5]) for i in range(196)} for w in (t.split() for _, t in rows)]
    column = {g: i for i, g in enumerate(sorted({g for s in grams for g in s}))}
    has = np.zeros((1000, len(column)), np.float32)
    for k, s in enumerate(grams):
        has[k, [column[g] for g in s]] = 1
    common = has @ has.T
    i, j = np.nonzero(common / (has.sum(1)[:, None] + has.sum(1)[None] - common) >= 0.8)
    nodes, root = components.trees(i, j)
    assert len(set(root)) > 20 and got == dict(zip(nodes.tolist(), root.tolist(), strict=True))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(9)
    errors = []
    for seed in range(30):
        e = (rng.integers(0, 1 << 62, 60)).astype(np.uint64)
        a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.repeat([0, 1], [int((a > 0).sum()), int((b > 0).sum())])
        s = minhash.signatures(doc, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1024)
        errors.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_rules_and_trees(spark):
    p = spark.createDataFrame([(i, f"http://h{i % 7}.{'net' if i % 3 else 'example.org'}/{'fr' if i % 2 else 'x1234'}/{i}") for i in range(300)], "page_id long, url string")
    got = url_filter.judge(p).toPandas()
    assert set(got[got.rule == "net/"].verdict) == {"block"} and set(got[got.rule == "org/fr/"].verdict) == {"allow"}
    ruled = got[got.rule.notna()]
    assert ((ruled.block_score > 0.5) == (ruled.verdict == "block")).mean() > 0.95


def test_trees_fit_by_the_largest_gain(spark):
    """One split against all splits tried by hand."""
    rng = random.Random(10)
    rows = [(rng.randrange(4), rng.randrange(4), rng.randrange(1, 9)) for _ in range(40)]
    rows = [(a, b, n, sum(rng.random() < (0.9 if b > 1 else 0.1) for _ in range(n))) for a, b, n in rows]
    cells = spark.createDataFrame(rows, "_f_bin int, _g_bin int, n long, blocked long")
    m = url_filter.BoostedTrees(["f", "g"], trees=1, depth=1).fit(cells)
    p = 1 / (1 + math.exp(-m.base))
    worth = lambda own: sum(y - n * p for *_, n, y in own) ** 2 / (sum(n * p * (1 - p) for *_, n, _ in own) + url_filter.RIDGE)
    gains = {(f, b): worth([r for r in rows if r[k] <= b]) + worth([r for r in rows if r[k] > b]) for k, f in enumerate("fg") for b in range(3)}
    assert m.grown[0][:2] == max(gains, key=gains.get)


def test_likelihood_and_slopes():
    """Against the model written out text by text, and slopes against differences."""
    rng = np.random.default_rng(17)
    rows, cols, y = rng.integers(0, 30, 80), rng.integers(0, 6, 80), rng.integers(0, 5, 30)
    w, th = rng.random(6), np.array([-0.5, 0.3, 1.0, 2.2])
    logistic = lambda v: 1 / (1 + math.exp(-v))

    def plain(w, th):
        total = 0.0
        for k in range(30):
            x = sum(w[c] for r, c in zip(rows, cols, strict=True) if r == k)
            at_most = [0.0, *(logistic(t - x) for t in th), 1.0]
            total += math.log(at_most[y[k] + 1] - at_most[y[k]])
        return total / 30

    value, d_w, d_t = toxicity.likelihood(w, th, rows, cols, y)
    assert value == pytest.approx(plain(w, th))
    for slope, of in ((d_w, 0), (d_t, 1)):
        for i in range(len(slope)):
            step = [np.zeros(6), np.zeros(4)]
            step[of][i] = 1e-5
            assert slope[i] == pytest.approx((plain(w + step[0], th + step[1]) - plain(w - step[0], th - step[1])) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("labels", [(0, 1), (0, 1, 2, 5)])
def test_ordinal_model_learns_severity(spark, labels):
    """Two kinds of labels: only toxic or not, and grades as they are."""
    rng = random.Random(11)
    docs, given, count = [], [], {}
    for k in range(600):
        w = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(40)]
        n = {0: 0, 1: 1, 2: 3, 5: 8}[grade := rng.choice((0, 0, 0, *labels))] if len(labels) > 2 else (1 + k % 7) * (grade := int(k % 4 == 0))
        for i in rng.sample(range(40), n):
            w[i] = rng.choice(["zyxwvo", "qqpptt"])
        docs.append((k, " ".join(w)))
        given.append((k, grade))
        count[k] = n
    d, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(given[:450], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.grade(d, own).collect()}
    held = given[450:]
    assert sum((got[k]["p_toxic"] > 0.5) == (g > 0) for k, g in held) >= 0.98 * len(held)
    if len(labels) > 2:
        assert {r["grade"] for r in got.values()} <= set(labels) and sum(got[k]["grade"] == g for k, g in held) >= 0.95 * len(held)
    by_count = {n: np.mean([got[k]["severity"] for k, _ in held if count[k] == n]) for n in {count[k] for k, _ in held}}
    ordered = [by_count[n] for n in sorted(by_count)]
    assert all(a <= b + 1e-9 for a, b in itertools.pairwise(ordered)) and ordered[-1] > ordered[1] > ordered[0] + 0.5


def test_toxic_documents_are_found(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.grade(d, labels).join(labels, "doc_id").toPandas()
    # some 50 toxic texts to learn from; several labelled ones are junk without a word of their kind
    assert got[got.toxic == 1].rejected.mean() > 0.8 and got[got.toxic == 0].rejected.mean() < 0.01


def test_languages_are_found(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97


def test_no_language_is_left_out(spark):
    """Seventy languages, each with an alphabet of its own."""
    word = lambda k, i: "".join(chr(0x4E00 + 40 * k + (7 * i + j) % 30) for j in range(3))
    d = spark.createDataFrame([(100 * k + i, " ".join(word(k, i + j) for j in range(8)), f"l{k:02d}") for k in range(70) for i in range(6)], "doc_id long, text string, lang string")
    m = language_id.train(d, per_language=10, spans=400, epochs=2)
    assert m.states == [f"l{k:02d}" for k in range(70)]


def test_blocks_equal_one_chain():
    """Sums of posteriors over blocks against plain forward-backward."""
    rng = np.random.default_rng(12)
    m = language_id.ChainCRF(["a", "b", "c"], {}, np.zeros((0, 3)), rng.normal(size=(3, 3)))
    counts = np.array([0, 1, 5, 128, 129, 700])
    rows = np.hstack([np.exp(rng.normal(size=(counts.sum(), 3))), (rng.random((counts.sum(), 1)) < 0.8).astype(float)])
    got = m.document_sums(rows, counts)
    tr, at = np.exp(m.transitions), 0
    for k, n in enumerate(counts):
        e, letters = rows[at : at + n, :3], rows[at : at + n, 3]
        at += n
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        a = np.full(3, 1 / 3)
        for t in range(n):
            a = (a @ tr) * e[t]
            f[t] = a = a / a.sum()
        for t in range(n - 1, 0, -1):
            x = tr @ (e[t] * b[t])
            b[t - 1] = x / x.sum()
        p = f * b
        p = p / p.sum(1, keepdims=True) if n else p
        assert got[k] == pytest.approx((p * letters[:, None]).sum(0), rel=1e-4, abs=1e-4)


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(13)
    words = [str(rng.randrange(10**6)) for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    d = spark.createDataFrame([(1, a), (1, b), (2, a)], "g int, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    both = {r["g"]: r["s"] for r in fingerprints.merged(d, "g", "s").collect()}
    whole = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]))], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = whole.select("a", "b", fingerprints.joined(F.col("a"), F.col("b")).alias("u"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_count(F.col("a")).alias("n")).first()
    assert both[1] == r["u"] and both[2] == r["a"]
    assert abs(r["j"] - 1 / 3) < 0.15 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 1996) < 500
