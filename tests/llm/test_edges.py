"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing extra columns: each operator's defined results."""

import hashlib
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import fingerprints, language_id, lattice, lm_scores, minhash, mixing, packing, queries, token_counts, toxicity, url_filter
from quillspan.llm.shared import cut, scratch_dir

LONG = "word of a very long text " * 40_000
TEXTS = [
    (1, "the cat and the dog sat on the mat near the door", "en", "a"),
    (2, "der Hund und die Katze sind auf der Matte vor der Tuer", "de", "b"),
    (3, "", "en", "a"),
    (4, None, "en", None),
    (5, "   \n\t ", None, "a"),
    (6, LONG, "en", "b"),
    (7, "the cat and the dog sat on the mat near the door", "en", "a"),
    (7, "the cat and the dog sat on the mat near the door", "en", "a"),
    (None, "un chien et le chat sont sur le tapis", "fr", "b"),
    (9, "!!! 123 ... ---", None, None),
    (10, "one", "en", "c"),
    (11, "ein", "de", "c"),
    (12, "\u00a0é\x1c word\x85 end", "fr", "c"),
]
CLASHING = "size score words key node taken target n row_id digest held_out component _bucket _digest _id _hash _p _row _n rank count".split()


def documents(spark, rows=TEXTS):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit("x") for c in CLASHING})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, 1, 0), (7, 1, 0), (None, 1, 1), (10, None, None), (11, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture
def docs(spark):
    return documents(spark)


@pytest.fixture
def none(spark):
    return documents(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_token_counts(docs, none):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_own_docs"], r["n_own_tokens"]) for r in rows(token_counts.maintained(docs))}
    assert got["a", "en", "words@1"] == (4, 36, 2, 12)  # the copies with larger ids aren't texts of their own
    assert got[None, "en", "words@1"] == (1, 0, 1, 0)
    assert got["b", "en", "words@1"] == (1, 240_000, 1, 240_000)
    assert got["c", "fr", "words@1"] == (1, 3, 1, 3)  # four words by other blanks: revised
    assert {t for *_, t in got} == set(token_counts.TOKENIZERS)
    assert rows(token_counts.maintained(none)) == []


def test_lm_scores(docs, none):
    got = rows(lm_scores.score(docs, least_windows=50))
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1
    assert by[3]["score"] == pytest.approx(by[4]["score"])
    assert by[6]["n_tokens"] == 240_001 and by[12]["n_tokens"] == 4
    assert by[None]["held_out"] is False
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert rows(lm_scores.score(none)) == []


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0, 0.1], 1), (2, [1.0, 0.0, 0.1], 1), (3, [2.0, 0.0, 0.2], 1), (4, [1.0, 0.0, 0.1], 2), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, nan, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [inf, 0.0, 0.0], 1), (10, [1.0, 0.0, 0.1], None), (11, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.1], 1), (12, [], 1), (2, [1.0, 0.0, 0.1], 1)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in CLASHING})
    got = rows(lattice.near_duplicates(d))
    assert len(got) == len(v)
    by = {r["vec_id"]: r for r in got}
    assert [by[i]["n_links"] for i in (1, 2, 3)] == [4, 4, 4] and by[3]["component_id"] == 1 and by[1]["kept"]
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert (by[None]["n_links"], by[None]["component_id"], by[None]["kept"]) == (4, 1, False)
    nameless = rows(lattice.near_duplicates(d.withColumn("vec_id", F.lit(None).cast("long"))))
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in nameless} == {(0, None, True), (4, None, True)}
    assert rows(lattice.near_duplicates(d.limit(0))) == []


@pytest.mark.parametrize("ids", [None, 7])
def test_samples_where_all_rows_share_an_id(spark, ids):
    n = 20_000 if ids is None else 2_000
    d = spark.range(n).select(F.lit(ids).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    kind = "doc_id long, text string, lang string"
    some = d.union(spark.createDataFrame([(20, "ein Wort", "de"), (None, "un mot", "fr"), (None, "un mot", "fr")], kind))
    got = [tuple(r) for r in language_id.labelled_sample(some).collect()]
    assert sorted(g[1] for g in got) == ["de", "en", "fr"]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang"))
    assert 1900 < language_id.labelled_sample(many, 150, 100).select("lang").distinct().count() <= 2000  # two thirds may be learned from: no language is left out
    long = language_id.labelled_sample(spark.createDataFrame([(i, "long " * 1000, "en") for i in range(50)], kind), most_chars=20_000)
    assert 1 <= long.count() <= 4
    graded = toxicity.train(some.withColumn("text", F.concat("text", F.lit(" awful"))), spark.createDataFrame([(7, 1, 1), (20, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert graded is not None


def test_mixing(docs, none):
    got = rows(mixing.mix(docs))
    assert len(got) == len(TEXTS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[4] == 0
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs))
    assert rows(mixing.mix(none)) == []
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert all(r[c] == "x" for r in rows(out) for c in CLASHING)
    words = lambda t: len(queries.packing.encode(t)) and len([w for w in t.split() if w])
    assert sum(words(r["text"]) for r in rows(out)) == sum(r["taken"] for r in got)
    assert rows(mixing.mixed_documents(none)) == []


def test_packing(docs, none):
    got = rows(packing.pack(docs))
    assert {r["doc_id"] for r in got} == {r[0] for r in TEXTS}
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 7)
    for i in (3, 4):
        assert [(r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == i] == [(0, 1, 1)]
    assert rows(packing.pack(none)) == []


def test_near_copies(docs, none):
    got = rows(minhash.classes(docs))
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[7]["class_id"] == 1 and by[1]["kept"] and not by[7]["kept"]
    for i in (2, 3, 4, 5, 6, 9, 10, 11, 12):
        assert (by[i]["class_id"], by[i]["kept"]) == (i, True)
    assert rows(minhash.classes(none)) == []
    kept = minhash.deduplicated(docs)
    assert all(r[c] == "x" for r in rows(kept) for c in CLASHING)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12]
    assert rows(minhash.deduplicated(none)) == []


URLS = [
    (1, "http://A.Net/x", "a.net", "/x", "net/", "block"),
    (2, "https://www.example.NET/en/1?q=1", "www.example.net", "/en/1", "example.net/en/", "allow"),
    (3, "http://example.com/de/2#t", "example.com", "/de/2", "example.com/de/", "block"),
    (4, "http://m.org/fr/", "m.org", "/fr/", "org/fr/", "allow"),
    (5, None, "", "", None, None),
    (6, "no scheme/net/", "", "", None, None),
    (7, "http://a.net", "a.net", "", None, None),
    (8, "http://a.net?x=/y", "a.net", "", None, None),
    (9, "http://badnet/de/", "badnet", "/de/", None, None),
    (10, "", "", "", None, None),
    (11, "x://y://z/", "y:", "//z/", None, None),
    (12, "http://net/" + "a" * 100_000, "net", "/" + "a" * 100_000, "net/", "block"),
    (None, "http://A.Net/x", "a.net", "/x", "net/", "block"),
]


def test_urls(spark):
    p = spark.createDataFrame([(i, u) for i, u, *_ in URLS], "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumns({c: F.lit("x") for c in CLASHING if c != "size"})
    by = {r["page_id"]: r for r in rows(url_filter.judge(p))}
    for i, _, host, path, rule, verdict in URLS:
        r = by[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert rows(url_filter.judge(p.limit(0))) == []
    assert {r["verdict"] for r in rows(url_filter.judge(p.filter("page_id in (5, 6, 9)")))} == {"allow"}


def test_toxicity(spark, docs, none):
    got = rows(toxicity.grade(docs, labels(spark)))
    assert len(got) == len(TEXTS) and all(0 <= r["p_toxic"] <= 1 and 0 <= r["severity"] <= 3 for r in got)
    assert {r["rejected"] for r in got if r["doc_id"] in (3, 4, 5, 9)} == {False}
    assert rows(toxicity.grade(none, labels(spark))) == []
    untrained = rows(toxicity.grade(docs, labels(spark).limit(0)))
    assert {(r["severity"], r["rejected"]) for r in untrained} == {(0.0, False)}


def test_fingerprints(docs, none, spark):
    got = rows(fingerprints.fingerprint(docs))
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] == ""
    assert by[4]["n_chars"] == 0 and by[1]["fingerprint"] == by[7]["fingerprint"]
    assert by[4]["near_next"] == 1.0 and by[10]["near_next"] == 0.0
    assert len(by[6]["fingerprint"]) <= fingerprints.K * fingerprints.HEX
    assert rows(fingerprints.fingerprint(none)) == []
    alone = rows(fingerprints.fingerprint(docs.filter("doc_id = 10")))
    # its next is itself: "one" without its last letter, and the first letter again
    assert len(alone) == 1 and (alone[0]["n_chars"], alone[0]["near_next"], alone[0]["near_edited"]) == (3, 1.0, 0.0)
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"ono").hexdigest()


def test_fingerprint_buckets(spark):
    """An outlying id, many null ids, one id and one row repeated: buckets stay even, and every row's next is right."""
    texts = [(i, f"text {i}") for i in range(2000)] + [(1 << 60, "far")] + [(None, f"null {i % 300}") for i in range(900)] + [(77, f"of one id {i}") for i in range(900)] + [(78, "same row")] * 900
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(16)
    d = d.sparkSession.read.schema(d.schema).parquet(_written(d))
    placed = fingerprints.with_next(d, bucket_rows=100)
    sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
    assert max(sizes) <= 400 and len(sizes) >= 25
    assert [r["n"] for r in placed.filter("_guest = 1").groupBy("_bucket").agg(F.count("*").alias("n")).collect()] == [1] * len(sizes)
    low = -(1 << 63)
    order = sorted(texts, key=lambda r: (-(low if r[0] is None else r[0]), -int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprint(d).collect()) == want


def _written(df):
    path = f"{scratch_dir(df.sparkSession)}/test-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def test_languages(docs, none):
    got = rows(language_id.identify(docs))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(TEXTS)
    for i in (3, 4, 5, 9):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got) and by[12]["lang_pred"] != "und"
    assert rows(language_id.identify(none)) == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows(language_id.identify(unlabelled))} == {"und"}


def test_pipeline_stages(spark, docs, none, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, none):
            out = stage(spark, given, str(tmp_path))
            assert name == "packing" or out.columns == given.columns
            found = rows(out)
            assert name == "packing" or all(r[c] == "x" for r in found for c in CLASHING)
            assert given is docs or found == []


def test_pipeline_decides(spark, tmp_path):
    """What each stage keeps of a small corpus, and the ids that come out, counted by hand."""
    en, de = "the and of with this that have from they would there their what about which when make like time just".split(), "der die und ist nicht ein auf mit sich auch nach werden aus durch bei oder wenn noch wie einem".split()
    rng = random.Random(21)
    text = lambda words, n=60: " ".join(rng.choice(words) + rng.choice(("", "", "en", "er")) for _ in range(n))
    made = [(i, text(en if i % 2 else de), "en" if i % 2 else "de", f"s{i % 3}", int(i % 5 == 0)) for i in range(200)]
    made = [(i, t + " blarg snazzle frotz" * (1 + i % 3) if toxic else t, lang, s, toxic) for i, t, lang, s, toxic in made]
    copies = [(1000 + i, made[i][1] + " end", made[i][2], "s1", 0) for i in (1, 2, 3)] + [(2000, made[1][1], "en", "s2", 0)]
    junk = [(3000 + k, t, "en", "s0", 0) for k, t in enumerate(("", "123 456 !!!", None))]
    d = documents(spark, [r[:4] for r in made + copies + junk])
    spark.createDataFrame([(r[0], 1, r[4]) for r in made], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    kept, at = {r[0] for r in made + copies}, {}
    given = d
    for name, stage in corpus_pipeline.STAGES:
        given = cut(stage(spark, given, str(tmp_path)), name)
        at[name] = rows(given)
    ids = lambda name: {r["doc_id"] for r in at[name]}
    assert ids("language_id") == kept
    kept -= {r[0] for r in made if r[4]}
    assert ids("toxicity") == kept
    kept -= {1001, 1002, 1003, 2000}
    assert ids("near_copies") == kept and len(at["near_copies"]) == len(kept)
    # the mix: each source's words are those of its target, cut off or repeated at most three times
    size = Counter({s: 0 for s in ("s0", "s1", "s2")})
    for r in at["near_copies"]:
        size[r["source"]] += len(r["text"].split())
    taken, target = Counter(), {r["source"]: r["target"] for r in rows(mixing.targets(spark.createDataFrame([(s, n) for s, n in size.items()], "source string, size long")))}
    for r in at["mixing"]:
        taken[r["source"]] += len(r["text"].split())
        assert any(x["doc_id"] == r["doc_id"] and x["text"].startswith(r["text"]) for x in at["near_copies"])
    assert all(abs(taken[s] - target[s]) <= 64 for s in size)
    whole = sum(len(packing.encode(r["text"])) + 1 for r in at["mixing"])
    assert sum(r["length"] for r in at["packing"]) == whole and ids("packing") == ids("mixing")
    run = rows(corpus_pipeline.run(spark, str(tmp_path)))
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run)) == sorted(map(key, at["packing"]))
