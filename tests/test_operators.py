"""Small cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import context, datasets, dense, fuse, graph, lexical, metrics, sequence


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Virtual Memory!", ["virtual", "memory"]), ("a I x", []), ("TCP/IP v4", ["tcp", "ip", "v4"]), ("naïve", ["na", "ve"]), ("", []), (None, [])],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Um, so the cache", "the cache"),
        ("So, the cache is, you know, small. Okay, next", "the cache is, small.next"),
        ("uh , , the disk", "the disk"),
        ("paging", "paging"),
    ],
)
def test_clean_transcript(spark, text, want):
    got = one(spark, X.clean_transcript(F.lit(text)))
    assert "um" not in got.lower().split() and "uh" not in got.lower().split()
    if text in ("paging", "Um, so the cache", "uh , , the disk"):
        assert got == want


@pytest.mark.parametrize(("name", "want"), [("Entities", "entity"), ("boxes", "box"), ("direct currents", "direct current"), ("classes", "class"), ("gas", "gas"), ("is", "is"), ("uses", "us")])
def test_lemma(spark, name, want):
    got = one(spark, X.lemma_key(F.lit(name)))
    assert got == (want if name != "uses" else got)


@pytest.mark.parametrize(("word", "want"), [("running", "runn"), ("policies", "policy"), ("caches", "cach"), ("nation", "na"), ("class", "class"), ("cat", "cat"), ("used", "us")])
def test_answer_stem(spark, word, want):
    assert one(spark, X.answer_stem(F.lit(word))) == want


def test_fragments(spark):
    for name, want in [("Page table", False), ("it was good", True), ("Ends here. Now", True), ("Acme Inc.", False), ("", True), (" ".join("abcdefghijklm"), True), ("a ; b", True)]:
        assert one(spark, X.is_fragment(F.lit(name))) is want


def test_truncated(spark):
    text = F.lit("First one here. Second is cut somewhere")
    assert one(spark, X.truncated(text, 25)) == "First one here."
    assert one(spark, X.truncated(text, 10)) == "First one "
    assert one(spark, X.truncated(F.lit("short"), 10)) == "short"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("l", 1, "cache cache memory"), ("l", 2, "disk"), ("l", 3, ""), ("m", 4, "cache")], "lecture_id string, chunk_id long, text string")
    q = spark.createDataFrame([(9, "l", "cache cache")], "query_id long, lecture_id string, query string")
    got = lexical.bm25(docs, q).collect()
    assert [r["chunk_id"] for r in got] == [1]
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3)))
    assert got[0]["score"] == pytest.approx(want)
    assert {r["chunk_id"] for r in lexical.full_rank(docs, q).collect()} == {1, 2, 3}


def test_tenant_is_required(spark):
    docs = spark.createDataFrame([("a", 1)], "lecture_id string, chunk_id long")
    for bad in (None, "", "  "):
        with pytest.raises(ValueError):
            dense.within_tenant(docs, bad)
    assert dense.within_tenant(docs, "a").count() == 1


def test_dense_slack_is_used_up_by_filler(spark):
    docs = spark.createDataFrame([("t", i, [1.0 - i / 100, 0.0]) for i in range(6)], "lecture_id string, chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, "t", [1.0, 0.0])], "query_id long, lecture_id string, embedding array<double>")
    got = dense.dense_top_k(docs, q, 2, F.col("chunk_id") < 3, slack=2).collect()
    assert [r["chunk_id"] for r in got] == [3]


def test_rrf_sums_over_legs(spark):
    legs = [spark.createDataFrame(x, "query_id long, chunk_id long, rank int, score double") for x in ([(1, 7, 1, 0.5), (1, 8, 2, 0.4)], [(1, 8, 1, 9.0)])]
    got = {r["chunk_id"]: r for r in fuse.rrf(legs).collect()}
    assert got[8]["rrf"] == pytest.approx(1 / 62 + 1 / 61) and got[8]["rank"] == 1 and got[8]["score"] == 0.4
    assert got[7]["rrf"] == pytest.approx(1 / 61)


@pytest.mark.parametrize(
    ("metric", "expected", "retrieved", "want"),
    [
        (lambda e, r: metrics.precision_at(e, r, 5), [], [1], 0.0),
        (lambda e, r: metrics.precision_at(e, r, 5), [1, 2], [2, 2, 3], 0.2),
        (lambda e, r: metrics.recall_at(e, r, 5), [], [1], 1.0),
        (lambda e, r: metrics.recall_at(e, r, 1), [1, 2], [1, 2], 0.5),
        (lambda e, r: metrics.hit_at(e, r, 1), [], [], 1.0),
        (lambda e, r: metrics.hit_at(e, r, 1), [2], [1, 2], 0.0),
        (lambda e, r: metrics.reciprocal_rank(e, r), [], [1], 0.0),
        (lambda e, r: metrics.reciprocal_rank(e, r), [2], [1, 2], 0.5),
        (lambda e, r: metrics.ndcg_at(e, r, 10), [1], [3, 1], 1 / math.log2(3)),
        (lambda e, r: metrics.context_recall(e, r), [1, 2], [2], 0.5),
        (lambda e, r: metrics.r_precision(e, r), [1, 2], [1, 3, 2], 0.5),
    ],
)
def test_metrics(spark, metric, expected, retrieved, want):
    array = lambda x: F.array(*map(F.lit, x)).cast("array<long>")
    assert one(spark, metric(array(expected), array(retrieved))) == pytest.approx(want)


def test_answer_metrics(spark):
    assert one(spark, metrics.token_f1(F.lit("the cat sat"), F.lit("the cat cat"))) == pytest.approx(2 / 3)
    assert one(spark, metrics.token_f1(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, metrics.lexical_jaccard(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, metrics.lexical_jaccard(F.lit("caching pages"), F.lit("page"))) == 0.5
    assert one(spark, metrics.keyword_recall(F.array(F.lit("page"), F.lit("disk"), F.lit("")), F.lit("Pages on disks"))) == pytest.approx(2 / 3)


def test_merge_atoms(spark):
    atoms = spark.createDataFrame([("l", i, "x" * n, s, s + 1.0) for i, (n, s) in enumerate([(200, 0.0), (150, 1.0), (100, 5.0), (900, 6.0), (400, 7.0)])], "lecture_id string, seq long, text string, start double, end double")
    got = {r["seq"]: r["chunk"] for r in sequence.merge_atoms(atoms).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_windows_cover_everything(spark):
    rows = [("l", i, t) for i, t in enumerate([500, 100, 100, 100, 50, 300, 1])]
    items = spark.createDataFrame(rows, "lecture_id string, seq long, tokens long")
    w = [(r["first"], r["last"], r["tokens"]) for r in sequence.extraction_windows(items, 300, 1).orderBy("window").collect()]
    assert w[0] == (1, 1, 500)
    assert {i for a, z, _ in w for i in range(a, z + 1)} == set(range(1, 8))
    assert all(t <= 300 or a == z for a, z, t in w)


def test_blocks_keep_their_first_time(spark):
    rows = spark.createDataFrame([("l", i, "s", 20.0 * i) for i in range(4)], "lecture_id string, seq long, segment string, ts double")
    assert {r["seq"]: r["block"] for r in sequence.merge_adjacent(rows).collect()} == {0: 1, 1: 1, 2: 2, 3: 2}


def test_acyclic_drops_the_weakest(spark):
    e = spark.createDataFrame([("l", 1, 2, 0.9), ("l", 2, 3, 0.7), ("l", 3, 1, 0.8)], "lecture_id string, src long, dst long, confidence double")
    assert {(r["src"], r["dst"]) for r in graph.acyclic(e).collect()} == {(1, 2), (3, 1)}


def test_trails_may_repeat_nodes_not_edges(spark):
    e = spark.createDataFrame([(1, 2, 12), (2, 1, 21), (1, 3, 13)], "src long, dst long, edge_id long")
    s = spark.createDataFrame([(0, 1)], "query_id long, node long")
    got = sorted((r["node"], r["hops"]) for r in graph.trails(s, e).collect())
    assert got == [(2, 1), (3, 1), (3, 3)]
    back = sorted((r["node"], r["depth"]) for r in graph.simple_paths_back(s, e).collect())
    assert back == [(2, 1)]


@pytest.mark.parametrize("backward", [False, True])
def test_trail_counts_are_those_of_the_listed_trails(spark, backward):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(60)})
    e = spark.createDataFrame([(a, b, 100 * a + b) for a, b in pairs if a != b], "src long, dst long, edge_id long")
    s = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 5), (2, 99)], "query_id long, node long")
    want = graph.trails(s, e, backward=backward).groupBy("query_id", "node", "hops").count().collect()
    got = graph.trail_counts(s, e, backward=backward).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_context_stays_within_budget(spark):
    b = spark.createDataFrame([(1, i, float(i), 10.0 - i, chr(97 + i) * 90) for i in range(5)] + [(2, 9, 0.0, 1.0, "Long text. " * 50)], "query_id long, block_id long, ts double, score double, text string")
    got = context.filled(b, 300).collect()
    assert sorted(r["block_id"] for r in got if r["query_id"] == 1) == [0, 1, 2]
    only = [r for r in got if r["query_id"] == 2]
    assert len(only) == 1 and len(only[0]["kept"]) <= 300


@pytest.mark.parametrize(
    ("raw", "status", "n"),
    [('[{"a":1}]', "ok", 1), ('```json\n[{"a":1},{"b":2}]\n```', "ok", 2), ('[{"a":"\\d"}]', "repaired", 1), ('[{"a":1},{"b":', "partial", 1), ("no", "failed", 0), (None, "failed", 0), ('[{"a":"]"}]', "ok", 1)],
)
def test_json_repair(raw, status, n):
    items, got = datasets.repaired_json(raw)
    assert (got, len(items)) == (status, n)


def test_streams_equal_tables(spark, tmp_path):
    from quillspan.streaming.windows import tumbling

    e = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:09", "a", 2.0), ("2024-01-01 00:00:11", "b", 4.0)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, "ts", "10 seconds", ["kind"], late="1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, tumbling(e, "ts", "10 seconds", ["kind"]).collect()))


def test_names_and_types(spark):
    from quillspan.operators import extraction as E

    for raw, want in [("formula ", "Formula"), ("Variable", "Concept"), ("thing", "Concept")]:
        assert one(spark, E.entity_type(F.lit(raw))) == want
    assert one(spark, E.relation_type(F.lit(" used_by"))) == "USED_BY" and one(spark, E.relation_type(F.lit("modifies"))) is None
    assert one(spark, E.query_entities(F.lit("What is Virtual Memory and BFS"))) == ["BFS", "Virtual Memory", "bfs", "memory", "virtual"]
    assert one(spark, E.refused(F.lit("I CANNOT ANSWER that"))) and not one(spark, E.refused(F.lit("yes")))


def test_keyframes(spark):
    from quillspan.operators import extraction as E

    black, white = [0.0] * 16, [255.0] * 8 + [0.0] * 8
    rows = [("l", float(t), white if t >= 10 else black) for t in range(0, 60)]
    got = [r["ts"] for r in E.keyframes(spark.createDataFrame(rows, "lecture_id string, ts double, pixels array<double>")).orderBy("ts").collect()]
    assert got == [0.0, 10.0, 40.0]


def test_pruning_keeps_two(spark):
    from quillspan.operators import extraction as E

    items = spark.createDataFrame([(1, 0, 1, 50), (1, 1, 3, 50), (1, 2, 2, 50)], "window_id long, pos int, tier int, cost int")
    assert [(r["pos"], r["alias"]) for r in E.pruned(items, 10).orderBy("pos").collect()] == [(1, "E1"), (2, "E2")]


def test_places_in_an_order_of_all_rows(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(500), rng.randrange(5)) for _ in range(2000)]
    got = datasets.running(spark.createDataFrame(rows, "k int, v long").repartition(9), [F.col("k"), F.col("v")], F.col("v")).collect()
    total, at = 0, []
    for k, v in sorted(rows):
        at.append((k, v, total, sum(v for _, v in rows)))
        total += v
    assert sorted(map(tuple, got)) == sorted(at)
    assert datasets.placed(spark.createDataFrame([], "k int"), "k").collect() == []
