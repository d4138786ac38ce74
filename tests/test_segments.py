"""Texts of segments at their edges."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import segments as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "title"),
    [(None, S.fixed.UNTITLED), (" '' ", S.fixed.UNTITLED), ("\"Title: **Paging** and\tTLBs.\"", "Paging and TLBs"), ("Segment 3 - a b c d e f g h i", "a b c d e f g h"), ("##", S.fixed.UNTITLED)],
)
def test_written_title(spark, raw, title):
    assert one(spark, S.written_title(F.lit(raw).cast("string"))) == title


@pytest.mark.parametrize(("text", "noise"), [(None, True), ("12 34", True), ("ea ea ea ea", True), ("the the", True), ("paging", False), ("page page", False), ("a b a c", False), ("café", True)])
def test_repetitive(spark, text, noise):
    assert one(spark, S.is_repetitive(F.lit(text).cast("string"))) is noise


def test_rendered(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, S.rendered(F.lit(7), F.lit(None).cast("double"), nothing, nothing, nothing)) == "--- [Chunk: 7 | Timestamp: 0.00s] ---\n\nSPOKEN TRANSCRIPT: (None)"
    seen = F.lit("### educational slide description\nE = mc2\n\n\n\n#### Background - Blue\nend")
    assert one(spark, S.rendered(F.lit(7), F.lit(1.5), F.lit(" hi "), F.lit(""), seen)) == "--- [Chunk: 7 | Timestamp: 1.50s] ---\n\nSPOKEN TRANSCRIPT:\nhi\n\nVISUAL CONTEXT:\nE = mc2\n\nend"


def test_caption_objects(spark):
    assert one(spark, S.caption_objects(F.lit("CPU, cpu;x\n a bus ," + "y" * 50))) == ["cpu", "a bus"]
    assert one(spark, S.caption_objects(F.lit(None).cast("string"))) == []
    assert len(one(spark, S.caption_objects(F.lit(",".join(f"item {i}" for i in range(30)))))) == 20


@pytest.mark.parametrize(
    ("name", "variants"),
    [("Threads", ["Threads", "Thread"]), ("Access Policies", ["Access Policies", "Access Policy", "Access Polici", "Access Policie"]), ("Processes", ["Processes", "Process", "Processe"]), ("class", ["class"]), ("", [""])],
)
def test_name_variants(spark, name, variants):
    assert one(spark, S.name_variants(F.lit(name))) == variants


def test_ranked_scores(spark):
    schema = "query_id long, arrival int, score double, relevant boolean"
    rows = [(1, 1, None, False), (1, 2, 0.5, True), (1, 3, 0.3, True), (1, 4, 0.1, None), (2, 1, None, False)]
    got = {r["query_id"]: tuple(r)[1:] for r in S.ranked_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (0.5, 0.0, 0.4, 0.1, 0.5, 0.3), 2: (0.0,) * 6}
    assert S.ranked_scores(spark.createDataFrame([], schema)).count() == 0


def test_outcomes(spark):
    schema = "query_id int, in_pool boolean, in_context boolean, relevant boolean, refused boolean"
    rows = [(1, True, True, True, False), (2, True, True, True, True), (3, True, False, True, False), (4, False, False, True, True), (5, True, True, False, False), (6, True, True, None, False)]
    got = {r[0]: r[1] for r in S.outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "ok", 2: "refused_with_evidence", 3: "lost_after_retrieval", 4: "retrieval_miss"}
