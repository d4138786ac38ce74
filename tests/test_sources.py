"""Packages written and read back."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.sources import packages as P


@pytest.fixture
def package(tmp_path):
    folder = tmp_path / "lec1"
    folder.mkdir()
    chunks = [{"lecture_id": "lec1", "chunk_id": f"c{i}", "timestamp": 30.0 * i, "transcript": f"text {i}", "segment_ids": [i]} for i in range(4)]
    files = {
        "multimodal_chunks.json": chunks,
        "segments.json": [{"segment_id": "s0", "title": "t", "start": 0.0, "end": 60.0, "chunks": ["c0", "c1"]}],
        "entities.json": [{"entity_id": "e1", "name": "Cache", "type": "Concept"}],
        "relations.json": [],
        "embedding_ids.json": [{"row_index": i, "chunk_id": f"c{i}"} for i in range(4)],
        "manifest.json": {"chunks_count": 5, "embedding_dimension": 3},
    }
    for name, content in files.items():
        (folder / name).write_text(json.dumps(content))
    np.save(folder / "embeddings.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    return folder


def test_package(spark, package):
    parts = P.read_package(spark, str(package))
    assert {n: d.count() for n, d in parts.items()}["multimodal_chunks.json"] == 4
    points = P.joined_vectors(parts["embedding_ids.json"], P.read_matrix(spark, f"{package}/embeddings.npy"), parts["multimodal_chunks.json"], parts["segments.json"])
    got = {r["chunk_id"]: r for r in points.collect()}
    assert got["c1"]["embedding"] == [3.0, 4.0, 5.0] and got["c1"]["segment_id"] == "s0" and got["c3"]["segment_id"] == ""
    m = P.manifest({"chunks": parts["multimodal_chunks.json"]}, 3)
    declared = spark.read.json(f"{package}/manifest.json")
    assert [tuple(r) for r in P.manifest_violations(declared, m).collect()] == [("chunks_count", 5, 4)]
    (package / "relations.json").unlink()
    with pytest.raises(FileNotFoundError, match="relations.json"):
        P.read_package(spark, str(package))


def test_lines_fail_fast(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"frame_id": 1}\n\n{"frame_id": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"frame_id": 1}\n{"frame_id"')
    assert P.read_jsonl(spark, str(tmp_path / "good.jsonl"), "frame_id int").count() == 2
    with pytest.raises(Exception, match="MALFORMED"):
        P.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "frame_id int").collect()


def test_zipped_triplets(spark, tmp_path, package):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("triplets.json", json.dumps([{"query": "q", "positive": "p", "negative": "n"}, {"query": " ", "positive": "p"}]))
    (tmp_path / "a.zip").write_bytes(good.getvalue())
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.zip").write_bytes(good.getvalue())
    t = P.read_zipped_triplets(spark, str(tmp_path)).filter(~F.col("path").contains("hidden"))
    assert t.filter("error is not null").count() == 1
    ok, bad = P.valid_triplets(t.filter("error is null"))
    assert (ok.count(), bad.count()) == (1, 1)
    found = [(r["kind"], r["path"].rpartition("/")[2]) for r in P.discovered(spark, str(tmp_path)).collect()]
    assert found == [("zip", "a.zip"), ("zip", "b.zip"), ("folder", "lec1")]


def test_upserts(spark):
    edge = "lecture_id string, source string, relation string, target string, relation_id string, inference_only boolean"
    old = spark.createDataFrame([("l", "a", "R", "b", "r1", False), ("l", "x", "R", "y", "r2", True)], edge)
    new = spark.createDataFrame([("l", "a", "R", "b", "r9"), ("l", "c", "R", "d", "r3")], "lecture_id string, source string, relation string, target string, relation_id string")
    got = {r["source"]: (r["relation_id"], r["inference_only"]) for r in P.upserted_edges(old, new).collect()}
    assert got == {"a": ("r1", False), "x": ("r2", True), "c": ("r3", False)}
    got = {r["source"]: r["inference_only"] for r in P.upserted_inferred(old, new).collect()}
    assert got == {"a": False, "x": True, "c": True}
    nodes = spark.createDataFrame([("e1", "l", "Old"), ("e1", "m", "Other")], "entity_id string, lecture_id string, name string")
    new = spark.createDataFrame([("e1", "l", "New")], nodes.schema)
    assert {(r["lecture_id"], r["name"]) for r in P.upserted_nodes(nodes, new).collect()} == {("l", "New"), ("m", "Other")}
    assert P.without_tenant(nodes, "l").count() == 1


def test_registry(spark, package):
    reg = spark.createDataFrame([("a", "One", "READY", "h1"), ("b", "one ", "READY", "h2"), ("c", "Three", "READY", "h3")], "lecture_id string, name string, status string, hash string")
    there = spark.createDataFrame([("a", "h1"), ("b", "changed"), ("z", "h")], "lecture_id string, hash string")
    got = {(r["lecture_id"], r["issue"]) for r in P.registry_audit(reg, there).collect()}
    assert got == {("c", "MISSING_FOLDER"), ("z", "ORPHAN_FOLDER"), ("a", "DUPLICATE_NAME"), ("b", "DUPLICATE_NAME"), ("b", "HASH_MISMATCH")}
    assert P.reconciliation(reg, there).filter("action = 'register'").first()["lecture_id"] == "z"
    files = spark.read.format("binaryFile").load(str(package))
    one, two = (P.content_hash(files, F.lit("x")).first()["hash"] for _ in range(2))
    assert one == two and len(one) == 64


def test_report(spark, tmp_path):
    m = spark.createDataFrame([("s1", "mrr", 1.0), ("s1", "hit", 0.0), ("s2", "mrr", 0.5)], "sample string, metric string, value double")
    P.write_report(m, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["sample", "hit", "mrr"]
