"""The package sink: whole packages or none."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.sources import packaging

FILES = "lecture_id string, name string, content binary"


def rows():
    return [(f"l{k}", name, f"{k}:{name}".encode()) for k in range(7) for name in ("manifest.json", "entities.json", "prerequisites.json", "transcript.json", "other.txt")]


def test_flat_packages_of_allowed_files(spark, tmp_path):
    packaging.export_packages(spark.createDataFrame(rows(), FILES).repartition(5), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"l{k}_knowledge_package.zip" for k in range(7)]
    with zipfile.ZipFile(tmp_path / "l3_knowledge_package.zip") as z:
        assert sorted(z.namelist()) == ["entities.json", "manifest.json", "prerequisites.json"]
        assert z.read("entities.json") == b"3:entities.json"


@pytest.mark.parametrize("name", ["transcript.json", "x/frames/1.json", "logs/run.txt"])
def test_excluded_files_are_refused(spark, tmp_path, name):
    some = [*rows(), ("l2", name, b"x")]
    with pytest.raises(Exception, match="l2_knowledge_package|knowledge_package.zip"):
        packaging.export_packages(spark.createDataFrame(some, FILES), str(tmp_path), ["manifest.json", name])
    assert list(tmp_path.iterdir()) == []


def test_a_broken_task_leaves_no_package(spark, tmp_path):
    broken = spark.createDataFrame(rows(), FILES).withColumn("content", F.when(F.col("lecture_id") == "l5", F.raise_error("lost").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        packaging.export_packages(broken, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_nothing_to_export(spark, tmp_path):
    packaging.export_packages(spark.createDataFrame([], FILES), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
