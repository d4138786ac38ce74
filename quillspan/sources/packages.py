"""Knowledge packages: reading, validating, merging, auditing and writing them with Spark.

Binary members (NPY, ZIP) are read by `binaryFile` and decoded in Arrow batches of
single files; everything else is a plain reader with an explicit schema.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = "lecture_id string, chunk_id string, timestamp double, transcript string, visual_context string, ocr_text string, start_time double, end_time double, segment_ids array<int>"
SEGMENTS = "segment_id string, title string, start double, end double, chunks array<string>"
ENTITIES = "entity_id string, name string, type string"
RELATIONS = "relation_id string, source_entity_id string, relation string, target_entity_id string, evidence string"
TRIPLETS = "query string, positive string, negative string"
EMBEDDING_IDS = "row_index int, chunk_id string"
#: Members that a package must have, and those that it may have.
REQUIRED = {"multimodal_chunks.json": CHUNKS, "segments.json": SEGMENTS, "entities.json": ENTITIES, "relations.json": RELATIONS, "embedding_ids.json": EMBEDDING_IDS}
OPTIONAL = {"triplets.json": TRIPLETS}
MOST_MEMBER_BYTES = 200 * 1024 * 1024


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per element of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every member of an unpacked package; a missing required member raises, a missing optional one is left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {f.getPath().getName() for f in files.listStatus(path)}
    if missing := sorted(set(REQUIRED) - there):
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return {name: read_array(spark, f"{folder}/{name}", schema) for name, schema in (REQUIRED | OPTIONAL).items() if name in there}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """path, row_index, embedding of NPY files with a two-dimensional matrix."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for start in range(0, len(m), 1024):
                    part = m[start : start + 1024].astype(np.float32)
                    yield pd.DataFrame({"path": p, "row_index": range(start, start + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row_index int, embedding array<float>")


def joined_vectors(ids: DataFrame, matrix: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """One point per embedded chunk: its vector, fields and segment ('' where it has none)."""
    bridge = segments.select(F.explode("chunks").alias("chunk_id"), "segment_id").groupBy("chunk_id").agg(F.min("segment_id").alias("segment_id"))
    p = ids.join(matrix.select("row_index", "embedding"), "row_index").join(chunks, "chunk_id").join(bridge, "chunk_id", "left")
    point = F.sha2(F.concat_ws(":", "lecture_id", "chunk_id"), 256)
    return p.select(point.alias("point_id"), "lecture_id", "chunk_id", F.coalesce("segment_id", F.lit("")).alias("segment_id"), "timestamp", "transcript", "visual_context", "ocr_text", "embedding")


def read_zipped_triplets(spark: SparkSession, path: str, member: str = "triplets.json") -> DataFrame:
    """path, query, positive, negative, error: the triplets in ZIP files; a corrupt or oversized member is one row with its error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        info = z.getinfo(member)
                        if info.file_size > MOST_MEMBER_BYTES:
                            raise ValueError("too large")
                        found = json.loads(z.read(info))
                    out = [(p, *(x.get(k) if isinstance(x, dict) else None for k in ("query", "positive", "negative")), None) for x in found]
                except Exception as e:
                    out = [(p, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["path", "query", "positive", "negative", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(rows, "path string, query string, positive string, negative string, error string")


def discovered(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """path, kind of packages under a folder: zips first, then folders with a manifest, each in order; hidden and excluded folders are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rest = F.substring_index("path", root.rstrip("/"), -1)
    hidden = F.exists(F.split(rest, "/"), lambda x: x.startswith(".") | x.isin(excluded or []))
    f = f.filter(~hidden)
    zips = f.filter(F.col("path").endswith(".zip")).select("path", F.lit("zip").alias("kind"))
    folders = f.filter(F.col("path").endswith("/manifest.json")).select(F.regexp_replace("path", "/manifest.json$", "").alias("path"), F.lit("folder").alias("kind"))
    return zips.union(folders).orderBy(F.desc("kind"), "path")


def valid_triplets(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with three texts, and the others."""
    ok = F.lit(True)
    for c in ("query", "positive", "negative"):
        ok = ok & (F.trim(F.coalesce(c, F.lit(""))) != "")
    return triplets.filter(ok), triplets.filter(~ok)


def manifest(parts: dict[str, DataFrame], dimension: int) -> DataFrame:
    """One row of counts."""
    out = None
    for name, df in sorted(parts.items()):
        n = df.agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = n if out is None else out.join(n)
    return out.withColumn("embedding_dimension", F.lit(dimension))


def manifest_violations(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """field, declared, actual where two manifests differ."""
    names = [c for c in actual.columns if c in declared.columns]
    long = lambda df, to: df.select(*[F.col(c).cast("long") for c in names]).unpivot([], names, "field", to)
    return long(declared, "declared").join(long(actual, "actual"), "field").filter(~F.col("declared").eqNullSafe(F.col("actual")))


def content_hash(files: DataFrame, group: Column) -> DataFrame:
    """group, hash: SHA-256 over a folder's files in order of name, each with its name before it."""
    f = files.select(group.alias("group"), F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("h"))
    return f.groupBy("group").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["name"], F.lit(":"), x["h"])), "\n"), 256).alias("hash"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] | None = None, once: dict[str, Column] | None = None) -> DataFrame:
    """Old rows with the new ones merged in by key.

    New values win, but for `keep_old` the old value stays where there is one, and
    `once` gives columns that only a row without an old one gets.  The last of
    several new rows with one key (by all columns, descending) is used.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in new.columns])
    n = new.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("_new", F.lit(True))
    o = old.withColumnsRenamed({c: f"_old_{c}" for c in old.columns if c not in keys}).withColumn("_old", F.lit(True))
    j = o.join(n, keys, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in (once or {}):
            out.append(F.when(F.col("_old").isNull(), once[c]).otherwise(F.col(f"_old_{c}")).alias(c))
        elif c not in new.columns:
            out.append(F.col(f"_old_{c}").alias(c))
        elif c in (keep_old or []):
            out.append(F.coalesce(f"_old_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("_new").isNotNull(), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return j.select(*out)


def upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes are one per (entity_id, lecture_id); name and type follow the new row."""
    return upserted(old, new, ["entity_id", "lecture_id"])


def upserted_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first relation_id stays; extracted edges are no longer inferred."""
    return upserted(old, new.withColumn("inference_only", F.lit(False)), ["lecture_id", "source", "relation", "target"], keep_old=["relation_id"])


def upserted_inferred(old: DataFrame, new: DataFrame) -> DataFrame:
    """Inferred edges are marked so only where they are new."""
    return upserted(old, new, ["lecture_id", "source", "relation", "target"], once={"inference_only": F.lit(True)})


def without_tenant(rows: DataFrame, lecture_id: str) -> DataFrame:
    """Everything but one lecture's rows; rows without a lecture stay."""
    return rows.filter(~F.col("lecture_id").eqNullSafe(F.lit(lecture_id)))


def registry_audit(registry: DataFrame, folders: DataFrame) -> DataFrame:
    """lecture_id, issue: entries without a folder, folders without an entry, names used twice, changed contents.

    registry: lecture_id, name, status, hash; folders: lecture_id, hash.
    """
    missing = registry.filter("status = 'READY'").join(folders, "lecture_id", "left_anti").select("lecture_id", F.lit("MISSING_FOLDER").alias("issue"))
    orphan = folders.join(registry, "lecture_id", "left_anti").select("lecture_id", F.lit("ORPHAN_FOLDER"))
    twice = registry.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lower(F.trim("name"))))).filter("_n > 1").select("lecture_id", F.lit("DUPLICATE_NAME"))
    changed = registry.join(folders.withColumnRenamed("hash", "_now"), "lecture_id").filter("hash is not null and hash <> _now").select("lecture_id", F.lit("HASH_MISMATCH"))
    return missing.union(orphan).union(twice).union(changed)


def reconciliation(registry: DataFrame, folders: DataFrame) -> DataFrame:
    """lecture_id, action that would make the registry follow the folders; nothing is changed."""
    a = registry_audit(registry, folders)
    act = F.when(F.col("issue") == "MISSING_FOLDER", "mark FAILED").when(F.col("issue") == "ORPHAN_FOLDER", "register").when(F.col("issue") == "HASH_MISMATCH", "rehash").otherwise("rename")
    return a.select("lecture_id", act.alias("action"))


def write_report(metrics: DataFrame, path: str) -> None:
    """A CSV with a row per sample and a column per metric (metrics: sample, metric, value)."""
    names = [r[0] for r in metrics.select("metric").distinct().orderBy("metric").collect()]
    metrics.groupBy("sample").pivot("metric", names).agg(F.first("value")).write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
