"""Near-duplicate embeddings by lattice hashing in E8.

Vectors are normalised and projected, for each of `tables` tables, to eight
dimensions; the scaled projection is decoded to the nearest point of the lattice E8,
its home cell, and it also visits the `probes` - 1 cells next nearest.  Vectors meet
where one's home is a cell that the other has; every meeting is verified by the
cosine in double precision.  With four tables and four probes a pair at cosine 0.98
misses all meetings about once in 10**5, a closer pair far less often.

Equal vectors of one label are collapsed first and counted.  A cell with many rows
is cut into blocks, and each pair of blocks is compared by one matrix product in one
task, so no task holds a whole large cell.  Blocks return sums of links for each
vector and a spanning forest, not pairs; a pair that meets more than once counts
only at its first meeting, which both vectors' cells tell.

Defined results: a null, empty or zero vector, one with null or non-finite
components, and one with a null label, has no link, is its own component
(null for a null id) and is kept.  A vector without an id links like any other; its component has
the least id that there is, null if there is none, and it is kept only then.  Vectors of different length are never compared.
Repeated rows are linked with each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import connected_components, trees
from quillspan.llm.minhash import mixed
from quillspan.llm.shared import cut, grouped

THRESHOLD, TABLES, PROBES, SCALE, BLOCK_ROWS, SEED = 0.98, 4, 4, 5.0, 2000, 11


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    f = np.rint(x)
    d = x - f
    k, rows = np.abs(d).argmax(axis=1), np.arange(len(x))
    g = f.copy()
    g[rows, k] += np.where(d[rows, k] >= 0, 1.0, -1.0)
    return np.where((f.sum(axis=1) % 2 != 0)[:, None], g, f)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8 and its copy moved by one half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


@lru_cache(maxsize=256)
def projection(table: int, dimensions: int) -> np.ndarray:
    """Orthonormal random directions, one to eight of them, as columns (zeros where the space has fewer)."""
    rng = np.random.default_rng([SEED, table, dimensions])
    q = np.linalg.qr(rng.normal(size=(dimensions, min(8, dimensions))))[0]
    return np.hstack([q, np.zeros((dimensions, 8 - q.shape[1]))])


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """64-bit codes [vectors, tables, probes] of the cells of unit vectors; the first probe is the home."""
    out = np.empty((len(unit), tables, probes), np.uint64)
    around = shortest_vectors()
    for t in range(tables):
        p = unit @ projection(t, unit.shape[1]) * scale
        home = nearest_e8(p)
        near = np.argsort(-((p - home) @ around.T), axis=1, kind="stable")[:, : probes - 1]
        points = np.rint(2 * np.concatenate([home[:, None], home[:, None] + around[near]], axis=1)).astype(np.int64).astype(np.uint64)
        code = np.full(points.shape[:2], t + 1, np.uint64)
        for k in range(8):
            code = mixed(code * np.uint64(31) + points[:, :, k])
        out[:, t] = code
    return out


def _read(vectors: DataFrame) -> DataFrame:
    """row_id, vec_id, same (a digest of label and vector; null if it links with nothing), group (a hash of label and length), vector (bytes of doubles)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, labels = batch["vec_id"], batch["label"].to_pylist()
            same, group, data = [], [], []
            for label, item in zip(labels, batch["embedding"], strict=True):
                v = item.values
                ok = label is not None and item.is_valid and len(v) and not v.null_count
                if ok:
                    x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore"):
                        ok = bool(np.isfinite(x).all() and x.any())
                if ok:
                    raw = (x + 0.0).tobytes()  # minus zero is zero
                    h = hashlib.md5(f"{label}:".encode() + raw).digest()
                    same.append(h)
                    group.append(int.from_bytes(hashlib.md5(f"{label}:{len(x)}".encode()).digest()[:8], "little", signed=True))
                    data.append(raw)
                else:
                    same.append(None)
                    group.append(None)
                    data.append(None)
            n = len(same)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), ids, pa.array(same, pa.binary()), pa.array(group, pa.int64()), pa.array(data, pa.binary())], ["row_id", "vec_id", "same", "group", "vector"])
            row += n

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as string) label", "embedding").mapInArrow(read, "row_id long, vec_id long, same binary, group long, vector binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(nodes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """nodes with a row for each cell that they have: key, home."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                raw, group = batch["vector"].to_pylist(), batch["group"].to_numpy().astype(np.uint64)
                keys = np.zeros((len(raw), tables, probes), np.uint64)
                sizes = np.array([len(v) for v in raw])
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    keys[at] = mixed(cells(_unit([raw[i] for i in at]), tables, probes, scale) ^ group[at][:, None, None])
                n = tables * probes
                row = np.repeat(np.arange(len(raw)), n)
                out = batch.take(pa.array(row))
                home = np.tile(np.arange(n) % probes == 0, len(raw))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(home), out["node"], out["n"], out["vector"]], ["key", "home", "node", "n", "vector"])

    return nodes.mapInArrow(place, "key long, home boolean, node long, n long, vector binary")


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The code of the first cell (least table, then least code) where vectors with cells a and b meet, for each pair."""
    found, done = np.zeros(len(a), np.uint64), np.zeros(len(a), bool)
    most = np.uint64((1 << 64) - 1)
    for t in range(a.shape[1]):
        at_a = np.where((b[:, t] == a[:, t, :1]).any(axis=1), a[:, t, 0], most)
        at_b = np.where((a[:, t] == b[:, t, :1]).any(axis=1), b[:, t, 0], most)
        least = np.minimum(at_a, at_b)
        new = ~done & (least != most)
        found[new] = least[new]
        done |= new
    return found


def _linked(raw: list[bytes], left: np.ndarray, right: np.ndarray, both: bool, threshold: float, tables: int, probes: int, scale: float, cell_of) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a block pair whose cosine reaches the threshold and whose first meeting is this cell."""
    unit = _unit(raw)
    codes = np.zeros((len(unit), tables, probes), np.uint64)
    known = np.zeros(len(unit), bool)  # only rows with a link need their cells again
    fast = unit.astype(np.float32)
    out_i, out_j = [], []
    for start in range(0, len(left), 512):
        own = left[start : start + 512]
        i, j = np.nonzero(fast[own] @ fast[right].T >= threshold - 1e-4)
        i, j = own[i], right[j]
        if both:
            on = i != j
            i, j = i[on], j[on]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            on = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[on], b[on]
            new = np.setdiff1d(np.concatenate([a, b]), np.flatnonzero(known))
            if len(new):
                codes[new], known[new] = cells(unit[new], tables, probes, scale), True
            on = cell_of(_first_meeting(codes[a], codes[b]))
            out_i.append(a[on])
            out_j.append(b[on])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compared(units: DataFrame, threshold: float, tables: int, probes: int, scale: float) -> DataFrame:
    """From rows sorted by (key, i, j): for each node and its block pair the number of links, and the root of its tree of links."""

    def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        if t.num_rows < 2:
            return None
        raw, node, n = t["vector"].to_pylist(), t["node"].to_numpy(), t["n"].to_numpy()
        key, group, i, j = (t[c][0].as_py() for c in ("key", "group", "i", "j"))
        home, block = t["home"].to_numpy(zero_copy_only=False), t["block"].to_numpy()
        left = np.flatnonzero(home & (block == i))
        if not len(left):
            return None
        cell_of = lambda code: mixed(code ^ np.array(group).astype(np.uint64)).astype(np.int64) == key
        visitors = np.flatnonzero(~home & (block == j))
        pairs = []
        if len(visitors):
            pairs.append(_linked(raw, left, visitors, False, threshold, tables, probes, scale, cell_of))
        if i <= j:
            right = np.flatnonzero(home & (block == j))
            a, b = _linked(raw, left, right, i == j, threshold, tables, probes, scale, cell_of)
            pairs.append((a[a < b], b[a < b]) if i == j else (a, b))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(a):
            return None
        links = np.bincount(a, weights=n[b], minlength=len(node)) + np.bincount(b, weights=n[a], minlength=len(node))
        root = np.arange(len(node))
        tree = trees(a, b)
        root[tree[0]] = tree[1]
        on = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on].astype(np.int64)), pa.array(node[root[on]])], ["node", "links", "root"])

    return units.mapInArrow(grouped(["key", "i", "j"], work), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = cut(_read(vectors), "vectors")
    nodes = cut(rows.filter("same is not null").groupBy("same").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.first("group").alias("group"), F.first("vector").alias("vector")), "vector-nodes")
    placed = cut(_placed(nodes.select("node", "n", "group", "vector"), tables, probes, scale), "vector-cells")
    # cells with a home and another row; large ones are cut into blocks
    full = placed.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.max("home").alias("_home")).filter("_home and _rows > 1")
    cellwise = placed.join(full.select("key", F.ceil(F.col("_rows") / block_rows).cast("int").alias("_blocks")), "key")
    cellwise = cellwise.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).join(nodes.select("node", "group"), "node")
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    as_left = F.transform(every, lambda x: F.struct(F.col("block").alias("i"), x.alias("j")))
    as_right = F.transform(every, lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
    units = cellwise.withColumn("_u", F.explode(F.when(F.col("home"), F.array_distinct(F.concat(as_left, as_right))).otherwise(as_right)))
    units = units.select("key", F.col("_u.i").alias("i"), F.col("_u.j").alias("j"), "home", "block", "group", "node", "n", "vector")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(_compared(units, threshold, tables, probes, scale), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = nodes.select("same", "node", "n", "least_id").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("least_id").alias("component_id"))
    own = own.join(least, "component").select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "same").join(own, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
