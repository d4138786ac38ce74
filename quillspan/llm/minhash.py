"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets.

A text's shingles (five words; a shorter text is one shingle) weigh as often as
they occur.  The weight axis of each shingle is cut into dyadic rings [0,1), [1,2),
[2,4), [4,8), ...; every ring has its own Poisson process whose rate is the ring's
length, and every point of it a position in the ring and a register.  A text with
weight w sees the points below w, so two texts agree in a register with the
probability of their weighted Jaccard similarity.  Points come in order of time, and
a process stops once its next point is later than all registers, so few points are
drawn; a heavy shingle costs one process per ring, not one per occurrence.

Exact copies are collapsed first.  Signatures are cut into bands; documents that
share a band are candidates, and a link is a candidate pair whose multisets of
shingles, counted from the texts, have a similarity of at least `threshold`.
A bucket's pairs are not all written out: its documents are first tried against one
hub; later only documents still in different components are compared, and of those
only what can still be similar, given how many shingles of each occur in no other
document left.  A bucket is cut into blocks, each pair of blocks is compared inside
one task, and a forest of links comes out.  Pairs inside a component can't change it,
so the components are those of all candidates.

Defined results: null text links with nothing; texts without words are copies of
each other only if equal; repeated rows are copies; the row with the least doc_id
(null last) of a class is kept.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quillspan.llm.components import connected_components
from quillspan.llm.shared import WordTable, chunks_of, cut, grouped, kept, released, words_of

SHINGLE, THRESHOLD, BANDS, ROWS, BLOCK_ROWS = 5, 0.8, 32, 5, 500
#: Pairs whose signatures agree less than this much below the threshold are not verified: five standard deviations.
SLACK = 0.16

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def times64(n: int, factor: np.uint64) -> np.uint64:
    """n * factor modulo 2**64."""
    return np.uint64(n * int(factor) & (1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)


def hash_table() -> WordTable:
    """The hashes of words that this worker has seen; all steps share it."""
    return kept("word-hashes", lambda: WordTable(word_hashes))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts whose words' hashes lie one after another, and the number of each text's shingles."""
    per = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    end = np.repeat(starts + counts, per)
    out = np.zeros(len(first), np.uint64)
    for j in range(size):
        at = first + j
        inside = at < end
        out = np.where(inside, mixed(out * np.uint64(31) + hashes[np.minimum(at, len(hashes) - 1)]), out) if len(hashes) else out
    return out, per


def multisets(hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, weight."""
    text = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((hashes, text))
    h, d = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash registers [docs, size]; a document without elements gets zeros."""
    times = np.full((docs, size), np.inf)
    values = np.zeros((docs, size), np.uint64)
    rings = [(doc, mixed(element), np.ones(len(doc)), np.ones(len(doc)))]
    ring, low = 1, 1
    on = weight > 1
    while on.any():  # ring [low, 2 low): what of it is below the weight
        rings.append((doc[on], mixed(element[on] + times64(ring, _M1)), np.full(int(on.sum()), float(low)), np.minimum(weight[on] - low, low).astype(float)))
        ring, low = ring + 1, low * 2
        on = weight > low
    d, base, length, inside = (np.concatenate(x) for x in zip(*rings, strict=True))
    t, step = np.zeros(len(d)), 0
    flat_t, flat_v = times.reshape(-1), values.reshape(-1)
    while len(d):
        step += 1
        x = mixed(base + times64(step, _GOLDEN))
        t = t - np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0**-53) / length
        on = t < times.max(axis=1)[d]
        d, base, length, inside, t, x = d[on], base[on], length[on], inside[on], t[on], x[on]
        y = mixed(x)
        below = (mixed(y) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * length < inside
        at = d[below] * size + (y[below] % np.uint64(size)).astype(np.int64)
        np.minimum.at(flat_t, at, t[below])
        won = flat_t[at] == t[below]
        flat_v[at[won]] = y[below][won]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, of the low 16 bits of its registers; the band's number is part of it."""
    parts = (values & values.dtype.type(0xFFFF)).astype(np.uint64).reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M2, parts.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(31) + parts[:, :, r])
    return key.astype(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """row_id, doc_id, digest (null for null text), n_shingles, keys, signature (16 bits a register) for each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        table = hash_table()
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            at = 0
            for n, words, counts in chunks_of(texts, 200_000):
                hashes, per = shingles(table.look(words) if words else np.zeros(0, np.uint64), counts)
                values = signatures(*multisets(hashes, per), n, bands * rows)
                keys = band_keys(values, bands, rows)
                own = texts[at : at + n]
                some = per > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        ids.slice(at, n),
                        pa.array([None if x is None else hashlib.md5(x.encode()).digest() for x in own], pa.binary()),
                        pa.array(per),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1))),
                        pa.ListArray.from_arrays(pa.array(offsets * rows), pa.array((values[some] & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16).reshape(-1))),
                    ],
                    ["row_id", "doc_id", "digest", "n_shingles", "keys", "signature"],
                )
                at, row = at + n, row + n
            del batch, ids, texts
            released()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(sign, "row_id long, doc_id long, digest binary, n_shingles long, keys array<long>, signature array<smallint>")


def agreement(a: Column, b: Column) -> Column:
    """Share of the registers in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x) / F.size(a)


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted Jaccard similarity of the shingle multisets of two texts, counted exactly."""
    table, memo = hash_table(), {}

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        if text not in memo:
            if len(memo) > 64:
                memo.clear()
            words = words_of(text)
            hashes, per = shingles(table.look(words) if words else np.zeros(0, np.uint64), np.array([len(words)]))
            memo[text] = np.unique(hashes, return_counts=True)
        return memo[text]

    def one(x: str, y: str) -> float:
        (h, c), (g, e) = bag(x), bag(y)
        if not len(h) or not len(g):
            return float(x == y)
        return overlap((h, c), (g, e))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _bags(texts: DataFrame) -> DataFrame:
    """node, shingle, c: the shingle multisets of texts (node, text)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table()
        for batch in batches:
            nodes, at = batch["node"].to_numpy(), 0
            for n, words, counts in chunks_of(batch["text"].to_pylist(), 200_000):
                text, h, c = multisets(*shingles(table.look(words) if words else np.zeros(0, np.uint64), counts))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + n][text]), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], ["node", "shingle", "c"])
                at += n

    return texts.select("node", "text").mapInArrow(bags, "node long, shingle long, c long")


def _shared_weights(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, whole, shared: a node's number of shingles, and how many of them another node of these texts has too.

    No pair among these nodes can have more than the lesser `shared` in common.
    """
    own = _bags(texts).groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.first("node").alias("node"), F.first("c").alias("c")).filter("_n = 1")
    alone = own.groupBy("node").agg(F.sum("c").alias("_alone"))
    return sizes.join(alone, "node", "left").select("node", F.col("n_shingles").alias("whole"), (F.col("n_shingles") - F.coalesce("_alone", F.lit(0))).alias("shared"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): row_id, doc_id, digest, class_id (least doc_id of its near-duplicates), kept."""
    d = docs.select("doc_id", "text")
    signed = cut(_signed(d, bands, rows), "signed")
    # a node stands for all rows with the same text
    nodes = signed.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("row_id", "doc_id")).alias("_first")).select("digest", F.col("_first.row_id").alias("node"), F.col("_first.doc_id").alias("doc_id"))
    nodes = cut(nodes, "nodes")
    links = connected_components(cut(_links(d, signed, nodes, threshold, bands, block_rows), "links"))
    found = nodes.select("digest", "node").join(links, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.select("row_id", "doc_id", "digest").join(found, "digest", "left").withColumn("component", F.coalesce("component", "row_id"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    first = out.groupBy("component").agg(F.min(order).alias("_first"))
    out = out.join(first, "component")
    return out.select("row_id", "doc_id", "digest", F.col("_first.doc_id").alias("class_id"), (F.col("row_id") == F.col("_first.row_id")).alias("kept"))


def _links(docs: DataFrame, signed: DataFrame, nodes: DataFrame, threshold: float, bands: int, block_rows: int) -> DataFrame:
    """Verified links a, b between nodes, enough to give the components of all candidate pairs."""
    own = signed.join(nodes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    keys = own.select(F.col("row_id").alias("node"), F.explode("keys").alias("key"))
    # another hub in each bucket, so that no few odd documents stand for all
    hub = F.min(F.struct(F.xxhash64("node", "key"), F.col("node").alias("id")))["id"].alias("hub")
    full = keys.groupBy("key").agg(hub, F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    buckets = cut(keys.join(full, "key"), "buckets")
    some = cut(buckets.select("node").distinct(), "candidates")
    sides = cut(own.select(F.col("row_id").alias("node"), "n_shingles", "signature").join(some, "node"), "candidate-signatures")
    wanted = nodes.join(some, "node").select("node", "digest", F.col("doc_id").alias("_doc"))
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.col("doc_id").cast("long").alias("_id"), "text").filter("text is not null")
    texts = texts.join(wanted, (texts["digest"] == wanted["digest"]) & F.col("_id").eqNullSafe(F.col("_doc"))).select("node", "text")
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")

    def side(frame: DataFrame, to: str) -> DataFrame:
        return frame.withColumnsRenamed({c: to if c == "node" else f"{c}_{to}" for c in frame.columns})

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(side(sides, "a"), "a").join(side(sides, "b"), "b")
        p = p.filter(F.least("n_shingles_a", "n_shingles_b") >= threshold * F.greatest("n_shingles_a", "n_shingles_b"))
        return p.filter(agreement(F.col("signature_a"), F.col("signature_b")) >= threshold - SLACK).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        p = pairs.join(side(texts, "a"), "a").join(side(texts, "b"), "b")
        return p.filter(similarity("text_a", "text_b") >= threshold).select("a", "b")

    stars = cut(buckets.filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n")), "stars")
    # each node with the hub that it shares most bands with
    best = stars.groupBy("node").agg(F.max(F.struct("n", "hub"))["hub"].alias("b")).select(F.col("node").alias("a"), "b")
    links = cut(verified(best), "links")
    # then with its other hubs, where that hasn't joined them
    pairs = stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).join(best, ["a", "b"], "left_anti")
    links = links.union(cut(verified(likely(_apart(pairs, links))), "links"))
    # then all nodes of a bucket that are still in different components
    parts = connected_components(links)
    placed = buckets.select("node", "key").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    placed = cut(_mixed(placed), "mixed-buckets")
    # with s in common, a pair of sizes v and w reaches the threshold t only if s >= t / (1 + t) * (v + w)
    left = placed.select("node").distinct()
    weights = cut(_shared_weights(texts.join(left, "node"), sides.select("node", "n_shingles").join(left, "node")), "shared-weights")
    need = threshold / (1.0 + threshold) - 1e-9
    placed = placed.join(weights, "node")
    least = placed.groupBy("key").agg(F.min("whole").alias("_least"))
    placed = placed.join(least, "key").filter(F.col("shared") >= need * (F.col("whole") + F.col("_least"))).select("key", "node", "part")
    placed = cut(_mixed(placed), "open-buckets")
    return links.union(_compared(placed, _packed_bags(texts), sides, threshold, bands, block_rows))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows (key, node, part) of buckets with nodes of more than one part."""
    keys = placed.groupBy("key").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a < _b").select("key")
    return placed.join(keys, "key")


def _packed_bags(texts: DataFrame) -> DataFrame:
    """node, bag: each text's distinct shingles, ascending, and their counts, as bytes."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table()
        for batch in batches:
            nodes, at = batch["node"].to_numpy(), 0
            for n, words, counts in chunks_of(batch["text"].to_pylist(), 200_000):
                text, h, c = multisets(*shingles(table.look(words) if words else np.zeros(0, np.uint64), counts))
                ends = np.searchsorted(text, np.arange(n + 1))
                bag = [h[a:z].tobytes() + c[a:z].astype(np.uint32).tobytes() for a, z in itertools.pairwise(ends)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + n]), pa.array(bag, pa.binary())], ["node", "bag"])
                at += n

    return texts.select("node", "text").mapInArrow(bags, "node long, bag binary")


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (distinct shingles ascending, counts), neither empty."""
    (h, c), (g, e) = x, y
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    common = np.minimum(c, e[at])[g[at] == h].sum()
    return float(common / (c.sum() + e.sum() - common))


def _compared(placed: DataFrame, bags: DataFrame, sides: DataFrame, threshold: float, bands: int, block_rows: int) -> DataFrame:
    """a, b: links between parts, from blocks of buckets (key, node, part), each pair of blocks in one task.

    A pair is looked at in the first bucket that both are in, if its signatures are near
    enough, and verified unless links of this block pair have joined its parts already:
    what comes out is a forest, never a list of pairs.
    """
    sizes = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    p = placed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    units = F.transform(every, lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    p = p.withColumn("_u", F.explode(units)).select("node", "key", F.col("_u.i").alias("i"), F.col("_u.j").alias("j"), "block", "part")
    p = p.join(sides, "node").join(bags, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        block, node, part, whole = (t[c].to_numpy() for c in ("block", "node", "part", "n_shingles"))
        key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
        signature = np.stack([np.asarray(s.values) for s in t["signature"]]).view(np.uint16)
        keys = band_keys(signature, bands, signature.shape[1] // bands)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        raw, bag, root, found = t["bag"], {}, {}, []

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for a in left.tolist():
            r = right[(right > a)] if i == j else right
            r = r[part[r] != part[a]]
            r = r[np.minimum(whole[r], whole[a]) >= threshold * np.maximum(whole[r], whole[a])]
            r = r[(signature[r] == signature[a]).mean(axis=1) >= threshold - SLACK] if len(r) else r
            if not len(r):
                continue
            same = keys[r] == keys[a]
            for b in r[(keys[a][same.argmax(axis=1)] == key) & same.any(axis=1)].tolist():
                if (x := top(int(part[a]))) == (y := top(int(part[b]))):
                    continue
                for k in (a, b):
                    if k not in bag:
                        bag[k] = _bag(raw[k].as_py())
                if overlap(bag[a], bag[b]) >= threshold:
                    root[max(x, y)] = min(x, y)
                    found.append((a, b))
        if not found:
            return None
        a, b = np.array(found).T
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return p.mapInArrow(grouped(["key", "i", "j"], work), "a long, b long")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those pairs a, b whose ends are in different components of links."""
    parts = connected_components(links)
    p = pairs.join(parts.withColumnsRenamed({"node": "a", "component": "part_a"}), "a", "left").join(parts.withColumnsRenamed({"node": "b", "component": "part_b"}), "b", "left")
    return p.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that aren't kept; all columns stay as they are, whatever their names.

    Rows repeated under one id are one row; null texts are copies of nothing, and all stay.
    """
    found = classes(docs, **options)
    found = found.filter("digest is not null").groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept")
    found = found.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"), F.col("n").alias("_n"))
    # the row travels as one column, so that no name of it can clash
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_digest"), F.struct("*").alias("_row"))
    own = d.filter("_digest is not null").join(found, (F.col("_digest") == F.col("_kept_digest")) & F.col("_id").eqNullSafe(F.col("_kept_id")))
    nth = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy(F.lit(1)))
    repeated = own.filter("_n > 1").withColumn("_nth", nth).filter("_nth <= 1")
    return d.filter("_digest is null").select("_row.*").union(own.filter("_n = 1").select("_row.*")).union(repeated.select("_row.*"))
