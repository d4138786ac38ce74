"""Whitening of embeddings: Welford updates in the tasks, parallel merges, symmetric QR.

A vector's entries become whole numbers, floor(256 c).  The fit list has each distinct
vector once.  Every task runs Welford's rank-one updates over its part of the list;
the tasks' states (number, mean, squares) merge by the parallel update formula, some
dozens at a time, in rounds of tasks.  What reaches the driver is one state of d x d
numbers, where Householder reflections and implicit QR steps give eigenvalues and
eigenvectors.  Projections are made in tasks again, over all rows.

Defined results: a row goes if its vector is null or empty, holds null or non-finite
entries, or has another length than most (of equally frequent lengths the longest
counts): it lacks entries then.  Null and repeated ids are kept as they are; repeated
vectors count once in the fit.  An entry whose number doesn't fit into a long
saturates; a deviation that doesn't fit is null.  Components without variance
(one vector, a constant dimension) have whitened 0 and don't count in identity_error; `explained`
is 0 if nothing varies.  No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import cut

STEP, COMPONENTS = 256.0, 4
#: States that one task merges.
MERGED_AT_ONCE = 32
_LONG = 1 << 63


def whole(entries: np.ndarray) -> np.ndarray:
    """floor(256 c) of doubles as longs; what is too large for a long saturates."""
    x = np.floor(entries * STEP)
    inside = np.clip(x, -float(_LONG), np.nextafter(float(_LONG), 0)).astype(np.int64)
    return np.where(x >= float(_LONG), np.int64(_LONG - 1), inside)


def pieces(batches: Iterator[pa.RecordBatch], d: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most about `most` entries."""
    step = max(1, most // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors x as rows."""
    flat = batch.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return whole(flat.reshape(-1, d))


class Moments:
    """Number, mean and sum of squared deviations of vectors, and their exact sums."""

    def __init__(self, d: int):
        self.n, self.mean, self.squares, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, rows: np.ndarray) -> Moments:
        """Welford: each vector is one rank-one update."""
        for x in rows.astype(np.float64):
            self.n += 1
            off = x - self.mean
            self.mean += off / self.n
            self.squares += np.outer(off * ((self.n - 1) / self.n), off)
        return self

    def add_whole(self, rows: np.ndarray) -> Moments:
        """add(), and exact sums: halves of 32 bits can't overflow within a batch."""
        high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
        self.sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(self.sums, high, low, strict=True)]
        return self.add(rows)

    def merge(self, other: Moments) -> Moments:
        """Chan's update: the states of two parts make that of both."""
        n = self.n + other.n
        if other.n:
            off = other.mean - self.mean
            self.squares += other.squares + np.outer(off, off) * (self.n * other.n / n)
            self.mean += off * (other.n / n)
            self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
            self.n = n
        return self

    def covariance(self) -> np.ndarray:
        return self.squares / max(1, self.n)

    def packed(self) -> pa.RecordBatch:
        values = [[self.n], [self.mean.tobytes()], [self.squares.tobytes()], [[str(s) for s in self.sums]]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["n", "mean", "squares", "sums"])

    @staticmethod
    def unpacked(n: int, mean: bytes, squares: bytes, sums: list[str]) -> Moments:
        d = len(mean) // 8
        m = Moments(d)
        m.n, m.mean, m.squares, m.sums = n, np.frombuffer(mean).copy(), np.frombuffer(squares).reshape(d, d).copy(), [int(s) for s in sums]
        return m


_STATE = "n long, mean binary, squares binary, sums array<string>"


def total(states: DataFrame, d: int, at_once: int = MERGED_AT_ONCE) -> Moments:
    """All tasks' states merged, at_once of them by one task, in rounds until one task's worth is left."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in batches:
            for row in batch.to_pylist():
                own.merge(Moments.unpacked(**row))
        if own.n:
            yield own.packed()

    states = cut(states, "moments")
    while (left := states.count()) > at_once:
        states = cut(states.repartition(-(-left // at_once)).mapInArrow(merged, _STATE), "moments")
    found = Moments(d)
    for row in states.collect():  # at most at_once states of d x d numbers
        found.merge(Moments.unpacked(**{k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.asDict().items()}))
    return found


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, subdiagonal and the orthogonal q with q t q' = a."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0.0:
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2.0 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(matrix: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: tridiagonal form, then implicit QR steps with Wilkinson's shift."""
    t, s, q = tridiagonal((matrix + matrix.T) / 2.0)
    tiny = np.finfo(float).eps
    high, steps = len(t) - 1, 0
    while high > 0:
        small = np.abs(s[:high]) <= tiny * (np.abs(t[:high]) + np.abs(t[1 : high + 1]))
        s[:high][small] = 0.0
        if s[high - 1] == 0.0:
            high, steps = high - 1, 0
            continue
        zeros = np.flatnonzero(s[:high] == 0.0)
        low = int(zeros[-1]) + 1 if len(zeros) else 0
        steps += 1
        if steps > most_steps:
            raise ArithmeticError("eigenvalues don't converge")
        half = (t[high - 1] - t[high]) / 2.0
        shift = t[high] - s[high - 1] ** 2 / (half + math.copysign(math.hypot(half, s[high - 1]), half))
        x, z = t[low] - shift, s[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, n = (x / r, -z / r) if r else (1.0, 0.0)
            if k > low:
                s[k - 1] = r
            a, b, o = t[k], t[k + 1], s[k]
            t[k] = c * c * a - 2.0 * c * n * o + n * n * b
            t[k + 1] = n * n * a + 2.0 * c * n * o + c * c * b
            s[k] = c * n * (a - b) + (c * c - n * n) * o
            if k < high - 1:
                x, z = s[k], -n * s[k + 1]
                s[k + 1] *= c
            q[:, k], q[:, k + 1] = c * q[:, k] - n * q[:, k + 1], n * q[:, k] + c * q[:, k + 1]
    order = np.argsort(-t, kind="stable")
    return t[order], q[:, order]


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding of the rows that remain, and their length."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = embeddings.select("vec_id", "embedding").filter(e.isNotNull() & (F.size(e) > 0)).filter(finite)
    lengths = rows.groupBy(F.size(e).alias("d")).count().agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()[0]
    return rows.filter(F.size(e) == (lengths or 0)), lengths or 0


def fit_list(rows: DataFrame, d: int) -> DataFrame:
    """x: each distinct vector once, as bytes of longs; every task leaves out its own copies before the shuffle."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in matrix(batch, d)], pa.binary())], ["x"])

    return cut(rows.select("embedding").mapInArrow(keys, "x binary").distinct(), "fit")


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"].to_pylist()), np.int64).reshape(batch.num_rows, -1)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error; see the contract in the README."""
    rows, d = usable(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return embeddings.sparkSession.createDataFrame([], out)
    fit = fit_list(rows, d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in pieces(batches, d):
            own.add_whole(vectors(batch))
        if own.n:
            yield own.packed()

    found = total(fit.mapInArrow(moments, _STATE), d)
    n, sums = found.n, found.sums
    values, axes = eigen(found.covariance())
    k = min(components, d)
    trace, values, axes = float(np.trace(found.covariance())), values[:k], axes[:, :k]
    varies = values > np.finfo(float).eps * d * max(float(values[0]), 0.0)
    # whole and fraction of S/n apart: x less the whole part is exact
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    scale = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    project = lambda x: ((x.astype(np.float64) - base) - rest) @ scale

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(k)
        for batch in pieces(batches, d):
            own.add(project(vectors(batch)))
        if own.n:
            yield own.packed()

    seen = total(fit.mapInArrow(spread, _STATE), k).covariance()
    error = float(np.abs((seen - np.eye(k))[np.ix_(varies, varies)]).max()) if varies.any() else 0.0
    explained = values / trace if trace > 0 else np.zeros(k)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in out.split(", ")]
        for batch in pieces(batches, d):
            x = matrix(batch, d)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch["vec_id"].take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(each),
                pa.array(project(x).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(results, out)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """Exact sums of (n x - S)^2; None where one doesn't fit into a long."""
    most = max(abs(int(x.min())), abs(int(x.max()))) * n + max(abs(s) for s in sums)
    if most * most * x.shape[1] < _LONG:
        off = x * np.int64(n) - np.array(sums, np.int64)
        return (off * off).sum(axis=1)
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < _LONG else None for v in exact]
