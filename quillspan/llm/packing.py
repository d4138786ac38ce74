"""Hierarchical multi-length packing of documents into training sequences.

Context sizes are powers of two from `longest` down to `shortest`.  A document's
ids are cut into whole longest sequences; what remains is routed to the smallest
tier that holds it.  Each tier is packed from the longest down: a window opens
with a piece of its own tier and its gap is filled with the longest pieces of
shorter tiers that fit, then, if need be, with the head of one cut to measure, so
windows are exactly full.  Only at the end of a partition is a last window without
anything to fill it cut into powers of two, so nothing is padded at all.
Sequences go to step groups of about `group_tokens` ids, costliest first to the
group with the least attention cost (length squared).

One pass over each input partition, no shuffle; a partition holds at most `pool`
pieces of less than `longest` ids, and ids depend only on the partition's rows, so
a rerun of a lost task gives the same sequences.

Defined results: null and empty texts are the one id 0; each row of the input is
packed, repeated rows too (`row_id` tells them apart); null ids are carried.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspan.llm.subwords import encode

LONGEST, SHORTEST, POOL, GROUP_TOKENS, END = 1024, 64, 2048, 65536, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long, row_id long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Packs pieces (doc, start, ids); `rows` collects what is finished."""

    def __init__(self, first_id: int, longest: int = LONGEST, shortest: int = SHORTEST, pool: int = POOL, group_tokens: int = GROUP_TOKENS):
        self.longest, self.shortest, self.pool, self.group_tokens = longest, shortest, pool, group_tokens
        self.sequence = self.group = first_id
        self.pieces: list[tuple[int, int, int, tuple, np.ndarray]] = []
        self.order = 0
        self.open: list[list] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        """doc: (doc_id, doc_tokens, row_id)."""
        whole = len(ids) - len(ids) % self.longest
        for a in range(0, whole, self.longest):
            self._close([(doc, a, ids[a : a + self.longest])], self.longest)
        if whole < len(ids):
            self._put(doc, whole, ids[whole:])

    def _put(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.order += 1
        insort(self.pieces, (len(ids), self.order, start, doc, ids), key=lambda x: x[:2])

    def _tier(self, n: int) -> int:
        return max(self.shortest, 1 << (n - 1).bit_length())

    def _close(self, parts: list, context: int) -> None:
        self.open.append([self.sequence, context, parts])
        self.sequence += 1

    def full(self) -> bool:
        return len(self.pieces) >= self.pool or len(self.open) >= self.pool

    def pack(self, last: bool) -> None:
        """Pack the pool; without `last`, pieces that can't fill their window wait."""
        while self.pieces:
            n, _, start, doc, ids = self.pieces.pop()
            context = self._tier(n)
            parts, gap = [(doc, start, ids)], context - n
            while gap and self.pieces:
                at = bisect_right(self.pieces, gap, key=lambda x: x[0])
                if at:  # the longest that fits
                    m, order, s, d, x = self.pieces.pop(at - 1)
                    parts.append((d, s, x))
                    gap -= m
                else:  # the head of the shortest
                    m, order, s, d, x = self.pieces.pop(0)
                    parts.append((d, s, x[:gap]))
                    self._put(d, s + gap, x[gap:])
                    gap = 0
            if not gap:
                self._close(parts, context)
            elif not last:
                for d, s, x in parts:
                    self._put(d, s, x)
                return
            else:
                self._powers(parts)

    def _powers(self, parts: list) -> None:
        """Cut the last pieces into sequences whose lengths are powers of two."""
        left = sum(len(x) for _, _, x in parts)
        while left:
            size = 1 << (left.bit_length() - 1)
            own, need = [], size
            while need:
                d, s, x = parts.pop(0)
                own.append((d, s, x[:need]))
                if len(x) > need:
                    parts.insert(0, (d, s + need, x[need:]))
                need -= min(need, len(x))
            self._close(own, size)
            left -= size

    def rows(self) -> list[tuple]:
        """Rows of the finished sequences, with step groups of even cost."""
        total = sum(c for _, c, _ in self.open)
        groups = max(1, -(-total // self.group_tokens))
        heap = [(0, g) for g in range(groups)]
        out = []
        for sequence, context, parts in sorted(self.open, key=lambda x: (-x[1], x[0])):
            cost, g = heapq.heappop(heap)
            heapq.heappush(heap, (cost + context * context, g))
            at = 0
            for (doc_id, doc_tokens, row_id), start, ids in parts:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, sequence, at, context, self.group + g, row_id))
                at += len(ids)
        self.group += groups
        self.open = []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(_NAMES), _NAMES)


def pack(docs: DataFrame, longest: int = LONGEST, shortest: int = SHORTEST, pool: int = POOL, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of the rows of docs (doc_id, text); see SCHEMA."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        packer, row = Packer(first, longest, shortest, pool, group_tokens), first
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encode(text.as_py()), np.array([END], "<u4"))
                packer.add((doc_id, len(ids), row), ids)
                row += 1
                if packer.full():
                    packer.pack(last=False)
                    if len(packer.open) >= packer.pool // 4:
                        yield _batch(packer.rows())
        packer.pack(last=True)
        yield _batch(packer.rows())

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(packed, SCHEMA)
