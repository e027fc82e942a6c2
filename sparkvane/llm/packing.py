"""Harmonic packing of token sequences into rows of fixed capacity C.

A document's ids (with the end id) longer than C first give whole capacities, each a sequence of
its own. What is left of it, or a shorter document, is a piece of length r. Pieces fall into
reciprocal-capacity classes: class k holds the lengths with C / (k + 1) < r <= C / k, and a bin of
class k takes exactly k pieces, whole. So a bin needs nothing but a counter, and workers fill
their bins independently. Pieces of at most C / ``CLASSES`` are the fill: they close the gaps
that full bins leave, and the last one into a gap is cut to its size (the rest of it goes on to
the next gap).

At the end of a worker's rows the pieces of bins that are not full join the fill, and so do the
bins whose gaps nothing is left for. What then remains, less than one capacity, is cut by its
binary digits into sequences whose lengths are powers of two, which are not padded. So no
sequence is padded, and documents that fit a sequence are cut only where they are fill.

Scale: one map over the texts; no shuffle and no row moves, as a sequence's id is that of its
worker's partition and a number within it, and a task that runs again gives the same rows. A
worker holds at most ``WAITING`` bins and as many capacities of fill: beyond it the oldest bin
becomes fill, or fill makes sequences of its own.

Defined results: a null or empty text is the end id alone; repeated rows and rows of equal or
null doc_id are packed each; extra columns are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm import common, tokens

CAPACITY = 2048
#: Classes by reciprocal capacity; shorter pieces than the last one's are fill.
CLASSES = 8
#: Bins that wait for fill, and capacities of fill that wait for bins.
WAITING = 256
END_ID = 1

ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in ROWS.split(", ")])


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    length: int
    doc_tokens: int
    raw: bytes  # little-endian ids of the piece

    def cut(self, at: int) -> tuple[Piece, Piece]:
        one = self._replace(length=at, raw=self.raw[: 4 * at])
        return one, self._replace(start=self.start + at, length=self.length - at, raw=self.raw[4 * at :])


class Packer:
    """The bins of one worker; finished sequences are lists of pieces in ``done``."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, waiting: int = WAITING) -> None:
        self.capacity, self.classes, self.most = capacity, classes, waiting
        self.open: dict[int, list[Piece]] = {}
        self.waiting: deque[tuple[int, list[Piece]]] = deque()  # (gap, pieces)
        self.fill: deque[Piece] = deque()
        self.fill_tokens = 0
        self.done: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw, n, at = ids.astype("<u4").tobytes(), len(ids), 0
        while n - at >= self.capacity:
            self.done.append([Piece(doc_id, at, self.capacity, n, raw[4 * at : 4 * (at + self.capacity)])])
            at += self.capacity
        if at == n:
            return
        piece = Piece(doc_id, at, n - at, n, raw[4 * at :])
        k = self.capacity // piece.length
        if k >= self.classes:
            self._to_fill([piece])
        else:
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.waiting.append((self.capacity - sum(p.length for p in held), held))
                del self.open[k]
        self._close()
        while len(self.waiting) > self.most:
            self._to_fill(self.waiting.popleft()[1])
            self._close()
        while self.fill_tokens > self.most * self.capacity:
            self.done.append(self._take(self.capacity))

    def _to_fill(self, pieces: list[Piece]) -> None:
        self.fill.extend(pieces)
        self.fill_tokens += sum(p.length for p in pieces)

    def _take(self, n: int) -> list[Piece]:
        """Exactly n tokens of fill."""
        out = []
        self.fill_tokens -= n
        while n:
            piece = self.fill.popleft()
            if piece.length > n:
                piece, rest = piece.cut(n)
                self.fill.appendleft(rest)
            out.append(piece)
            n -= piece.length
        return out

    def _close(self) -> None:
        """Close the gaps of waiting bins, the oldest first, as far as the fill goes."""
        while self.waiting and self.waiting[0][0] <= self.fill_tokens:
            gap, pieces = self.waiting.popleft()
            self.done.append(pieces + self._take(gap))

    def finish(self) -> None:
        for k in sorted(self.open):
            self._to_fill(self.open[k])
        self.open.clear()
        self._close()
        while self.waiting:
            self._to_fill(self.waiting.pop()[1])
            self._close()
        while self.fill_tokens >= self.capacity:
            self.done.append(self._take(self.capacity))
        size = self.capacity >> 1
        while self.fill_tokens:
            if self.fill_tokens >= size:
                self.done.append(self._take(size))
            size >>= 1


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; the capacity is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        packer, made = Packer(capacity, classes), 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            out = []
            for sequence in packer.done:
                offset = 0
                for p in sequence:
                    out.append((p.doc_id, p.start, p.length, zlib.crc32(p.raw), p.doc_tokens, first + made, offset))
                    offset += p.length
                made += 1
            packer.done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for part in common.text_blocks(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encoder(vocabulary).encode(common.texts_of(part)), strict=True):
                    packer.add(doc_id, np.append(ids, END_ID))
                if packer.done:
                    yield flush()
        packer.finish()
        if packer.done:
            yield flush()
        tokens.encoder(vocabulary).rest()

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), ROWS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return pack(common.read(spark, sf_dir, "documents", "doc_id", "text"))
