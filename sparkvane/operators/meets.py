"""Rows that are compared all with all, within blocks: dealt in chunks of like sizes, a pair of chunks to a task.

Rows of a block lie in order of size, cut into chunks of a bounded weight. Chunks whose sizes may hold similar rows
meet in one group of a grouped map, which counts in arrays and gives only the pairs that its filter leaves. So no
pair is written before it is a likely one, memory is bounded by two chunks, and disk by the input and its copies, one
for each chunk that a chunk meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.sources.tables import staged

#: Weight of a chunk: tokens, or characters.
CHUNK = 4_000_000
#: Values that are summed in one step.
STEP = 4_000_000
#: Bits of a parity bitmap.
BITS = 2048
#: Bins of letters, and words of 64 bits that hold their counts at most.
LETTERS, WORDS = 32, 8
#: Rows whose bitmaps are built in one step, by their bits together.
CELLS = 1 << 23


def dealt(rows: DataFrame, block: str, size: str, weight: str, shortest: float, chunk: int | None = None) -> DataFrame:
    """``rows`` (a written table with ``id``) once for each pair of chunks (block, left, right) that its own is in, with
    ``at`` (its chunk); ``shortest``: the least share of the larger size that the smaller one of a pair has."""
    chunk = chunk or CHUNK
    upto = Window.partitionBy(block).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy(block, size).agg(F.sum(weight).alias("_w")).withColumn("_from", F.sum("_w").over(upto) - F.col("_w"))
    # rows of one size are spread over the chunks that their size covers
    place = F.col("_from") + F.pmod(F.xxhash64("id"), F.col("_w"))
    at = staged(rows.join(sizes, [block, size]).withColumn("at", F.floor(place / chunk).cast("int")).drop("_w", "_from"), "chunks")
    ends = staged(at.groupBy(block, "at").agg(F.min(size).alias("lo"), F.max(size).alias("hi")), "chunk-ends")
    a, b = (ends.select(block, F.col("at").alias(x), F.col("lo").alias("lo_" + x), F.col("hi").alias("hi_" + x)) for x in ("left", "right"))
    meet = a.join(b, block).where((F.col("left") <= F.col("right")) & (F.col("hi_left") >= (shortest - 1e-9) * F.col("lo_right"))).select(block, "left", "right")
    each = meet.withColumn("at", F.explode(F.array_distinct(F.array("left", "right"))))
    return at.join(each, [block, "at"])


def expand(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All values of the ranges of ``n`` values from ``low``, one range after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + n, n)


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists of numbers without nulls."""
    parts = [c for c in column.chunks if len(c)]
    n = [np.diff(c.offsets.to_numpy()) for c in parts]
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in parts]
    return (np.concatenate(values) if values else np.empty(0, np.int64)), np.append(0, np.cumsum(np.concatenate(n))) if n else np.zeros(1, np.int64)


def shared(keys: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left``, its place there and how many keys it shares with each row of ``right`` (places of lists)."""
    n = np.diff(offsets)
    held = keys[expand(offsets[right], n[right])]
    order = np.argsort(held, kind="stable")
    holder = np.repeat(np.arange(len(right), dtype=np.int32), n[right])[order]
    known, first = np.unique(held[order], return_index=True)
    often = np.diff(np.append(first, len(held)))
    wanted = keys[expand(offsets[left], n[left])]
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    found = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
    start, count = (first[at], np.where(found, often[at], 0)) if len(known) else (at, np.zeros(len(at), np.int64))
    ends = np.append(0, np.cumsum(n[left]))
    for i in range(len(left)):
        s = slice(ends[i], ends[i + 1])
        yield i, np.bincount(holder[expand(start[s], count[s])], minlength=len(right))


def parity(keys: np.ndarray, offsets: np.ndarray, rows: int = 2_000) -> np.ndarray:
    """A bitmap of each list, in which each key flips one bit: two differ in no more bits than the lists have keys apart."""
    out = []
    for a in range(0, len(offsets) - 1, rows):
        ends = offsets[a : a + rows + 1]
        cell = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * BITS + (keys[ends[0] : ends[-1]] & (BITS - 1))
        flipped = (np.bincount(cell, minlength=(len(ends) - 1) * BITS) & 1).astype(bool)
        out.append(np.packbits(flipped.reshape(-1, BITS), axis=1).view(np.uint64))
    return np.concatenate(out)


def sums(mark: np.ndarray, code: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many marked codes each range of ``n`` codes from ``low`` has, a bounded number of codes at a time."""
    out, ends = [], np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
        part = n[start:stop]
        out.append(np.add.reduceat(mark[code[expand(low[start:stop], part)]], np.append(0, np.cumsum(part)[:-1]), dtype=np.int64))
        start = stop
    return np.concatenate(out)


def characters(titles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all titles, one after the other, offsets)."""
    texts = titles.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


def letters(codes: np.ndarray, ends: np.ndarray, rows: int = 2_000) -> np.ndarray:
    """Counts, for each title, of its letters in ``LETTERS`` bins."""
    out = np.zeros((len(ends) - 1, LETTERS), np.int32)
    for a in range(0, len(out), rows):
        e = ends[a : a + rows + 1]
        cell = np.repeat(np.arange(len(e) - 1) * LETTERS, np.diff(e)) + codes[e[0] : e[-1]] % LETTERS
        out[a : a + rows] = np.bincount(cell, minlength=(len(e) - 1) * LETTERS).reshape(-1, LETTERS)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Bits of each row, a word of 64 to a row of the result: whether a count reaches a level, for the levels that part the rows most.
    Two rows differ in no more bits than their counts do in sum."""
    bins = [np.unique(c, return_counts=True) for c in counts.T]
    share = [1 - np.cumsum(k)[:-1] / len(counts) for _, k in bins]
    split = sorted(((p * (1 - p), b, v) for b, ((at, _), ps) in enumerate(zip(bins, share, strict=True)) for p, v in zip(ps, at[1:], strict=True)), reverse=True)
    chosen = [x for x in split[: 64 * WORDS] if x[0] > 0.02] or split[:1]
    bits = np.zeros((len(counts), -(-max(len(chosen), 1) // 64) * 64), bool)
    for k, (_, b, v) in enumerate(chosen):
        bits[:, k] = counts[:, b] >= v
    return np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


def grams(codes: np.ndarray, n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the runs of ``q`` characters of texts of ``n`` characters that follow each other, how many each text has): two texts share no
    fewer keys than they share runs, each as often as both have it."""
    h = np.zeros(max(len(codes) - q + 1, 0), np.uint32)
    for k in range(q if len(h) else 0):
        h *= np.uint32(0x01000193)
        h += codes[k : len(h) + k]
    held = np.maximum(n - q + 1, 0)
    low = np.cumsum(n) - n
    each = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), held) << np.uint64(32)) | h[expand(low, held)])
    first = starts(each)
    keys = each.astype(np.uint32)
    keys += np.uint32(0x9E3779B1) * (np.arange(len(each)) - np.repeat(first, np.diff(first, append=len(each)))).astype(np.uint32)
    keys ^= keys >> np.uint32(15)
    keys *= np.uint32(0x85EBCA6B)
    keys ^= keys >> np.uint32(13)
    return keys, held


def starts(values: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array is first."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def anchors(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """In how many runs, but one, each of the texts can match another in ``difflib``: from 200 characters on, a run but the first one holds a
    character that is not a popular one (one in a hundred and one more)."""
    each = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | codes)
    first = starts(each)
    count, row = np.diff(first, append=len(each)), (each[first] >> np.uint64(32)).astype(np.int64)
    rare = np.bincount(row, np.where(count > n[row] // 100 + 1, 0, count), minlength=len(n)).astype(np.int64)
    return np.where(n < 200, n, rare)


def presence(keys: np.ndarray, low: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap, of ``bits`` (a power of two), of the ``n`` keys from each place of ``low`` on: two differ in no more bits than the keys do."""
    out = np.empty((len(low), bits // 64), np.uint64)
    rows = max(1, CELLS // bits)
    for a in range(0, len(low), rows):
        k = n[a : a + rows]
        held = np.zeros(len(k) * bits, bool)
        held[np.repeat(np.arange(len(k)) * bits, k) + (keys[expand(low[a : a + rows], k)] & np.uint32(bits - 1))] = True
        out[a : a + rows] = np.packbits(held.reshape(-1, bits), axis=1).view(np.uint64)
    return out


def apart(bitmaps: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of each pair of rows differ, a bounded number of words at a time."""
    rows = max(1, STEP // 16 // bitmaps.shape[1])
    parts = [np.bitwise_count(bitmaps[x[a : a + rows]] ^ bitmaps[y[a : a + rows]]).sum(1, dtype=np.int64) for a in range(0, len(x), rows)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def grouped(rows: DataFrame, block: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy(block, "left", "right").applyInArrow(run, schema)
