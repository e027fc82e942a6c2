"""SimHash near-duplicates with BK-trees.

Fingerprints: the 64-bit majority of the XXH64 values (seed 42) of all word shingles.

Links at a Hamming distance of at most ``RADIUS`` are found in shards: the 64 bits are cut
into ``BLOCKS`` blocks, and two fingerprints within 3 bits agree on at least two of five
blocks. So every pair of blocks gives a table of shards keyed by the bits of the two blocks,
and each link lies within a shard. In a shard the distinct fingerprints form a BK-tree:
children are keyed by their integer distance to the parent, and a search for q at a node
at distance d follows only the edges from d - radius to d + radius. All trees of a task are
built and searched together, level by level, in numpy arrays.

The trees of all shards together grow with the corpus, so they are not broadcast whole: a
shard's tree is built in the task that its fingerprints are dealt to. A shard of more than
``SHARD_ROWS`` fingerprints is cut into sub-blocks, and each pair of sub-blocks becomes a
shard of its own; so a task's memory is bounded and no link is lost.

A task returns, of each shard, only a star (fingerprint, smallest linked one), never all
pairs; connected components of the stars then give the groups. Equal fingerprints are
collapsed first, so groups of exact copies cost one row.

Defined results: null and empty texts (no words) have fingerprint 0 and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows share a component;
rows with a null doc_id get a component only from rows that carry an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common, components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Five blocks of 13, 13, 13, 13 and 12 bits: 3 differing bits leave two blocks equal.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one shard that one task searches.
SHARD_ROWS = 20_000
#: Rows whose trees are searched together.
FOREST_ROWS = 100_000


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The XXH64 values of all shingles of the words, repeats included, unsigned."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(len(words) - size + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[-n:].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer; 0 of none."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = hashes[at : at + (1 << 16)].astype(">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """The fingerprint of lower-cased words, as an unsigned integer."""
    return majority(shingle_hashes(words, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                fp = np.array([fingerprint(raw.lower().split(), size) for raw in common.bytes_of(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, fp long")


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value of each range low[row] <= value < high[row]."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Forest:
    """BK-trees over rows sorted by shard, built level by level for all shards at once."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        self.fp = fp
        first = np.append(True, shard[1:] != shard[:-1]) if len(shard) else np.empty(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.empty(0, np.int64)
        waiting = np.flatnonzero(~first)
        at = self.root[waiting]
        keys, child = [], []
        while len(waiting):
            # at a node, the first row of each distance becomes the child; the others go on below it
            key = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at])
            edge, lead, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            child.append(waiting[lead])
            below = waiting[lead][which]
            stay = below != waiting
            waiting, at = waiting[stay], below[stay]
        order = np.argsort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        self.keys = np.concatenate(keys)[order] if keys else np.empty(0, np.int64)
        self.child = np.concatenate(child)[order] if keys else np.empty(0, np.int64)

    def links(self, radius: int, chunk: int = 2_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, earlier row) within the radius, in pieces of bounded size."""
        for start in range(0, len(self.fp), chunk):
            query = np.arange(start, min(start + chunk, len(self.fp)))
            node = self.root[query]
            while len(query):
                d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
                near = (d <= radius) & (node < query)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
                row, edge = _expand(low, high)
                query, node = query[row], self.child[edge]
                on = node < query  # rows below a node come after it, so later nodes cannot be earlier rows
                query, node = query[on], node[on]


def least_linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row reaches over the pairs."""
    label = np.arange(n)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        nonlocal label
        a = np.concatenate([x for x, _ in kept])
        b = np.concatenate([y for _, y in kept])
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            high, low = np.maximum(la[differ], lb[differ]), np.minimum(la[differ], lb[differ])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]

    for a, b in pairs:
        kept.append((a, b))
        size += len(a)
        if size > 2_000_000:
            settle()
            kept, size = [], 0
    if kept:
        settle()
    return label


def shard_stars(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars (a, b) of reps within shards; rows: (shard long, part int, fp long, rep long)."""

    def search(shard: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        order = np.lexsort((rep, shard))
        shard, fp, rep = shard[order], fp[order], rep[order]
        label = least_linked(len(fp), Forest(shard, fp.view(np.uint64)).links(radius))
        linked = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], names=["a", "b"]) if linked.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            t = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            held.append(t)
            size += t.shape[1]
            if size >= FOREST_ROWS:
                t = np.concatenate(held, axis=1)
                last = (t[0] == t[0, -1]) & (t[1] == t[1, -1])  # the last shard may go on in the next batch
                done, rest = t[:, ~last], t[:, last]
                if done.shape[1] and (out := _searched(done)) is not None:
                    yield out
                held, size = [rest], rest.shape[1]
        if size and (out := _searched(np.concatenate(held, axis=1))) is not None:
            yield out

    def _searched(t: np.ndarray) -> pa.RecordBatch | None:
        changes = np.append(True, (t[0, 1:] != t[0, :-1]) | (t[1, 1:] != t[1, :-1]))
        return search(np.cumsum(changes), t[2], t[3])

    dealt = rows.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return dealt.mapInArrow(common.tidy(run), "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges (a, b) between reps of distinct fingerprints (fp, rep) that are linked."""
    if radius > 3:
        raise ValueError("five blocks find links of at most 3 bits")
    tables = []
    for t, ((s1, n1), (s2, n2)) in enumerate(combinations(BLOCKS, 2)):
        one = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << n1) - 1))
        two = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << n2) - 1))
        tables.append(F.lit(t << 26).cast("long") + F.shiftleft(one, 13) + two)
    shards = nodes.select("fp", "rep", F.explode(F.array(*tables)).alias("shard"))
    # shards of one row hold no link; shards of many rows are cut
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("cuts"))
    cut = shards.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    other = cut.select("shard", "fp", "rep", "own", "cuts", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    part = F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")
    return shard_stars(other.select("shard", part.alias("part"), "fp", "rep"), radius)


def groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to) of every document."""
    fps = common.materialise(fingerprints(docs, size), "fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components.components(links(nodes.where("rep IS NOT NULL"), radius).distinct())
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns."""
    later = groups(docs, size, radius).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = groups(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
