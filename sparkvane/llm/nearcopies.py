"""Near copies at a similarity of 0.8: SimHash and BK-trees first, exact by prefix filter and verification.

The set of a document is its distinct shingles of ``SHINGLE`` lower-cased words (as XXH64, seed
42); two documents are linked at a Jaccard similarity of at least 0.8, that is where 9 x shared is at
least 4 x (size + size). Connected components of the links are the groups.

Fingerprints of near copies at this similarity differ in up to some 14 of 64 bits, which no
search by radius reaches. So the fingerprints' links (3 bits, by BK-trees) give the
first pairs, each verified, and tie most copies cheaply. The rest are found without loss: in any one
order of all shingles, linked sets share one of their first n - ceil(0.8 n) + 1, so documents
meet on those alone, and sizes and places rule out most before texts are compared. The order puts
common shingles last, by powers of two, so shared lines seldom make documents meet: first those that are common in
a sample of documents, then, in rounds, those on which ``CROWD`` or more sets still meet in the whole
corpus, as a sample of constant size misses ever larger ones. Which they are changes the work, never the result.

Before texts move, pairs are held against parity bitmaps of about a bit a shingle: each shingle flips
one bit, so two bitmaps differ in no more bits than the sets have shingles apart, which at this
similarity is at most a ninth of both sizes. Pairs that differ in more are no links.

Equal sets are collapsed first. Documents that share a shingle and are in different groups are
compared with the least of them; only those that this leaves in different groups are compared with
each other, so a large group of near copies does not cost all its pairs.

Defined results: null and empty texts (no words) are one group; texts of fewer words than a
shingle are one shingle; rows of one doc_id share a group; rows with a null doc_id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.llm import common, components, simhash

SHINGLE = 5
SEED = 42
#: Documents sampled for common shingles, the least count there, and the most that are kept.
SAMPLE, LEAST, MOST = 2_000, 3, 200_000
#: Sets that may meet on one shingle before it is put later, and the rounds in which that is done.
CROWD, ROUNDS = 32, 2
#: Cells that ids are hashed to where texts are asked for.
CELLS = 1 << 20
#: Common shingles, sorted, and how late each comes.
Often = tuple[np.ndarray, np.ndarray]


def hashes(raw: bytes) -> np.ndarray:
    """The hashes of all shingles of a text, repeats included."""
    return simhash.shingle_hashes(raw.lower().split(), SHINGLE)


def shingles(raw: bytes) -> np.ndarray:
    """The distinct shingles of a text, as sorted signed hashes."""
    return np.unique(hashes(raw).view(np.int64))


def prefix(found: np.ndarray, often: Often) -> np.ndarray:
    """The first shingles of a set, in the order that puts common ones last."""
    n, (ones, levels) = len(found), often
    if not n:
        return found
    level = np.zeros(n, np.int8)
    if len(ones):
        at = np.minimum(np.searchsorted(ones, found), len(ones) - 1)
        level = np.where(ones[at] == found, levels[at], level)
    return found[np.argsort(level, kind="stable")][: n - (4 * n + 4) // 5 + 1]


def ranked(counts: dict[int, float]) -> Often:
    """Shingles with the power of two of their counts, one at least."""
    ones = np.array(sorted(counts), np.int64)
    return ones, np.array([max(1, int(np.log2(counts[h]))) for h in ones.tolist()], np.int8)


def common_shingles(docs: DataFrame) -> dict[int, float]:
    """Shingles of several documents of a sample of constant size, with the number of documents that this makes likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                for raw in common.bytes_of(part):
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(raw))], names=["h"])

    share = min(1.0, SAMPLE / max(docs.count(), 1))
    sample = docs.select("text").sample(share, seed=SEED)
    each = sample.mapInArrow(common.tidy(run), "h long")
    often = each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "h").limit(MOST)
    return {r["h"]: r["n"] / share for r in often.collect()}


def prefixes(docs: DataFrame, often: Often) -> DataFrame:
    """(doc_id, fp, n, digest, bits, keys): fingerprint; size, digest, parity bitmap and first shingles of each set."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in common.text_blocks(batch):
                out: list[tuple] = []
                for doc_id, raw in zip(part.column(0).to_pylist(), common.bytes_of(part), strict=True):
                    every = hashes(raw)
                    found = np.unique(every.view(np.int64))
                    out.append((doc_id, simhash.majority(every), len(found), xxh3_128_digest(found.tobytes()), parity(found), prefix(found, often)))
                cols = [list(c) for c in zip(*out, strict=True)]
                cols[1] = np.array(cols[1], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(common.tidy(run), "doc_id long, fp long, n int, digest binary, bits binary, keys array<long>")


def uncrowded(docs: DataFrame, nodes: DataFrame, counts: dict[int, float]) -> DataFrame:
    """The sets (rep, digest, keys, ...) with first shingles on which few others meet, as far as they have such.

    A round counts the sets on each first shingle, puts the crowded ones later and takes the first shingles of
    the sets that held one anew. A set that held none keeps its own: the new order has the same ones first.
    """
    for _ in range(ROUNDS):
        held = nodes.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
        found = {r["h"]: r["n"] for r in held.orderBy(F.desc("n"), "h").limit(MOST).collect()}
        fresh = [h for h in found if h not in counts]
        fresh = fresh[: 2 * MOST - len(counts)]  # what is broadcast stays bounded
        if not fresh:
            break
        counts = counts | {h: found[h] for h in fresh}
        crowd, often = np.array(sorted(fresh), np.int64), ranked(counts)

        def run(batches: Iterator[pa.RecordBatch], crowd: np.ndarray = crowd) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(1)
                flat = keys.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(np.isin(flat, crowd))])
                at = keys.offsets.to_numpy() - keys.offsets[0].as_py()
                yield batch.select([0]).filter(pa.array(ends[at[1:]] > ends[at[:-1]]))

        cells = nodes.select("rep", "keys").mapInArrow(common.tidy(run), "rep long").select(_cell("rep")).distinct()
        texts = docs.join(F.broadcast(cells), _cell("doc_id") == F.col("cell"), "left_semi")
        anew = prefixes(texts, often).groupBy("digest").agg(F.any_value("keys").alias("anew"))
        nodes = common.materialise(nodes.join(anew, "digest", "left").withColumn("keys", F.coalesce("anew", "keys")).drop("anew"), "nodes")
    return nodes


def _cell(doc_id: str) -> Column:
    """The cell that an id is hashed to: at most CELLS of them are broadcast, however many ids there are."""
    return F.pmod(F.xxhash64(doc_id), F.lit(CELLS)).alias("cell")


def parity(found: np.ndarray) -> bytes:
    """A bitmap of at least a bit a shingle, and 256; each shingle flips the bit of its lowest digits."""
    size = max(256, 1 << max(len(found) - 1, 0).bit_length())
    return np.packbits((np.bincount((found & (size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the larger is folded to the size of the smaller."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def near(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, x, nb, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [9 * differing(p, q) <= m + n for m, p, n, q in zip(na, x, nb, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda end: nodes.select(F.col("rep").alias(end), F.col("n").alias("n" + end), F.col("bits").alias("bits" + end))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb")
    return both.mapInArrow(common.tidy(run), "a long, b long").distinct()


def _close(na: Column, ia: Column, nb: Column, ib: Column) -> Column:
    """Whether sets whose first shared shingle is at these places may be similar enough."""
    return 9 * F.least(na - ia, nb - ib) >= 4 * (na + nb)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar enough, written."""
    pairs = common.materialise(near(nodes, pairs), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                keep = []
                for x, y in zip(common.bytes_of(part), common.bytes_of(part, "other"), strict=True):
                    s, t = shingles(x), shingles(y)
                    keep.append(9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # texts move only where an id falls in a cell that some pair's id falls in
    cells = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(_cell("doc_id")).distinct()
    texts = docs.select("doc_id", "text", _cell("doc_id")).join(F.broadcast(cells), "cell", "left_semi").select("doc_id", "text")
    one = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    return common.materialise(both.select("a", "b", "text", "other").mapInArrow(common.tidy(run), "a long, b long").distinct(), "links")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, by their least doc_id, with equal or linked fingerprints."""
    least = nodes.groupBy("fp").agg(F.min("rep").alias("least"), F.max("rep").alias("last"))
    equal = nodes.join(least.where("least < last"), "fp").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    stars = simhash.links(least.select("fp", F.col("least").alias("rep"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(stars).distinct()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not yet in one group."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(end + "_group"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links lead to) of every row with a doc_id."""
    counts = common_shingles(docs)
    sets = common.materialise(prefixes(docs, ranked(counts)), "prefixes")
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("keys").alias("keys"))
    nodes = uncrowded(docs, common.materialise(nodes, "nodes"), counts).drop("digest")
    links = verified(docs, nodes, fingerprint_pairs(nodes))
    found = components.components(links)

    keys = nodes.select("rep", "n", F.posexplode("keys").alias("i", "h"))
    same = Window.partitionBy("h")  # one shuffle; the first shingles of all sets are the largest table here
    led = keys.withColumns({"lead": F.min(F.struct("rep", "n", "i")).over(same), "last": F.max("rep").over(same)})
    held = common.materialise(led.where("lead.rep < last AND rep > lead.rep").drop("last"), "shared")
    first = held.where(_close(F.col("n"), F.col("i"), F.col("lead.n"), F.col("lead.i")))
    pairs = apart(first.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct(), found)
    links = links.unionByName(verified(docs, nodes, pairs))
    found = components.components(links)

    # what shares a shingle, is in different groups so far and was not compared yet
    rest = held.drop("lead")
    rest = rest.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    mixed = rest.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h")
    rest = common.materialise(rest.join(mixed, "h"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    meet = (F.col("x.h") == F.col("y.h")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, meet & _close(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = verified(docs, nodes, pairs)
    if not more.isEmpty():
        found = components.components(links.unionByName(more))
    # rows of one doc_id with different texts tie the groups of their sets
    named = sets.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    each = sets.join(named, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("last"))
    ties = each.where("component_id < last").select(F.col("component_id").alias("a"), F.col("last").alias("b"))
    if ties.isEmpty():
        return each.select("doc_id", "component_id")
    tied = components.components(common.materialise(sets.join(named, "digest").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct(), "ties"))
    return each.join(tied, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns."""
    later = groups(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
