"""Canonical exact fingerprints of documents.

The canonical form of a text is its NFKC normalisation, case-folded, with every run of white
space folded to one space and none at the ends. Its fingerprint is the 128-bit xxhash of
the canonical UTF-8 bytes. Texts are grouped by this digest, and within each bucket of two
or more rows the canonical bytes are compared: if all are equal (their smallest and largest
are the same), the bucket is one group; else the digest of each of its texts is extended by
its SHA-256, so that different texts never share a fingerprint.

An exact digest knows no degrees: the likeness of two fingerprints is 1 if they are equal
and 0 if not.

Scale: digests come from one narrow pass. Only the bytes of buckets with two or more rows
move, reduced in each task before the shuffle. ``edits`` additionally needs each document
beside its successor by doc_id: one range exchange of the texts, and then the documents at
the partitions' borders (two for each partition) are paired by a small join.

Defined results: null texts are empty texts, which share one fingerprint; repeated rows
share theirs; rows with equal doc_id follow each other in the order of their texts; a single
row is its own successor; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.llm import common

#: Digests of buckets with several rows that are broadcast to find their texts; beyond it a join shuffles.
BROADCAST_DIGESTS = 500_000


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(canon: bytes) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(canon)


def canonical_texts(docs: DataFrame, digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """doc_id, digest and canonical bytes; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                canon = [canonical(t) for t in common.texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([digest_of(c) for c in canon]), pa.array(canon, pa.binary())], names=["doc_id", "digest", "canon"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, digest string, canon binary")


def mixed_digests(docs: DataFrame, digests: DataFrame, digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """Digests that stand for more than one canonical text; ``digests``: a digest column of all rows."""
    several = common.materialise(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "buckets")
    if several.count() <= BROADCAST_DIGESTS:
        several = F.broadcast(several)
    bucket = canonical_texts(docs, digest_of).join(several, "digest", "left_semi")
    return bucket.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("digest")


def fingerprints(docs: DataFrame, digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """doc_id and fingerprint of every document."""
    canon = canonical_texts(docs, digest_of)
    mixed = mixed_digests(docs, canon.select("digest"), digest_of).withColumn("mixed", F.lit(True))
    full = canon.select("doc_id", "digest", F.sha2("canon", 256).alias("sha"))
    return full.join(mixed, "digest", "left").select("doc_id", F.when(F.col("mixed"), F.concat_ws(":", "digest", "sha")).otherwise(F.col("digest")).alias("fingerprint"))


PAIR = "doc_id long, n_chars long, edited_sha256 string, digest string, sha string, edited_digest string, edited_canon_sha string, same_edited boolean, same_next boolean"


def _pair(doc_id: int | None, text: str, following: str, canon: bytes, next_canon: bytes) -> tuple:
    n = len(text)
    cut = n // 4
    edited = text[: n - cut] + following[:cut]
    edited_canon = canonical(edited)
    return (
        doc_id,
        n,
        hashlib.sha256(edited.encode()).hexdigest(),
        digest(canon),
        hashlib.sha256(canon).hexdigest(),
        digest(edited_canon),
        hashlib.sha256(edited_canon).hexdigest(),
        canon == edited_canon,
        canon == next_canon,
    )


_PAIR_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "digest", "sha", "edited_digest", "edited_canon_sha")]
    + [("same_edited", pa.bool_()), ("same_next", pa.bool_())]
)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def edits(docs: DataFrame) -> DataFrame:
    """Each document with its edited text's digests (columns of ``PAIR``)."""
    schema = _PAIR_SCHEMA.append(pa.field("border", pa.string())).append(pa.field("text", pa.string()))
    none = (None,) * (len(_PAIR_SCHEMA) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in common.text_blocks(batch):
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), common.texts_of(part), strict=True):
                    canon = canonical(text)
                    if last is None:
                        out.append((doc_id, *none, "first", text))
                    else:
                        out.append((*_pair(last[0], last[1], text, last[2], canon), None, None))
                    last = (doc_id, text, canon)
                if out:
                    yield _columns(out, schema)
        if last is not None:
            yield _columns([(last[0], *none, "last", last[1])], schema)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = common.materialise(ordered.mapInArrow(common.tidy(run), PAIR + ", border string, text string"), "edits")
    return done.where("border IS NULL").drop("border", "text").unionByName(_borders(done.where("border IS NOT NULL").select("doc_id", "border", "text")))


def _borders(borders: DataFrame) -> DataFrame:
    """The last document of each partition with the first one of the next (of the first, after the last)."""
    # two rows for each partition: ranked by id alone, texts join afterwards
    key = F.xxhash64("text")
    ranked = borders.select("doc_id", "border", key.alias("key")).withColumn("kind", F.when(F.col("border") == "first", 0).otherwise(1))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.col("doc_id").asc_nulls_first(), "key"))
    ranked = ranked.withColumn("rank", rank)
    firsts = ranked.where("kind = 0").select(F.col("rank").alias("r"), F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"))
    n = firsts.count()
    lasts = ranked.where("kind = 1").select((F.pmod(F.col("rank"), F.lit(max(n, 1))) + 1).alias("r"), F.col("doc_id").alias("last_id"), F.col("key").alias("last_key"))
    pairs = lasts.join(firsts, "r")
    last_text = borders.where("border = 'last'").select(F.col("doc_id").alias("a_id"), key.alias("a_key"), F.col("text").alias("last_text"))
    first_text = borders.where("border = 'first'").select(F.col("doc_id").alias("b_id"), key.alias("b_key"), F.col("text").alias("next_text"))
    joined = pairs.join(last_text, pairs["last_id"].eqNullSafe(last_text["a_id"]) & (pairs["last_key"] == last_text["a_key"]))
    joined = joined.join(first_text, joined["next_id"].eqNullSafe(first_text["b_id"]) & (joined["next_key"] == first_text["b_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a or "", b or "") for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            if rows:
                yield _columns([_pair(i, a, b, canonical(a), canonical(b)) for i, a, b in rows], _PAIR_SCHEMA)

    return joined.select("last_id", "last_text", "next_text").mapInArrow(common.tidy(run), PAIR)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    found = common.materialise(edits(docs), "fingerprints")
    mixed = common.materialise(mixed_digests(docs, found.select("digest")), "mixed")
    name = lambda d, sha, m: F.when(F.col(m), F.concat_ws(":", d, sha)).otherwise(F.col(d))
    found = found.join(mixed.select("digest", F.lit(True).alias("m1")), "digest", "left").join(mixed.select(F.col("digest").alias("edited_digest"), F.lit(True).alias("m2")), "edited_digest", "left")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        name("digest", "sha", "m1").alias("fingerprint"),
        name("edited_digest", "edited_canon_sha", "m2").alias("edited_fingerprint"),
        F.col("same_edited").cast("double").alias("near_edited"),
        F.col("same_next").cast("double").alias("near_next"),
    )
