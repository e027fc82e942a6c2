"""Content-addressed WARC archive.

An archive is two tables in one folder: ``payloads`` holds each distinct payload once under
its strong digest (SHA-256), and ``records`` holds the exact bytes of every record's header
block with that digest beside it. A record is rebuilt by a join: header bytes, payload
bytes, and the closing line breaks. Payloads are verified as they are read back: their
bytes must give the digest that they are stored under, and the SHA-1 and length that the
headers state; anything else raises an error.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest
page_id is a ``response`` and holds the payload; the others are ``revisit`` records that refer
to it. Records with shorter payloads are all responses.

Scale: digests are computed in one narrow pass; what is grouped and joined are digests.
Payload bytes move once, to the row that stores them. A payload shared by many records
is stored and verified once, so no task gathers its copies.

Defined results: a null html is the empty payload; rows with a null page_id are archived, and
are revisits of a row with an id if one has their payload, responses otherwise; a null url leaves out the target header;
rows that repeat a page_id with the same payload are written again and refer like others
(a row with the responding page_id itself is a response); line breaks in a url are written
percent-encoded, so that a header keeps its lines. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, sha256 (binary), sha1 (base32) and size of each payload; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch, "html"):
                payloads = common.bytes_of(part, "html")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(1),
                        pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
                        pa.array([sha1_base32(p) for p in payloads], pa.string()),
                        pa.array([len(p) for p in payloads], pa.int64()),
                    ],
                    names=["page_id", "url", "sha256", "sha1", "size"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(common.tidy(run), "page_id long, url string, sha256 binary, sha1 string, size long")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(page_id: int, url: str | None, sha1: str, size: int, kind: str, refers_to: int | None) -> bytes:
    """The header block of a record, with its closing empty line."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    """The fields of a header block; the first line under the name of the format."""
    lines = block.decode().split("\r\n")
    fields = {"version": lines[0]}
    for line in lines[1:]:
        if line:
            name, _, value = line.partition(": ")
            fields[name] = value
    return fields


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the two tables of the archive under ``path``."""
    spark = pages.sparkSession
    found = common.materialise(digests(pages), "digests")
    holders = found.where(F.col("size") >= min_bytes).groupBy("sha256").agg(F.max("page_id").alias("holder"))
    # where payloads are below the limit, each record responds; the payload is still stored once
    stored = found.groupBy("sha256").agg(F.max("page_id").alias("page_id"))
    routed = found.join(holders, "sha256", "left").select("page_id", "url", "sha256", "sha1", "size", "holder")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            blocks = []
            for r in rows:
                revisit = r["holder"] is not None and r["holder"] != r["page_id"]
                blocks.append(header(r["page_id"], r["url"], r["sha1"], r["size"], "revisit" if revisit else "response", r["holder"] if revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array([r["sha256"] for r in rows], pa.binary())], names=["header", "sha256"])

    routed.mapInArrow(common.tidy(headers), "header binary, sha256 binary").write.option("compression", "zstd").parquet(f"{path}/records")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    kept = pages.select("page_id", "html").join(stored, "page_id").select("sha256", payload)
    if _repeats_ids(found):
        # rows of one page_id may differ: each digest takes the payload that it is of
        kept = kept.where(F.unhex(F.sha2("payload", 256)) == F.col("sha256")).dropDuplicates(["sha256"])
    without_id = pages.where("page_id IS NULL").select(payload).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    alone = without_id.join(stored.where("page_id IS NOT NULL").select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])
    kept.unionByName(alone).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _repeats_ids(found: DataFrame) -> bool:
    """Whether some page_id occurs in more than one row."""
    return not found.groupBy("page_id").count().where("count > 1").isEmpty()


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, sha1, size and payload of each stored payload, verified against its key."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch, "payload"):
                keys, payloads = part.column(0).to_pylist(), part.column(1).to_pylist()
                for k, p in zip(keys, payloads, strict=True):
                    if hashlib.sha256(p).digest() != k:
                        raise ValueError(f"payload {k.hex()} does not match its digest")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sha1_base32(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64()), part.column(1)], names=["sha256", "sha1", "size", "payload"])

    return spark.read.schema("sha256 binary, payload binary").parquet(f"{path}/payloads").mapInArrow(common.tidy(verify), "sha256 binary, sha1 string, size long, payload binary")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed fields of every record beside its exact header bytes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(n) if urn and (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None
        for batch in batches:
            blocks = batch.column(0).to_pylist()
            fields = [parse_header(b) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number(f["WARC-Record-ID"]) for f in fields], pa.int64()),
                    pa.array([f.get("WARC-Target-URI") for f in fields], pa.string()),
                    pa.array([f["WARC-Type"] for f in fields], pa.string()),
                    pa.array([number(f.get("WARC-Refers-To")) for f in fields], pa.int64()),
                    pa.array([f["WARC-Payload-Digest"].removeprefix("sha1:") for f in fields], pa.string()),
                    pa.array([int(f["X-Payload-Length"]) for f in fields], pa.int64()),
                    batch.column(0),
                    batch.column(1),
                ],
                names=["page_id", "url", "record_type", "refers_to", "stated_sha1", "stated_size", "header", "sha256"],
            )

    schema = "page_id long, url string, record_type string, refers_to long, stated_sha1 string, stated_size long, header binary, sha256 binary"
    return spark.read.schema("header binary, sha256 binary").parquet(f"{path}/records").mapInArrow(common.tidy(parse), schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with the digest and size of its payload as read back; no payload moves."""
    verified = read_payloads(spark, path).select("sha256", "sha1", "size")
    wrong = F.raise_error(F.concat(F.lit("record of page "), F.col("page_id").cast("string"), F.lit(" and its payload differ")))
    same = (F.col("sha1") == F.col("stated_sha1")) & (F.col("size") == F.col("stated_size"))
    joined = read_headers(spark, path).join(verified, "sha256", "left")
    return joined.withColumn("sha1", F.when(same, F.col("sha1")).otherwise(wrong.cast("string")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the exact bytes of each record; a revisit has no block, as it was written."""
    payloads = read_payloads(spark, path).select("sha256", "payload")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_headers(spark, path).join(payloads, "sha256").select("page_id", F.concat("header", block, F.lit(END)).alias("record"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, and report every record."""
    path = common.fresh_path(spark, "warc")
    write_archive(common.read(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archive(spark, path).select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to"
    )


#: Base32 of 20 bytes: each 5 hex digits are 20 bits, four letters.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> CAST(s AS INT)) & 31 AS BIGINT) + 1, 1)
    FOR s IN [15, 10, 5, 0]], '') FOR i IN range(8)], '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM h
"""
