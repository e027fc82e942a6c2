"""Line dedup by winnowing over line hashes.

Lines are the parts of a text between line feeds, compared with white space at both ends
stripped; blank lines are passed over. A run of at least ``RUN`` consecutive lines that also
starts earlier (in a document of smaller doc_id, or higher up in the same document) is
deleted; its first occurrence stays. Deleted are exactly the lines in some window of ``RUN``
lines whose line sequence starts earlier, which is what matches extended both ways cover.

Query op10 counts lines alone, as its SQL says. ``deduplicate``, which the pipeline takes, also
counts what a run holds: a run of fewer lines is deleted too, once it holds at least
``LONG_WORDS`` words or, for scripts that set no spaces, ``LONG_BYTES`` bytes. Each window of
fewer lines that holds as much is a fingerprint of its own, so none of them is missed.

Winnowing: of every ``RUN`` consecutive lines the one with the least hash is selected, the
rightmost of equals. Equal windows select equal lines, so a repeated run of ``RUN`` lines is
guaranteed a common fingerprint, and most lines are never shuffled. Positions are joined on
the fingerprint: only fingerprints with two or more positions go on. From there a match is
extended both ways within its window by the digest of the whole window (128 bits), grouped
to the earliest position, and neighbouring windows of a match join to the maximal run.

Scale: fingerprints are grouped with map-side combining, so a line that a third of all
documents share costs one row a task; hashes of more than a thousandth of all positions, of
which there are a thousand at most, are joined by broadcast, the others by a shuffle. Texts
move once, to the lines that are deleted from them.

Defined results: null texts stay null and empty ones empty, and have no lines; a text that
loses all of its lines becomes empty; rows with equal doc_id count as the same place, so they
do not delete each other's lines; rows with a null doc_id lose nothing and delete nothing.
Extra columns are kept; ``n_chars``, where there is one, follows the new text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

RUN = 3
#: Words, or bytes, from which on a run of fewer lines counts.
LONG_WORDS = 50
LONG_BYTES = 300

_WINDOWS = "h long, doc_id long, place int, width int, digests array<binary>"


def lines_of(raw: bytes) -> tuple[list[bytes], list[int]]:
    """Stripped lines that are not blank, and the number of each among all lines."""
    lines, numbers = [], []
    for i, line in enumerate(raw.split(b"\n")):
        line = line.strip()
        if line:
            lines.append(line)
            numbers.append(i)
    return lines, numbers


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``run`` hashes, the place of its least one (the rightmost of equals)."""
    view = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return np.arange(len(view)) + run - 1 - view[:, ::-1].argmin(axis=1)


def long_windows(lines: list[bytes], run: int) -> Iterator[tuple[int, int]]:
    """(place, width) of the windows of fewer than ``run`` lines that hold enough to count."""
    words = [len(x.split()) for x in lines]
    for i in range(len(lines)):
        for j in range(i + 1, min(i + run, len(lines) + 1)):
            if sum(words[i:j]) >= LONG_WORDS or sum(map(len, lines[i:j])) >= LONG_BYTES:
                yield i, j - i


def fingerprints(docs: DataFrame, run: int, by_content: bool) -> DataFrame:
    """(h, doc_id, place, width, digests): a selected line, and the windows of ``width`` lines that
    selected it from ``place`` on; a window that counts by its content stands for itself."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("width", pa.int32()), ("digests", pa.list_(pa.binary()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            for part in common.text_blocks(batch):
                out: list[tuple] = []
                for doc_id, raw in zip(part.column(0).to_pylist(), common.bytes_of(part), strict=True):
                    lines, _ = lines_of(raw)
                    if by_content:
                        for i, width in long_windows(lines, run):
                            digest = xxh3_128_digest(b"\n".join(lines[i : i + width]))
                            out.append((int.from_bytes(digest[:8], "big", signed=True), doc_id, i, width, [digest]))
                    if len(lines) < run:
                        continue
                    hashes = np.array([xxh3_64_intdigest(x) for x in lines], np.uint64)
                    at = winnow(hashes, run)
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    digests = [xxh3_128_digest(b"\n".join(lines[i : i + run])) for i in range(len(at))]
                    selected = hashes[at[first]].view(np.int64).tolist()
                    for h, i, j in zip(selected, first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                        out.append((h, doc_id, i, run, digests[i:j]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*out, strict=True)), schema, strict=True)], schema=schema)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(common.tidy(scan), _WINDOWS)


def repeated_windows(docs: DataFrame, run: int = RUN, by_content: bool = True) -> DataFrame:
    """doc_id and the places (array of line indices, blank lines not counted) of repeated windows.

    A place p is a window of ``run`` lines; of a window that counts by its content each line i is
    a place of its own, written as -1 - i.
    """
    found = common.materialise(fingerprints(docs, run, by_content), "lines")
    position = F.struct("doc_id", "place")
    counts = found.agg(F.count("*"), F.sum(F.size("digests"))).first()
    shared = found.groupBy("h").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("place").alias("p0"), F.max("place").alias("p1"), F.count("*").alias("n")).where("d0 < d1 OR p0 < p1").select("h", "n")
    windows = common.join_by_key(found, shared, "h", "n", counts[0]).select("doc_id", "place", "width", F.posexplode("digests").alias("k", "digest")).select("digest", "doc_id", (F.col("place") + F.col("k")).alias("place"), "width")
    windows = common.materialise(windows, "windows")
    earliest = windows.groupBy("digest").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).where("first <> last").select("digest", "first", "n")
    later = common.join_by_key(windows, earliest, "digest", "n", counts[1] or 0).where(position > F.col("first"))
    lines = F.transform(F.sequence(F.col("place"), F.col("place") + F.col("width") - 1), lambda i: -1 - i)
    places = later.select("doc_id", F.explode(F.when(F.col("width") == run, F.array("place")).otherwise(lines)).alias("place"))
    return places.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def deleted_lines(n: int, places: list[int], run: int) -> np.ndarray:
    gone = np.zeros(n, bool)
    for p in places:
        if p < 0:
            gone[-1 - p] = True
        else:
            gone[p : p + run] = True
    return gone


def strip_lines(raw: bytes, places: list[int], run: int) -> tuple[bytes, int]:
    """The text without the deleted lines, and their number."""
    _, numbers = lines_of(raw)
    gone = deleted_lines(len(numbers), places, run)
    drop = {numbers[i] for i in np.flatnonzero(gone)}
    return b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in drop), len(drop)


def report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed and the SHA-256 of the text that stays."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                out = []
                for doc_id, raw, places in zip(part.column(0).to_pylist(), common.bytes_of(part), part.column(2).to_pylist(), strict=True):
                    kept, n = strip_lines(raw, places, run) if places else (raw, 0)
                    out.append((doc_id, len(lines_of(raw)[0]), n, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*out, strict=True)), schema, strict=True)], schema=schema)

    docs = docs.select("doc_id", "text")
    joined = docs.join(repeated_windows(docs, run, by_content=False), "doc_id", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(common.tidy(apply), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents with all columns, without later repeated runs, be they of many lines or of much content."""
    columns = docs.columns
    mark = common.unused(columns, "places")
    joined = docs.join(repeated_windows(docs.select("doc_id", "text"), run).withColumnRenamed("places", mark), "doc_id", "left").select(*columns, mark)
    text, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                places = part.column(len(columns)).to_pylist()
                cols = [part.column(i) for i in range(len(columns))]
                old = cols[text].to_pylist()
                new = [strip_lines(t.encode(), p, run)[0].decode() if p else t for t, p in zip(old, places, strict=True)]
                cols[text] = pa.array(new, cols[text].type)
                if chars is not None:
                    cols[chars] = pa.array([len(n) if p else c for n, p, c in zip(new, places, cols[chars].to_pylist(), strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return joined.mapInArrow(common.tidy(apply), docs.schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines deleted from every document."""
    return report(common.read(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS number FROM split),
stripped AS (SELECT doc_id, number, line, regexp_replace(regexp_replace(line, '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]+$', '') AS s FROM raw),
kept AS (SELECT doc_id, number, s, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS place FROM stripped WHERE s <> ''),
win AS (
  SELECT doc_id, place, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS seq
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
ranked AS (SELECT doc_id, place, row_number() OVER (PARTITION BY seq ORDER BY doc_id, place) AS r FROM win WHERE seq IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, place + d AS place FROM ranked, (VALUES (0), (1), (2)) AS t(d) WHERE r > 1),
gone_lines AS (SELECT k.doc_id, k.number FROM kept k JOIN gone g USING (doc_id, place)),
left_over AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.number) AS text
  FROM raw r LEFT JOIN gone_lines g USING (doc_id, number) WHERE g.number IS NULL GROUP BY r.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone_lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(x.n, 0) AS n_removed, sha256(coalesce(l.text, '')) AS kept_sha256
FROM split d LEFT JOIN counts c USING (doc_id) LEFT JOIN removed x USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""
