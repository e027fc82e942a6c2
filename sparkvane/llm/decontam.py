"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Words are maximal runs of ASCII letters and digits and of any non-ASCII characters, with
A-Z lower-cased. The pattern of a benchmark item is every window of ``window`` consecutive
words (an item of fewer words, but not none, is one window). The automaton holds the
windows with a space on either side, so a match always starts and ends at word borders, and each
text is scanned once.
Matches carry word positions, and ``char_spans`` maps them to offsets of the original text.

Scale: documents are only mapped, never shuffled, and each row gives one row. An automaton
holds at most ``AUTOMATON_BYTES`` of benchmark text. That is one automaton for a benchmark of
the usual size, built once in each Python worker. A larger benchmark is several automata that a worker
builds one after the other for every ``HELD_BYTES`` of documents, so the result is the same
and memory stays that of one automaton. Items are read and broadcast in
groups of at most ``GROUP_BYTES``; each further group is a further narrow pass over the same rows,
which adds its matches to those of the row.

Defined results: a null or empty text has no words (0 words, not contaminated); a null or
empty benchmark text gives no pattern; repeated items are reported under each item_id;
a null item_id is skipped; with an empty benchmark nothing is contaminated; rows with equal or
null doc_id are reported each. Extra columns are ignored by the report and kept by the filters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

WINDOW = 10
#: Benchmark text of one automaton, of one broadcast, and document text that is held while automata change.
AUTOMATON_BYTES = 256 << 10
GROUP_BYTES = 64 << 20
HELD_BYTES = 32 << 20

_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)

Item = tuple[str, bytes]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _packed(items: Iterator[Item], limit: int) -> Iterator[list[Item]]:
    """Items in lists of at most ``limit`` text bytes (or one item)."""
    held: list[Item] = []
    size = 0
    for item in items:
        if held and size + len(item[1]) > limit:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    if held:
        yield held


def _groups(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark as broadcasts: each a name and a list of blocks of (item_id, text), one block an automaton."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = ((r["item_id"], r["text"].encode()) for r in rows.toLocalIterator())
    for group in _packed(items, GROUP_BYTES):
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(_packed(iter(group), AUTOMATON_BYTES))))


class Matcher:
    """The automaton of one block of items, over normalised text: a space on either side of each word."""

    def __init__(self, items: list[Item], window: int) -> None:
        import ahocorasick

        patterns: dict[bytes, set[str]] = {}
        for item_id, raw in items:
            words = words_of(raw)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                patterns.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item_id)
        self.automaton = None
        if patterns:
            self.automaton = ahocorasick.Automaton()
            for p, ids in patterns.items():  # one character a byte: offsets stay byte offsets
                self.automaton.add_word(p.decode("latin-1"), (p.count(b" ") - 1, frozenset(ids)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first word, past the last) spans of all matches, and the items that match."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.automaton is None or not words:
            return spans, items
        starts = None
        for end, (n, ids) in self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            if starts is None:
                starts = np.cumsum([1] + [len(w) + 1 for w in words])
            last = int(np.searchsorted(starts, end, side="right"))  # words that start at or before the end
            items |= ids
            spans.append((last - n, last))
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_kept: dict[tuple[str, int], Matcher] = {}


def _matcher(group: Broadcast, i: int, window: int) -> Matcher:
    """The automaton of a block; a worker keeps it for its next tasks where there is but one."""
    name, blocks = group.value
    if len(blocks) > 1:
        return Matcher(blocks[i], window)
    if (name, window) not in _kept:
        _kept.clear()
        _kept[name, window] = Matcher(blocks[i], window)
    return _kept[name, window]


def _found(parts: list[pa.RecordBatch], group: Broadcast, window: int) -> list[list[tuple[int, list[tuple[int, int]], set[str]]]]:
    """(words, spans, items) of each row of each part: all automata, one at a time."""
    out = [[(0, [], set()) for _ in range(p.num_rows)] for p in parts]
    for i in range(len(group.value[1])):
        matcher = _matcher(group, i, window)
        for part, rows in zip(parts, out, strict=True):
            for k, raw in enumerate(common.bytes_of(part)):
                words = words_of(raw)
                spans, ids = matcher.scan(words)
                old = rows[k]
                rows[k] = (len(words), merge_spans(old[1] + spans) if old[1] else spans, old[2] | ids if old[2] else ids)
    return out


def _held(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[list[pa.RecordBatch]]:
    """Small slices of the batches: one by one, or together up to ``HELD_BYTES`` where automata change."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in common.text_blocks(batch):
            if not several:
                yield [part]
                continue
            held.append(part)
            size += part.nbytes
            if size >= HELD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


_SPANS = "spans array<struct<start:int,stop:int>>, items array<string>"
_SPAN_TYPE, _ITEM_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())


def _scanner(group: Broadcast, window: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (doc_id, text, n_words, spans, items); the last one leaves the text out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _held(batches, len(group.value[1]) > 1):
            for part, rows in zip(parts, _found(parts, group, window), strict=True):
                spans, items = [], []
                for (_, new, ids), old, known in zip(rows, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    spans.append([{"start": a, "stop": b} for a, b in (merge_spans(new + [(s["start"], s["stop"]) for s in old]) if old else new)])
                    items.append(sorted(ids.union(known)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *([] if last else [part.column(1)]), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, _ITEM_TYPE)],
                    names=["doc_id", *([] if last else ["text"]), "n_words", "spans", "items"],
                )

    return common.tidy(scan)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, merged hit spans (in words), and the items that occur."""
    groups = list(_groups(benchmark)) or [docs.sparkSession.sparkContext.broadcast(("", [[]]))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.expr("CAST(array() AS array<struct<start:int,stop:int>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"))
    for i, group in enumerate(groups):
        last = i == len(groups) - 1
        rows = rows.mapInArrow(_scanner(group, window, last), f"doc_id long, {'' if last else 'text string, '}n_words long, {_SPANS}")
    return rows


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Contamination figures per document (see the module for nulls and ties)."""
    found = scan(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns.

    The scan is a pass over whole rows, so nothing is joined back; each group of items filters in turn.
    """
    kept = docs
    for group in _groups(benchmark):

        def keep(batches: Iterator[pa.RecordBatch], group: Broadcast = group) -> Iterator[pa.RecordBatch]:
            for parts in _held(batches, len(group.value[1]) > 1):
                for part, rows in zip(parts, _found(parts, group, window), strict=True):
                    yield part.filter(pa.array([not spans for _, spans, _ in rows], pa.bool_()))

        kept = kept.mapInArrow(common.tidy(keep), kept.schema)
    return kept


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of a text as character offsets in the original text."""
    raw = text.encode()
    clean_raw = raw.translate(_TABLE)
    starts, ends, at = [], [], 0
    for w in clean_raw.split():
        at = clean_raw.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    chars = lambda byte: len(raw[:byte].decode())
    return [(chars(starts[a]), chars(ends[b - 1])) for a, b in spans]


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination report of every document against every benchmark item."""
    return report(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


OP9_SQL = r"""
WITH raw_items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pats AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM raw_items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents),
sizes AS (SELECT DISTINCT len(p) AS n FROM pats),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM pos JOIN pats ON pats.p = pos.w[i:i + n - 1]),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(len(t.ids), 0) AS n_items,
       sha256(coalesce(array_to_string(t.ids, ','), '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
