"""Substring dedup by suffix automata of reference shards.

Words are maximal runs of characters other than ASCII white space. A document loses every
word that lies in a window of ``WINDOW`` words whose word sequence also starts in a reference
text; for dedup within a corpus the reference of a document is every document of smaller
doc_id. Windows are judged on the input.

``matches`` streams a text through a suffix automaton of reference words and gives matching
statistics: at each word the length of the longest suffix that occurs in the reference. Words
of matches of at least the window's length form the maximal spans that are removed.

``remove_reference`` takes a reference of checked size, cuts it into shards, broadcasts the
shards, and streams all documents through the automaton of each.

Within a corpus the reference is the corpus itself, so its automata together have no size
bound and are not broadcast. Each shard's automaton is built in the task to which the texts
that may match it are routed:

1. Winnowing: in every window the word ``GRAM``-gram with the least hash is its anchor. Equal
   windows have equal anchors, so only windows with anchors of two or more documents can match.
2. The shard of an anchor is the first document that holds it. A document sends each shard
   the words of the windows that share an anchor with it; a shard's documents are taken in
   ascending order: matched first, then the windows that are new are added to the automaton.
3. Anchors with more than ``HOT`` occurrences would make shards of any size. Their windows
   are matched one by one: a 128-bit hash of each window is grouped with map-side combining,
   and all but the first document's are removed. So a shard holds at most ``HOT`` rows for
   each anchor of one document, however large a group of copies is. A document sends one row
   for each different window, with all its places, however often it repeats a phrase.

Scale: anchors are one in about twenty words. Texts move twice, by doc_id: to the positions
of shared anchors, and to the spans to be removed. Anchors and windows of more than a
thousandth of all rows, of which there are a thousand at most, are joined by broadcast, so
that no passage sends its documents to one task.

Defined results: null and empty texts have no words; texts shorter than the window lose
nothing; rows with equal doc_id count as one document and do not remove each other's words;
rows with a null doc_id lose nothing and remove nothing; extra columns are kept by
``deduplicate`` and ignored by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

WINDOW = 50
GRAM = 12
#: Occurrences up to which an anchor's windows go to its shard.
HOT = 64
#: Words of a broadcast reference shard, and text bytes of a broadcast reference.
SHARD_WORDS = 100_000
REFERENCE_BYTES = 64 << 20


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    __slots__ = ("next", "link", "length")

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # the sequence so far is known: follow it, or split its state
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
                continue
            cur = len(length)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """At each word, the length of the longest suffix that occurs in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for w in words:
            t = nxt[v].get(w)
            if t is not None:
                n += 1
                v = t
            else:
                while v and t is None:
                    v = link[v]
                    t = nxt[v].get(w)
                if t is None:
                    n = 0
                else:
                    n = length[v] + 1
                    v = t
            yield n


def matches(automaton: SuffixAutomaton, words: list[bytes], window: int) -> list[tuple[int, int]]:
    """Maximal spans (first word, past the last) of matches of at least ``window`` words."""
    return _matched(np.fromiter(automaton.statistics(words), np.int64, len(words)), window)[0]


def _matched(statistics: np.ndarray, window: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(spans of matched words, word runs that together hold all windows without a match)."""
    hit = statistics[window - 1 :] >= window  # by the window's first word
    return [(a, b - 1 + window) for a, b in _runs(hit)], [(a, b - 1 + window) for a, b in _runs(~hit)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


# --- winnowing ------------------------------------------------------------------------


class _WordHashes(dict):
    """64-bit hash of each word, kept while the table is not full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor; the windows are those it is least in."""
    m = len(words)
    if m < window:
        return (np.empty(0, np.int64),) * 4
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, m)
    g = h[: m - gram + 1].copy()
    for j in range(1, gram):
        g *= _ODD
        g += h[j : m - gram + 1 + j]
    g = _mixed(g)
    width = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(m - window + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    pos = at[first]
    return g[pos].view(np.int64), pos, first, last


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, doc_id, first, last): anchor hash, and the windows of which it is the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                found = [anchors_of(raw.split(), window, gram) for raw in common.bytes_of(part)]
                n = [len(f[0]) for f in found]
                if sum(n):
                    ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), n)
                    hashes, _, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int16))], names=["a", "doc_id", "first", "more"])
        _hashes.clear()

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(common.tidy(run), "a long, doc_id long, first int, more short")


# --- within a corpus ------------------------------------------------------------------


def _route(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Windows and words that may match: hashes of single windows, or segments for a shard.

    shared: doc_id, at array<struct<first, more, ref>>; ref is null for hot anchors. A hash comes
    once a document, with the places of all its windows in ``starts``.
    """
    schema = pa.schema([("ref", pa.int64()), ("hash", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in common.text_blocks(batch):
                out: list[tuple] = []
                for doc_id, raw, at in zip(part.column(0).to_pylist(), common.bytes_of(part), part.column(2).to_pylist(), strict=True):
                    words = raw.split()
                    shards: dict[int, list[list[int]]] = {}
                    single: dict[bytes, list[int]] = {}
                    for x in sorted(at, key=lambda x: x["first"]):
                        first, last, ref = x["first"], x["first"] + x["more"], x["ref"]
                        if ref is None:
                            for i in range(first, last + 1):
                                single.setdefault(xxh3_128_digest(b" ".join(words[i : i + window])), []).append(i)
                            continue
                        held = shards.setdefault(ref, [])
                        if held and first <= held[-1][1]:
                            held[-1][1] = max(held[-1][1], last + window)
                        else:
                            held.append([first, last + window])
                    out += [(None, digest, doc_id, None, None, starts) for digest, starts in single.items()]
                    out += [(ref, None, doc_id, a, b" ".join(words[a:b]), None) for ref, held in shards.items() for a, b in held]
                    if len(out) > 50_000:
                        yield _batch(out, schema)
                        out = []
                if out:
                    yield _batch(out, schema)

    joined = docs.select("doc_id", "text").join(shared, "doc_id").select("doc_id", "text", "at")
    return joined.mapInArrow(common.tidy(run), "ref long, hash binary, doc_id long, start int, words binary, starts array<int>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)


def _shard_spans(segments: DataFrame, window: int) -> DataFrame:
    """Spans (doc_id, start, stop) that match earlier documents of the same shard."""

    def match(automaton: SuffixAutomaton, held: list[tuple[int, list[bytes]]]) -> list[tuple[int, int]]:
        found = [(start, words, *_matched(np.fromiter(automaton.statistics(words), np.int64, len(words)), window)) for start, words in held]
        for _, words, _, fresh in found:
            for a, b in fresh:
                automaton.add(words[a:b])
        return [(start + a, start + b) for start, _, spans, _ in found for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = doc = None
        automaton, held, out = SuffixAutomaton(), [], []

        def close() -> None:
            if held:
                out.extend((doc, a, b) for a, b in match(automaton, held))
                held.clear()

        for batch in batches:
            for r, d, start, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if r != ref or d != doc:
                    close()
                    if r != ref:
                        automaton = SuffixAutomaton()
                    ref, doc = r, d
                held.append((start, words.split(b" ")))
            if out:
                yield _spans(out)
                out.clear()
        close()
        if out:
            yield _spans(out)

    dealt = segments.repartition("ref").sortWithinPartitions("ref", "doc_id", "start").select("ref", "doc_id", "start", "words")
    return dealt.mapInArrow(common.tidy(run), "doc_id long, start int, stop int")


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    d, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "start", "stop"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id and its spans (array of start, stop in words) that earlier documents hold."""
    found = common.materialise(anchors(docs, window, gram), "anchors")
    per_anchor = found.groupBy("a").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("ref < last_doc")
    kept = common.join_by_key(found, per_anchor.select("a", F.when(F.col("n") <= hot, F.col("ref")).alias("ref"), "n"), "a", "n", found.count())
    shared = kept.groupBy("doc_id").agg(F.collect_list(F.struct("first", "more", "ref")).alias("at"))
    routed = common.materialise(_route(docs, shared, window), "routed")
    single = routed.where("hash IS NOT NULL").select("hash", "doc_id", "starts")
    first = single.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc").drop("last_doc")
    later = common.join_by_key(single, first, "hash", "n", single.count()).where("doc_id > first_doc")
    hot_spans = later.select("doc_id", F.transform("starts", lambda i: F.struct(i.alias("start"), (i + window).alias("stop"))).alias("spans"))
    shard_spans = _shard_spans(routed.where("ref IS NOT NULL"), window).select("doc_id", F.array(F.struct("start", "stop")).alias("spans"))
    return shard_spans.unionByName(hot_spans).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["start"] : s["stop"]] = False
    return [words[i] for i in np.flatnonzero(keep)]


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                out = []
                for doc_id, raw, spans in zip(part.column(0).to_pylist(), common.bytes_of(part), part.column(2).to_pylist(), strict=True):
                    words = raw.split()
                    kept = kept_words(words, spans) if spans else words
                    out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield _batch(out, schema)

    docs = docs.select("doc_id", "text")
    return docs.join(repeated_spans(docs, window), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(common.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all columns; texts that lose words are their kept words, joined by one space."""
    columns = docs.columns
    mark = common.unused(columns, "removed")
    spans = repeated_spans(docs.select("doc_id", "text"), window).withColumnRenamed("spans", mark)
    joined = docs.join(spans, "doc_id", "left").select(*columns, mark)
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                removed = part.column(len(columns)).to_pylist()
                texts = [b" ".join(kept_words(raw.split(), s)).decode() if s else None for raw, s in zip(common.bytes_of(part), removed, strict=True)]
                old = part.column(place).to_pylist()
                cols = [part.column(i) for i in range(len(columns))]
                cols[place] = pa.array([o if not s else t for o, t, s in zip(old, texts, removed, strict=True)], cols[place].type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return joined.mapInArrow(common.tidy(run), docs.schema)


# --- against a reference ----------------------------------------------------------------


def reference_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and spans that occur in ``reference`` (a text column), by broadcast shards.

    The reference's size is checked: beyond ``REFERENCE_BYTES`` a corpus dedup over the union
    (with smaller ids for the reference) is the way, and an error says so.
    """
    if common.count_bytes(reference, "text") > REFERENCE_BYTES:
        raise ValueError("the reference is too large to broadcast; deduplicate the union instead")
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for row in reference.where("text IS NOT NULL").select("text").toLocalIterator():
        words = row["text"].encode().split()
        if len(words) >= window:
            # long texts are cut so that every window lies in one shard
            for at in range(0, len(words) - window + 1, SHARD_WORDS):
                piece = words[at : at + SHARD_WORDS + window - 1]
                if size + len(piece) > SHARD_WORDS and shards[-1]:
                    shards.append([])
                    size = 0
                shards[-1].append(piece)
                size += len(piece)
    sent = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            texts = [raw.split() for raw in common.bytes_of(batch)]
            for shard in sent:  # one automaton in memory at a time
                automaton = SuffixAutomaton()
                for words in shard.value:
                    automaton.add(words)
                for held, words in zip(found, texts, strict=True):
                    held += [{"start": a, "stop": b} for a, b in matches(automaton, words, window)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, span)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, spans array<struct<start:int,stop:int>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed words of every document against all documents of smaller doc_id."""
    return report(common.read(spark, sf_dir, "documents", "doc_id", "text"))


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50),
seqs AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS m FROM seqs GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT q.doc_id, unnest(range(q.i, q.i + 50)) AS j FROM seqs q JOIN firsts f USING (s) WHERE q.doc_id > f.m)),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM docs),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.j) AS t FROM words w LEFT JOIN gone g USING (doc_id, j) WHERE g.j IS NULL GROUP BY w.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
