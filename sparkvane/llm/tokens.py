"""Token counts by rank-synchronous array merging.

A byte-pair vocabulary with word ends is applied to many pre-tokens at once: their symbols
lie in one ragged numpy array (a flat array of ids plus the sequence of each id). Each
round looks up the rank of every adjacent pair, takes the lowest rank of each sequence, and
merges all occurrences of that pair in that sequence, left to right without overlap; all
sequences advance in the same array operations. Sequences without a mergeable pair leave
the array. What survives are the tokens of each pre-token.

Texts split at white space into chunks (the vocabulary's pattern never crosses it), and
each distinct chunk of a worker is merged once; a table of bounded size holds the results.

Equivalence with the library: normalisation is NFC, then lower case by code point (no
final-sigma rule). A text with characters outside Latin, punctuation and symbols is split
by the library's own normaliser and pre-tokenizer, as Unicode tables may differ by version.
Special strings inside texts become their special ids, as the library does by default.

Defined results: null and empty texts have no tokens; white space alone has none; very long
chunks are merged like others; extra columns are ignored by the report.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct chunks that a worker keeps; the table is emptied when it is full.
CACHE_CHUNKS = 400_000
#: Distinct chunks kept between tasks of one worker.
KEPT_CHUNKS = 20_000
#: Characters of those chunks.
CACHE_CHARS = 16 << 20
#: Symbols merged in one array pass.
PASS_SYMBOLS = 1 << 17

_SLOT_BITS = 19
_NONE, _GONE = np.int32(0x7FFFFFFF), np.int32(-1)

#: Up to U+024F and general punctuation to U+2BFF: there, Unicode versions agree.
_OTHER = re.compile("[^\x09-\x0d\x20-\x84\x86-ɏ‐-‧‰-⁞₠-⃀←-⯿]")


_ASCII_SPACE = re.compile("[\x09-\x0d\x20]+")


class Vocabulary:
    """A tokenizers file with a BPE model with word ends, as numpy tables."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        import regex

        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.pattern_or_break = regex.compile(pattern + r"|\n")
        self.path = path
        self._library = None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._table(keys, made)
        shown = _byte_characters()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        self.character = {c: b for b, c in shown.items()}

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: a pair's slot holds its key, rank and result; probes go on by one."""
        slots = 1 << _SLOT_BITS
        self.key = np.full(slots, -1, np.int64)
        self.rank = np.full(slots, _NONE, np.int32)
        self.made = np.zeros(slots, np.int32)
        self.probes = 1
        left = np.arange(len(keys))
        slot = _slot(keys)
        while len(left):
            free = self.key[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            self.key[slot[won]], self.rank[slot[won]], self.made[slot[won]] = keys[left[won]], left[won], made[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (slots - 1)
            self.probes += bool(len(left))

    def look_up(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of each pair; rank _NONE where there is no merge."""
        slot = _slot(pair)
        key = self.key[slot]
        for _ in range(self.probes - 1):
            on = (key != pair) & (key != -1)
            if not on.any():
                break
            slot = np.where(on, (slot + 1) & (len(self.key) - 1), slot)
            key = self.key[slot]
        return np.where(key == pair, self.rank[slot], _NONE), self.made[slot]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the tokens of piece i are ids[ends[i]:ends[i + 1]]. Pieces are not empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last[raw[ends - 1]]
        seq = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        rank, made = np.full(len(ids), _NONE, np.int32), np.zeros(len(ids), np.int32)
        stale = np.flatnonzero(seq[:-1] == seq[1:])  # pairs (i, i + 1) to be looked up
        done_ids, done_seq = [], []
        while len(ids):
            rank[stale], made[stale] = self.look_up((ids[stale].astype(np.int64) << 20) | ids[stale + 1])
            border = np.append(True, seq[1:] != seq[:-1])
            first = np.flatnonzero(border)
            lowest = np.minimum.reduceat(rank, first)
            low = lowest[np.cumsum(border) - 1]
            live = low != _NONE
            if not live.all():  # sequences without a pair are finished
                done_ids.append(ids[~live])
                done_seq.append(seq[~live])
                ids, seq, rank, made, low = ids[live], seq[live], rank[live], made[live], low[live]
                if not len(ids):
                    break
            take = rank == low
            both = take & np.append(False, take[:-1])
            if both.any():  # in a run of hits (a symbol paired with itself) every second one counts
                where = np.arange(len(take))
                run = np.maximum.accumulate(np.where(take & ~both, where, -1))
                take &= ((where - run) & 1) == 0
            hit = np.flatnonzero(take)
            ids[hit] = made[hit]
            rank[hit + 1] = _GONE
            keep = rank != _GONE
            rank[hit] = _NONE
            touched = np.zeros(len(ids), bool)
            touched[hit] = True
            ids, seq, rank, made, touched = ids[keep], seq[keep], rank[keep], made[keep], touched[keep]
            touched[:-1] |= touched[1:]  # the pair before a merged symbol, and the pair after
            stale = np.flatnonzero(touched)
            inside = stale < len(ids) - 1
            inside[inside] = seq[stale[inside]] == seq[stale[inside] + 1]
            rank[stale[~inside]] = _NONE
            stale = stale[inside]
        all_ids, all_seq = np.concatenate(done_ids), np.concatenate(done_seq)
        order = np.argsort(all_seq, kind="stable")
        return all_ids[order], np.append(0, np.cumsum(np.bincount(all_seq, minlength=len(pieces))))

    def split(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special strings."""
        if _OTHER.search(text) is None:
            return [w.encode() for w in self.pattern.findall(unicodedata.normalize("NFC", text).lower())]
        lib = self.library()
        shown = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(self.character[c] for c in w) for w, _ in shown]


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies show each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in printable}
    shown.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)})
    return shown


class Encoder:
    """Chunks to token ids, with each distinct chunk and pre-token merged once while the tables last."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.held = 0
        special = list(self.v.special)
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.pre_number: defaultdict[str | bytes, int] = defaultdict(itertools.count().__next__)
        self.chunk = _Ragged(np.array([self.v.special[s] for s in special], np.int32), np.arange(len(special) + 1))
        self.pre = _Ragged(np.empty(0, np.int32), np.zeros(1, np.int64))
        for s in special:  # special strings are chunks of their own
            self.number[s]

    def chunks(self, text: str) -> list[str]:
        """A text as chunks that are tokenised on their own."""
        if "<|" in text and self.v.special_split is not None:
            return [c for part in self.v.special_split.split(text) for c in ([part] if part in self.v.special else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return text.split() if _OTHER.search(text) is None else [c for c in _ASCII_SPACE.split(text) if c]

    def _learn(self, new: list[str]) -> None:
        """Tokens of new chunks: split all at once, then merge the pre-tokens not met before."""
        self.held += sum(map(len, new))
        plain = [_OTHER.search(c) is None for c in new]
        counts = np.zeros(len(new), np.int64)
        parts: list[np.ndarray] = []
        look = self.pre_number.__getitem__
        latin = [c for c, ok in zip(new, plain, strict=True) if ok]
        found = self.v.pattern_or_break.findall(unicodedata.normalize("NFC", "\n".join(latin)).lower()) if latin else []
        which = np.fromiter(map(look, found), np.int64, len(found))
        cut = which == self.pre_number["\n"]
        if latin:
            counts[np.flatnonzero(plain)] = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(which)]])) - 1
        parts.append(which[~cut])
        at_latin = np.repeat(np.flatnonzero(plain), counts[plain]) if latin else np.empty(0, np.int64)
        owner = [at_latin]
        for i, (c, ok) in enumerate(zip(new, plain, strict=True)):
            if not ok:
                p = self.v.split(c)
                parts.append(np.fromiter(map(look, p), np.int64, len(p)))
                owner.append(np.full(len(p), i))
        fresh = list(itertools.islice(reversed(self.pre_number), len(self.pre_number) - len(self.pre)))[::-1]
        at = 0
        while at < len(fresh):
            pieces, size = [], 0
            while at < len(fresh) and (size < PASS_SYMBOLS or not pieces):
                p = fresh[at]
                pieces.append(p.encode() if isinstance(p, str) else p)
                size += len(pieces[-1])
                at += 1
            self.pre.extend(*self.v.merge(pieces))
        which, owner = np.concatenate(parts), np.concatenate(owner)
        if len(parts) > 1:
            order = np.argsort(owner, kind="stable")
            which, owner = which[order], owner[order]
        ids, ends = self.pre.gather(which)
        per_chunk = np.bincount(owner, weights=np.diff(ends), minlength=len(new)).astype(np.int64)
        self.chunk.extend(ids, np.append(0, np.cumsum(per_chunk)))

    def rest(self) -> None:
        """Between tasks only small tables are kept."""
        if len(self.number) > KEPT_CHUNKS:
            self._reset()

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all chunks, chunks of each text); every chunk is in the table then."""
        if len(self.number) > CACHE_CHUNKS or self.held > CACHE_CHARS:
            self._reset()
        parts = [self.chunks(t) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        which = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        n_new = len(self.number) - len(self.chunk)
        if n_new:
            self._learn(list(itertools.islice(reversed(self.number), n_new))[::-1])
        return which, sizes

    def count(self, texts: list[str]) -> list[int]:
        which, sizes = self._look_up(texts)
        upto = np.append(0, np.cumsum(self.chunk.sizes()[which]))
        ends = np.cumsum(sizes)
        return (upto[ends] - upto[ends - sizes]).tolist()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        which, sizes = self._look_up(texts)
        ids, upto = self.chunk.gather(which)
        ends = np.cumsum(sizes)
        return [ids[a:b] for a, b in zip(upto[ends - sizes].tolist(), upto[ends].tolist(), strict=True)]


class _Ragged:
    """Rows of ids, appended in runs and gathered by number."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids, self.ends = ids, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def extend(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(self.ends)[which]
        ends = np.append(0, np.cumsum(n))
        place = np.arange(ends[-1]) + np.repeat(self.ends[which] - ends[:-1], n)
        return self.ids[place], ends


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, for one task after the other."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(Vocabulary(vocabulary_path(vocabulary)))
    return _encoders[vocabulary]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; one narrow pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                n = encoder(vocabulary).count(common.texts_of(part))
                size = [len(b) for b in common.bytes_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)
        encoder(vocabulary).rest()

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    return token_counts(common.read(spark, sf_dir, "documents", "doc_id", "text"))
