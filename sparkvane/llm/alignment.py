"""Cross-tokenizer alignment, each distinct text once.

Two vocabularies cut one text differently. The byte offsets at which tokens of both end cut
it into groups; an A token and a B token of one group are linked. What a pair of ids is worth
is the number of documents of the corpus that hold it linked.

Exact-text deduplication: documents are shuffled by their full text; a distinct text is
tokenised and aligned once and stands for its copies with their number; pair counts are
weighted with it. Measures go back to doc_ids over the SHA-256 of the text.

Within a task the texts of a block lie behind each other as one stream of bytes, and the ends of
all tokens of both vocabularies are running sums in it: common ends, groups, links and the order
of tokens are array operations.

The byte-level vocabulary is applied by a library for ranks, where its merges are in the order of
its ids (this is checked), as that is several times faster than the vocabulary's own library. Texts
with characters on whose class two Unicode versions may differ, or with very long runs without a
break, go to its own library.

Scale: copies are combined map-side before texts move, and texts move once. Pairs that hold
more than one in ``SHARE`` of all rows, of which there are ``SHARE`` at most, are joined by
broadcast, the others by a shuffle; so are texts with many copies. No pair, text or document
is gathered in one task.

Defined results: null and empty texts, and texts whose tokens do not give back a space and the
text, have no tokens: zeros and an empty digest. Each row is a document: repeated and null
doc_ids keep their rows. Special strings in texts are plain text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
#: A pair of more than one in so many rows is joined by broadcast; there can be no more of them than this.
SHARE = 100_000
#: Groups with more links than this are counted by their distinct ids, not link by link.
LARGE_GROUP = 4096

#: Up to U+024F and general punctuation to U+2BFF but for odd white space: there, Unicode versions agree.
_OTHER = re.compile("[^\x09-\x0d\x20-\x84\x86-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20c0\u2190-\u2bff]|\\S{400}|\\s{400}")
# fixed value: the pre-tokens of byte-level vocabularies
_PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = "▁"


class Aligner:
    """Both vocabularies, and the alignment of blocks of texts."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        shown = {c: b for b, c in enumerate(_byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        decoded = {i: bytes(shown[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.a_bytes = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
        self.ranks = self._ranks(spec, vocab, decoded)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Tokens as written in a digest: A inside and at the end of its part of a group, B likewise.
        self.written = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]

    def _ranks(self, spec: dict, vocab: dict[str, int], decoded: dict[int, bytes]):
        """The byte-level vocabulary for the library for ranks; None where its ids are not in the order of its merges."""
        import tiktoken

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocab.get(x + y, -1) for x, y in merges]
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or -1 in made or made != sorted(set(made)) or len(made) + 256 != len(vocab):
            return None
        return tiktoken.Encoding("ranks", pat_str=_PRETOKENS, mergeable_ranks={decoded[i]: i for i in vocab.values()}, special_tokens={})

    def ids_a(self, text: str) -> list[int]:
        """A's tokens of a space and the text."""
        if self.ranks is None or _OTHER.search(text):
            return self.a.encode(" " + text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(" " + text)

    def align(self, texts: list[str]) -> tuple:
        """(n_a, n_b, n_groups, n_links, digests, ends of pairs, pairs, times) of ``texts``, none of which is empty."""
        all_b = self.b.encode(texts, num_threads=1) if texts else []
        ids_a, ids_b, valid = [], [], np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            raw, a, b = (" " + text).encode(), self.ids_a(text), all_b[k]
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw:
                valid[k] = True
                ids_a.append(np.array(a, np.int64))
                ids_b.append(np.array(b, np.int64))
        n_a, n_b, n_groups, n_links = (np.zeros(len(texts), np.int64) for _ in range(4))
        digests = [""] * len(texts)
        if not ids_a:
            return n_a, n_b, n_groups, n_links, digests, np.zeros(len(texts), np.int64), n_a[:0], n_a[:0]
        docs = np.flatnonzero(valid)
        n_a[docs], n_b[docs] = [len(x) for x in ids_a], [len(x) for x in ids_b]
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # a token at whose end one of the other vocabulary ends is the last of its group; texts end in both
        last_a = end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a
        last_b = end_a[np.minimum(np.searchsorted(end_a, end_b), len(end_a) - 1)] == end_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        doc_a = np.repeat(docs, n_a[docs])
        doc_of = doc_a[last_a]
        n_groups += np.bincount(doc_of, minlength=len(texts))
        np.add.at(n_links, doc_of, in_a * in_b)

        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + from_b[group_a]] = a * 2 + last_a
        codes[np.arange(len(b)) + (from_a + in_a)[group_b]] = 2 * len(self.a_bytes) + b * 2 + last_b
        at = 0
        for k in docs.tolist():
            to = at + int(n_a[k] + n_b[k])
            digests[k] = hashlib.sha256("".join(map(self.written.__getitem__, codes[at:to].tolist()))[:-1].encode()).hexdigest()
            at = to

        wide_a, wide_b = len(self.a_bytes).bit_length(), len(self.b_bytes).bit_length()
        large = in_a * in_b > LARGE_GROUP
        times_b = np.where(large, 0, in_b)[group_a]
        of = np.repeat(np.arange(len(a)), times_b)  # the A token of each link
        place = np.arange(len(of)) - np.repeat(np.cumsum(times_b) - times_b, times_b)
        keys = (doc_a[of] << (wide_a + wide_b)) | (a[of] << wide_b) | b[from_b[group_a[of]] + place]
        keys, times = np.unique(keys, return_counts=True)
        more = [self._large(int(doc_of[g]) << (wide_a + wide_b), wide_b, a[from_a[g] : from_a[g] + in_a[g]], b[from_b[g] : from_b[g] + in_b[g]]) for g in np.flatnonzero(large)]
        if more:
            keys, times = np.concatenate([keys, *(x for x, _ in more)]), np.concatenate([times, *(x for _, x in more)])
            keys, back = np.unique(keys, return_inverse=True)
            summed = np.zeros(len(keys), np.int64)
            np.add.at(summed, back, times)
            times = summed
        ends = np.searchsorted(keys >> (wide_a + wide_b), np.arange(len(texts)), side="right")
        pairs = ((keys >> wide_b & ((1 << wide_a) - 1)) << 32) | (keys & ((1 << wide_b) - 1))
        return n_a, n_b, n_groups, n_links, digests, ends, pairs, times.astype(np.int64)

    def _large(self, doc: int, wide_b: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs of one group, and how often each is linked."""
        (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        return (doc | (x[:, None] << wide_b) | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


_SCHEMA = "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each distinct text: digest, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times. Written."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select(F.sha2("text", 256).alias("digest"), "copies", "text")
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in batches:
            for part in common.text_blocks(batch):
                *sums, digests, ends, pairs, times = tool.align(common.texts_of(part))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in sums), pa.array(digests, pa.string()), *lists], names=names)

    return common.materialise(texts.mapInArrow(common.tidy(align), _SCHEMA), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """For each linked pair of ids: pair (A id times 2^32, plus B id), n_docs, best (1 if no pair of its A id has more), n_texts. Written."""
    counts = common.materialise(aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n_docs"), F.count("*").alias("n_texts")), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # no more rows than vocabulary A
    return common.materialise(counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best"), "n_texts"), "pairs-best")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = aligned_texts(docs, a_path, b_path)
    pairs = pair_counts(aligned)
    linked = aligned.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("digest", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    total = pairs.agg(F.sum("n_texts")).first()[0] or 0
    joined = common.join_by_key(linked, pairs, "pair", "n_texts", total, SHARE)
    worth = joined.groupBy("digest").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    texts = aligned.drop("pairs", "times").join(worth, "digest", "left").withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")})
    texts = common.materialise(texts, "texts-measured")

    rows = common.materialise(docs.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("digest")), "doc-digests")
    measured = common.join_by_key(rows.where("digest IS NOT NULL"), texts, "digest", "copies", rows.count())
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    empty = rows.where("digest IS NULL").select("doc_id", *(none.alias(c) for c in columns), F.lit("").alias("groups_sha256"))
    return measured.select("doc_id", *columns, "groups_sha256").unionByName(empty)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(common.read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY))
