import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkvane.llm import packing, tokens

PATH = tokens.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(tokens.Vocabulary(PATH))


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aabcdeT h's0.,!\n\téÉßİΣσ漢нет́\u2003\x85\x1c🙂<|>")), max_size=40), max_size=5))
def test_ids_equal_the_library(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == library(texts)


def test_counts_special_strings_and_small_tables(sample, monkeypatch):
    texts = [t or "" for t in sample] + ["<|endoftext|> a<|startoftext|>b<|endoftext|", "aaaaaaaaaaaaaaa", "don't we'LL"]
    want = [len(x) for x in library(texts)]
    assert ENCODER.count(texts) == want
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 5)  # the tables are emptied again and again
    small = tokens.Encoder(tokens.Vocabulary(PATH))
    assert [n for t in texts for n in small.count([t])] == want


def test_report(docs_of, sample):
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(sample), limit=300).collect()}
    want = [len(x) for x in library([t or "" for t in sample])]
    assert [got[i]["n_tokens"] for i in range(len(sample))] == want
    assert [got[i]["n_bytes"] for i in range(len(sample))] == [len((t or "").encode()) for t in sample]
    assert [got[i]["over_limit"] for i in range(len(sample))] == [n > 300 for n in want]
    assert tokens.token_counts(docs_of(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_packing_is_whole_gapless_and_tight(docs_of, sample, partitions):
    d = docs_of(sample * 6).repartition(partitions)
    rows = packing.pack(d).collect()
    ids = [np.array([*x, 1], "<u4") for x in library([t or "" for t in sample * 6])]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert len(by_doc) == len(sample) * 6
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces[:-1]]).tolist()
        assert sum(p["length"] for p in pieces) == len(ids[i])
    used = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces[:-1]]).tolist()
        assert sum(p["length"] for p in pieces) <= 2048
        used += sum(p["length"] for p in pieces)
    padded = sum(2048 - n for n in (sum(p["length"] for p in s) for s in by_seq.values()) if n & (n - 1))
    assert padded <= 2048 + 0.01 * used


def packed(lengths, **args):
    packer = packing.Packer(**args)
    most = 0
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n))
        most = max(most, len(packer.waiting), packer.fill_tokens // packer.capacity)
    packer.finish()
    assert not packer.open and not packer.waiting and not packer.fill
    return packer.done, most


@pytest.mark.parametrize("low, high", [(1, 256), (257, 2048), (1025, 2048), (1, 9000), (1, 2048)])
def test_bins_hold_whole_documents_and_pad_nothing(low, high):
    r = random.Random(high)
    lengths = [r.randint(low, high) for _ in range(3000)]
    done, most = packed(lengths)
    assert most <= packing.WAITING + 1
    totals = [sum(p.length for p in s) for s in done]
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals) and sum(n < 2048 for n in totals) <= 11
    tokens_of = {i: [] for i in range(len(lengths))}
    for s in done:
        for p in s:
            assert p.raw == np.arange(p.start, p.start + p.length, dtype="<u4").tobytes() and p.doc_tokens == lengths[p.doc_id]
            tokens_of[p.doc_id] += range(p.start, p.start + p.length)
    assert all(sorted(t) == list(range(lengths[i])) for i, t in tokens_of.items())
    if (low, high) == (1, 2048):  # documents that are no fill stay whole but for what the end takes
        pieces = {}
        for s in done:
            for p in s:
                pieces[p.doc_id] = pieces.get(p.doc_id, 0) + 1
        whole = [pieces[i] == 1 for i, n in enumerate(lengths) if n > 256]
        assert sum(whole) / len(whole) > 0.55


def test_a_bin_takes_the_number_of_its_class():
    done, _ = packed([700] * 4 + [1025] + [400] * 5 + [100] * 30)
    for k, n in ((2, 700), (1, 1025), (5, 400)):
        bins = [s for s in done if sum(p.length == n for p in s)]
        assert all(sum(p.length == n for p in s) == k for s in bins) and sum(p.length for s in bins for p in s) == 2048 * len(bins)


def test_packing_of_nothing(docs_of):
    assert packing.pack(docs_of(["x"]).limit(0)).count() == 0
