"""Null and repeated doc_ids, and extra columns with the operators' own names."""

import zlib

import numpy as np
import pytest

from sparkvane.llm import fingerprint, linededup, packing, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, fp string, digest string, start long, n_tokens int, score double, place int, h long"
TEXTS = [(None, "one two three four five"), (None, "one two three four five"), (1, "a b c d e f"), (1, "another text of some words"), (2, None), (3, ""), (None, None), (4, "one two three four five")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 7, 7, 0.5, 7, 7) for i, t in TEXTS], SCHEMA)


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_packing_keeps_every_row(docs):
    pieces = packing.pack(docs).collect()
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(i, []).append(np.array([*library_ids(t), 1], "<u4"))
    for i, texts in ids.items():
        mine = [p for p in pieces if p["doc_id"] == i]
        assert sum(p["length"] for p in mine) == sum(map(len, texts))
        for p in mine:
            assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in texts)
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = {}
    for seq, offset, length in places:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length


def test_token_counts_keep_every_row(docs):
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs).collect())
    assert got == sorted((repr(i), len((t or "").encode()), len(library_ids(t))) for i, t in TEXTS)


def test_fingerprints_keep_every_row(docs):
    rows = fingerprint.edits(docs).collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(i) for i, _ in TEXTS)
    assert sorted(r["n_chars"] for r in rows) == sorted(len(t or "") for _, t in TEXTS)
    of = {}
    for r in fingerprint.fingerprints(docs).collect():
        of.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert of[4] <= of[None] and of[2] == of[3]


def test_simhash_groups_of_null_and_repeated_ids(docs):
    rows = simhash.groups(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[4] == {4} or None in by  # rows without an id join no number
    assert by[2] == by[3] == {2}


def test_line_dedup_of_null_and_repeated_ids(spark):
    body = "\n".join(f"line number {i} of a passage" for i in range(5))
    rows = [(None, body), (None, body), (1, body), (1, body), (2, body), (3, None), (3, "")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h long, place int")
    kept = sorted((repr((r["doc_id"], r["text"])) for r in linededup.deduplicate(d).collect()))
    assert kept == sorted(map(repr, [(None, body), (None, body), (1, body), (1, body), (2, ""), (3, None), (3, "")]))
    assert linededup.report(d).count() > 0


def test_toxicity_scores_every_row(spark, docs):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    train = [(i, " ".join(r.choice(words, 30)) + (" vile slur words" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(300)]
    texts, labels = spark.createDataFrame([x[:2] for x in train], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in train], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(texts, labels))
    got = toxicity.score(docs, model).collect()
    assert sorted(repr(x["doc_id"]) for x in got) == sorted(repr(i) for i, _ in TEXTS) and all(0 <= x["score"] <= 1 for x in got)
    scores = {}
    for x in got:
        scores.setdefault(x["score"], set()).add(x["doc_id"])
    assert any({None, 4} <= ids for ids in scores.values())  # equal texts score alike
