import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from sparkvane.llm import alignment

A, B = public_tokenizers.path(alignment.A_VOCABULARY), public_tokenizers.path(alignment.B_VOCABULARY)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(libraries, texts):
    """Each whole text through the libraries, groups by sets of ends, links by all pairs."""
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(decode[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(None)
            continue
        ends_a = [sum(map(len, bytes_a[: i + 1])) for i in range(len(ids_a))] if len(ids_a) < 3000 else list(__import__("itertools").accumulate(map(len, bytes_a)))
        ends_b = list(__import__("itertools").accumulate(map(len, bytes_b)))
        both = set(ends_a) & set(ends_b)
        groups, ga = [], defaultdict(lambda: ([], []))
        for k, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            n = 0
            for i, e in zip(ids, ends, strict=True):
                ga[n][k].append(i)
                n += e in both
        groups = [ga[n] for n in sorted(ga)]
        docs.append((len(ids_a), len(ids_b), groups))
    count = Counter(p for d in docs if d for p in {(x, y) for g in d[2] for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in d[2] for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d[2])
        out.append((d[0], d[1], len(d[2]), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


ODD = [
    "a  b", " lead", "trail ", "  ", " ", "\n", "x\n y\n\n  z \t w", "tab\tand\r\nreturn \r\n", "don't we'll I'VE 's", "<|endoftext|> in <|endoftext|>x", "<s> </s> <unk>",
    "it▁has one", "漢字かな交じり文 テスト 🙂🙂 é́", " nbsp em 　wide", "\x1c\x1d odd \x85", "a" * 500, "123 4567,89 -- !!! ...", "naïve ÇA ß İı", "x;\r y{\r\n}", "﻿bom ​zero", "same", "same", "same words same words",
]


def results(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in sorted(alignment.align(rows, A, B).collect())]


def test_alignment_equals_brute_force(spark, libraries, sample):
    texts = [*sample, *ODD, None, ""]
    assert results(spark, texts) == brute(libraries, texts)


def test_ranks_equal_the_vocabularys_own_library(libraries):
    """Random texts of white space, marks and letters, with and without characters that go to the own library."""
    tool = alignment.aligner(A, B)
    assert tool.ranks is not None
    r = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\t", "\r", "\x0b", "a", "bc", "The", "'s", "'", ".", ";", "{", "1", "é", "ß", "½", "²", "—", "€", "←", "<|endoftext|>"]
    odd = [" ", "\x1f", "\x85", " ", "漢", "🙂", "Ω", "٣", "x" * 401]
    for k in range(3000):
        text = "".join(r.choice(parts + odd * (k % 2)) for _ in range(r.randint(1, 14)))
        assert tool.ids_a(text) == libraries[0].encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_split_keys_and_large_groups_give_the_same(spark, libraries, sample, monkeypatch):
    """Pairs and texts on both sides of the broadcast's bound, and groups counted by their distinct ids."""
    monkeypatch.setattr(alignment, "SHARE", 30)
    texts = sample[:20] + ["one text with many copies"] * 30
    assert results(spark, texts) == brute(libraries, texts)
    tool, texts = alignment.Aligner(A, B), [x for x in [*sample, *ODD] if x]
    plain = tool.align(texts)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    assert all(list(x) == list(y) for x, y in zip(tool.align(texts), plain, strict=True))


def test_empty_table_null_ids_and_clashing_columns(spark, libraries):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    texts = ["one two", "one two", None, "three"]
    rows = spark.createDataFrame([(None, "one two", "x", 1), (1, "one two", "y", 2), (1, None, "z", 3), (None, "three", "w", 4)], "doc_id long, text string, digest string, pair long")
    got = sorted((tuple(r) for r in alignment.align(rows, A, B).collect()), key=repr)
    assert got == sorted(((d, *m) for d, m in zip([None, 1, 1, None], brute(libraries, texts), strict=True)), key=repr)
