import hashlib

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import common, linededup


def brute(texts, run=3):
    seen, out = set(), []
    for k, t in enumerate(texts):
        raw = (t or "").split("\n")
        strip = "\t\n\x0b\x0c\r "
        at = [i for i, x in enumerate(raw) if x.strip(strip)]
        gone = set()
        for i in range(len(at) - run + 1):
            key = tuple(raw[j].strip(strip) for j in at[i : i + run])
            if key in seen:
                gone |= set(at[i : i + run])
            seen.add(key)
        out.append((k, len(at), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(raw) if i not in gone).encode()).hexdigest()))
    return out


def test_report_equals_brute_force(docs_of, sample):
    got = sorted(map(tuple, linededup.report(docs_of(sample)).collect()))
    assert got == brute(sample) and sum(r[2] for r in got) > 0


def test_runs_within_one_document_and_equal_lines(docs_of):
    texts = ["a\nb\nc\nx\na\nb\nc\nd", "q\nq\nq\nq\nq", "b\nc\nx", None, "\n\n", "a\n\nb\n \nc"]
    got = sorted(map(tuple, linededup.report(docs_of(texts)).collect()))
    assert got == brute(texts)


def test_deduplicate_keeps_rows_columns_and_lengths(docs_of, sample):
    d = docs_of(sample).withColumns({"places": F.lit(1), "digest": F.lit("x")})
    out = {r["doc_id"]: r for r in linededup.deduplicate(d).collect()}
    assert len(out) == len(sample) and set(out[0].asDict()) == set(d.columns)
    for i, t in enumerate(sample):
        assert (out[i]["text"] is None) == (t is None)
        if t is not None:
            assert out[i]["n_chars"] == len(out[i]["text"])
            assert hashlib.sha256(out[i]["text"].encode()).hexdigest() == brute(sample)[i][3]


def test_empty_table(docs_of):
    assert linededup.report(docs_of(["x"]).limit(0)).count() == 0


def brute_by_content(texts, run=3):
    """What stays when runs of fewer lines count from 50 words or 300 bytes on."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").split("\n")
        at = [i for i, x in enumerate(raw) if x.strip()]
        gone = set()
        for width in range(1, run + 1):
            for i in range(len(at) - width + 1):
                key = tuple(raw[j].strip() for j in at[i : i + width])
                if width < run and sum(len(x.split()) for x in key) < 50 and sum(len(x.encode()) for x in key) < 300:
                    continue
                if key in seen:
                    gone |= set(at[i : i + width])
                seen.add(key)
        out.append(None if t is None else "\n".join(x for i, x in enumerate(raw) if i not in gone))
    return out


def test_deduplicate_deletes_short_runs_that_hold_much(docs_of):
    passage = " ".join(f"word{i}" for i in range(52))
    half, other = " ".join(f"left{i}" for i in range(26)), " ".join(f"right{i}" for i in range(26))
    texts = [f"own {i}\n  {passage}\nend {i}" for i in range(6)]  # one line of 52 words
    texts += [f"{half}\n\n{other}", f"x\n{half}\n{other}\ny", f"{half}\nz", f"{other}\n{half}"]  # two lines of 52 words; one of 26; the other order
    texts += ["漢" * 100, "漢" * 100 + "\nb", "漢" * 99, "漢" * 99]  # no spaces: 300 bytes, and 297
    texts += [None, "", f"{passage}\nq\n{passage}", "short line", "short line"]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_by_content(texts)
    assert got[1] == "own 1\nend 1" and got[7] == "x\ny" and got[8] == f"{half}\nz" and got[11] == "b" and got[13] == "漢" * 99
    # the query counts lines alone, as its SQL does
    assert sorted(map(tuple, linededup.report(docs_of(texts)).collect())) == brute(texts)


@pytest.mark.parametrize("share", [1, 20, 10**9])
def test_keys_joined_apart_or_not(docs_of, sample, share, monkeypatch):
    """All keys by a shuffle, some of them, and none."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    texts = [*sample, *["a\nb\nc\nd"] * 9, "a\nb\n" * 30]
    assert sorted(map(tuple, linededup.report(docs_of(texts)).collect())) == brute(texts)
