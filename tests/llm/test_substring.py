import hashlib
import random

import pytest

from sparkvane.llm import common, substring


def brute(texts, window):
    seen, out = {}, []
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if seen.setdefault(key, k) < k:
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("share", [1, 20, 10**9])
def test_keys_joined_apart_or_not(docs_of, sample, share, monkeypatch):
    """All keys by a shuffle, some of them, and none; the windows of a phrase that repeats come with all their places."""
    monkeypatch.setattr(substring, "repeated_spans", lambda d, w, f=substring.repeated_spans: f(d, w, substring.GRAM, 0))
    monkeypatch.setattr(common, "HOT_SHARE", share)
    texts = sample + ["tick tock " * 90] * 3 + ["tick " + "tock tick " * 40]
    got = sorted(map(tuple, substring.report(docs_of(texts)).collect()))
    assert got == brute(texts, 50)


@pytest.mark.parametrize("hot", [substring.HOT, 2, 0])
def test_report_equals_brute_force(docs_of, sample, hot, monkeypatch):
    monkeypatch.setattr(substring, "repeated_spans", lambda d, w, f=substring.repeated_spans: f(d, w, substring.GRAM, hot))
    got = sorted(map(tuple, substring.report(docs_of(sample)).collect()))
    assert got == brute(sample, 50)


def test_overlapping_matches_do_not_hide_windows(docs_of):
    # the third text's middle window lies across two matches; the fourth holds it
    r = random.Random(1)
    a, b = [[f"{p}{r.randint(0, 999)}" for _ in range(60)] for p in "ab"]
    texts = [" ".join(a), " ".join(b), " ".join(a + b), " ".join((a + b)[30:100])]
    got = sorted(map(tuple, substring.report(docs_of(texts)).collect()))
    assert got == brute(texts, 50) and got[3][2] == 70


def test_automaton_statistics_are_longest_suffixes():
    r = random.Random(3)
    for _ in range(200):
        texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 14))] for _ in range(3)]
        q = [r.choice([b"a", b"b", b"c"]) for _ in range(12)]
        sam = substring.SuffixAutomaton()
        for t in texts:
            sam.add(t)
        subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(q[i + 1 - n : i + 1]) in subs), default=0) for i in range(len(q))]
        assert list(sam.statistics(q)) == want


def test_equal_windows_have_equal_anchors():
    w = [b"%d" % random.Random(i).randint(0, 50) for i in range(300)]
    h1, _, f1, l1 = substring.anchors_of(w, 50, 12)
    h2, _, f2, l2 = substring.anchors_of([b"x", b"y", *w], 50, 12)
    one = {i: h for h, a, b in zip(h1, f1, l1) for i in range(a, b + 1)}
    two = {i: h for h, a, b in zip(h2, f2, l2) for i in range(a, b + 1)}
    assert len(one) == 251 and all(two[i + 2] == h for i, h in one.items())


def test_deduplicate_keeps_columns_and_nulls(spark, docs_of, sample):
    from pyspark.sql import functions as F

    d = docs_of(sample).withColumns({"removed": F.lit("x"), "spans": F.lit(1)})
    out = {r["doc_id"]: r for r in substring.deduplicate(d).collect()}
    assert len(out) == len(sample) and out[0].asDict().keys() == set(d.columns)
    assert all((out[i]["text"] is None) == (t is None) for i, t in enumerate(sample))
    want = {k: n for k, _, n, _ in brute(sample, 50)}
    assert all(out[i]["text"] == t for i, t in enumerate(sample) if not want[i])


def test_reference_spans_and_empty_tables(spark, docs_of, sample):
    d = docs_of(sample)
    found = {r["doc_id"]: r["spans"] for r in substring.reference_spans(d, d.limit(0).select("text")).collect()}
    assert len(found) == len(sample) and not any(found.values())
    long = max(range(len(sample)), key=lambda i: len((sample[i] or "").split()))
    found = {r["doc_id"]: r["spans"] for r in substring.reference_spans(d, d.where(f"doc_id = {long}").select("text")).collect()}
    assert [tuple(s) for s in found[long]] == [(0, 3000)]
    assert substring.report(d.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_do_not_remove_themselves(spark):
    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((str(r[0]), r[2]) for r in substring.report(d).collect())
    assert got == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]
