import hashlib

import pytest

from sparkvane.llm import fingerprint


def edited(texts):
    t = [x or "" for x in texts]
    return [x[: len(x) - len(x) // 4] + t[(i + 1) % len(t)][: len(x) // 4] for i, x in enumerate(t)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_edits_equal_brute_force(docs_of, sample, partitions):
    d = docs_of(sample).repartition(partitions)
    got = {r["doc_id"]: r for r in fingerprint.edits(d).collect()}
    assert len(got) == len(sample)
    for i, e in enumerate(edited(sample)):
        t, n = sample[i] or "", sample[(i + 1) % len(sample)] or ""
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["same_edited"] == (fingerprint.canonical(t) == fingerprint.canonical(e))
        assert got[i]["same_next"] == (fingerprint.canonical(t) == fingerprint.canonical(n))


def test_fingerprints_stand_for_canonical_texts(docs_of, sample):
    more = [*sample, "A  b\u00a0C", " a B c\n", "ﬁne", "FINE", "straße", "STRASSE"]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs_of(more)).collect()}
    for i, a in enumerate(more):
        for j, b in enumerate(more):
            assert (got[i] == got[j]) == (fingerprint.canonical(a or "") == fingerprint.canonical(b or ""))


def test_colliding_digests_are_told_apart(docs_of):
    texts = ["one", "two", "ONE", "three", None, "Two "]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs_of(texts), lambda c: c[:1].hex()).collect()}
    assert got[0] == got[2] == "6f" and got[4] == ""  # alone in their buckets
    assert got[1] == got[5] != got[3] and got[1].startswith("74:") and got[3].startswith("74:")


def test_ties_single_rows_and_nothing(spark, docs_of):
    one = fingerprint.edits(docs_of(["abcdefgh"])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    ties = spark.createDataFrame([(1, "bbbb"), (1, "aaaa"), (2, "cccc")], "doc_id long, text string")
    assert sorted(r["edited_sha256"] for r in fingerprint.edits(ties).collect()) == sorted(hashlib.sha256(x).hexdigest() for x in (b"aaab", b"bbbc", b"ccca"))
    assert fingerprint.edits(docs_of(["x"]).limit(0)).count() == 0


def test_the_query_equals_brute_force(docs_of, spark, sample, tmp_path):
    """All columns of the query: edited texts, likeness, and equal fingerprints for equal canonical texts alone."""
    docs_of(sample).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.op4_document_fingerprints(spark, str(tmp_path)).collect()}
    texts = [t or "" for t in sample]
    assert sorted(got) == list(range(len(texts)))
    forms = {}
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        canon = fingerprint.canonical
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(following)))
        for text, f in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert forms.setdefault(canon(text), f) == f
    assert len(set(forms.values())) == len(forms)
