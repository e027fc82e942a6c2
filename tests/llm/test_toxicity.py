import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkvane.llm import toxicity


@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0.5, 5)), max_size=12, unique_by=lambda x: x[0]))
def test_segments_are_maximal(hits):
    hits = sorted(hits)
    score = [-toxicity.DRIFT] * 31
    for i, w in hits:
        score[i] = w
    got = toxicity.segments(hits)
    assert all(abs(sum(score[a:b]) - s) < 1e-9 for a, b, s in got)
    best = max((sum(score[a:b]) for a in range(31) for b in range(a + 1, 32)), default=0)
    assert max((s for _, _, s in got), default=0) == pytest.approx(best if hits else 0)
    assert sorted(i for a, b, _ in got for i, _ in hits if a <= i < b) == [i for i, _ in hits]
    assert all(got[i][1] <= got[i + 1][0] for i in range(len(got) - 1))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    insults = ["idiotx", "moronx", "clownx", "scumx"]
    docs, labels = [], []
    for i in range(1200):
        w = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.15
        for _ in range(r.randint(1, 3) if toxic else 0):
            w.insert(r.randint(0, len(w)), r.choice(insults))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy_and_passages(corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if toxicity.held_out(r["doc_id"])]
    assert 200 < len(held) < 400 and all(0 <= r["score"] <= 1 for r in got)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) >= 0.97
    assert all(r["passages"] for r in held if truth[r["doc_id"]] and r["predicted"])
    kept = {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_held_out_labels_do_not_matter(corpus):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, x))).orderBy("doc_id").select("doc_id", "score").collect() for x in (labels, flipped))
    assert a == b


def test_edge_rows_and_labels(spark, corpus):
    docs, labels, _ = corpus
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "idiotx " * 30000), (None, "idiotx")], "doc_id long, text string")
    model = toxicity.fit(toxicity.training_rows(docs, labels.union(labels.limit(5))))
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and got[0]["score"] == got[1]["score"] < 0.3 and max(r["score"] for r in got) > 0.3
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")):
        assert {r["predicted"] for r in toxicity.score(odd, toxicity.fit(toxicity.training_rows(docs, none))).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_scan_is_linear_and_equal_to_the_plain_search():
    import time

    def plain(hits):
        found, total, at = [], 0.0, 0
        for i, w in hits:
            before = total - toxicity.DRIFT * (i - at)
            total, at = before + w, i + 1
            new = [i, i + 1, before, total]
            while True:
                j = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < new[2]), None)
                if j is None or found[j][3] >= new[3]:
                    found.append(new)
                    break
                new = [found[j][0], new[1], found[j][2], new[3]]
                del found[j:]
        return [(a, b, r - l) for a, b, l, r in found]

    r = random.Random(9)
    for _ in range(300):
        hits = [(i, r.choice([0.01, 0.02, 0.5, 2.0])) for i in sorted(r.sample(range(2000), r.randint(0, 60)))]
        assert toxicity.segments(hits) == plain(hits)
    for gap, weight in ((300, 1.5), (1, 2.0), (76, 1.5), (75, 1.5)):
        start = time.perf_counter()
        toxicity.segments([(gap * i, weight) for i in range(100_000)])
        assert time.perf_counter() - start < 1


def test_rows_to_fit_on_have_a_bound(corpus):
    docs, labels, _ = corpus
    assert toxicity.training_rows(docs, labels, rows=10**6).count() > 800 > 200 > toxicity.training_rows(docs, labels, rows=100).count() > 50


def test_long_tokens_count(spark):
    long = "ä" * 5000
    docs = spark.createDataFrame([(i, f"plain words here {'x' * (i % 7)} {long if i % 3 == 0 else ''}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, labels, all_folds=True))).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got)
