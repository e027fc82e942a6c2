import random

import pytest

from sparkvane.llm import nearcopies, simhash


def brute_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.fixture(scope="module")
def copies():
    """Near copies around a similarity of 0.8, chains of them, and one line that all share."""
    r = random.Random(3)
    line = " ".join(f"common{i}" for i in range(30))
    out = []
    for _ in range(6):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 200))]
        for _ in range(8):
            new = list(words)
            for at in r.sample(range(len(new)), r.randint(0, max(1, len(new) // 40))):
                new[at] = f"new{r.randrange(9999)}"
            out.append(line + "\n" + " ".join(new))
            if r.random() < 0.3:
                words = new
    r.shuffle(out)
    return out


@pytest.mark.parametrize("least", [3, 10**6])
def test_groups_equal_brute_force(docs_of, sample, copies, monkeypatch, least):
    monkeypatch.setattr(nearcopies, "LEAST", least)
    texts = sample + copies
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs_of(texts)).collect()}
    want = brute_groups(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in nearcopies.deduplicate(docs_of(texts)).collect()}
    assert kept == {i for i, g in enumerate(want) if i == g}
    # three bits alone leave near copies
    assert kept < {r["doc_id"] for r in simhash.deduplicate(docs_of(texts), size=5).collect()}


def test_a_line_that_the_sample_missed_makes_few_documents_meet(docs_of, copies, monkeypatch):
    monkeypatch.setattr(nearcopies, "LEAST", 10**6)  # the sample finds no common shingles
    monkeypatch.setattr(nearcopies, "CROWD", 8, raising=False)
    line = " ".join(f"often{i}" for i in range(20))
    texts = [line + " " + " ".join(f"w{i}x{j}" for j in range(200)) for i in range(60)]
    met, write = [], nearcopies.common.materialise

    def spy(df, name, *rest):
        out = write(df, name, *rest)
        if name == "rest":
            sizes = [r["count"] for r in out.groupBy("h").count().collect()]
            met.append(sum(n * (n - 1) // 2 for n in sizes))
        return out

    monkeypatch.setattr(nearcopies.common, "materialise", spy)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs_of(texts + copies)).collect()}
    assert [got[i] for i in range(len(got))] == brute_groups(texts + copies)
    assert met[0] < 60 * 59 // 2  # fewer than the pairs on one shingle of the line


def test_odd_rows(spark, docs_of):
    d = spark.createDataFrame([(5, "a b c d e f"), (5, "x y"), (3, "A b c d e f"), (9, "x  y"), (None, "x y"), (7, None), (8, ""), (12, "z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in nearcopies.groups(d).collect()) == [(3, 3), (5, 3), (7, 7), (8, 7), (9, 3), (12, 12)]
    assert sorted(map(tuple, nearcopies.deduplicate(d).collect()), key=repr) == [(12, "z"), (3, "A b c d e f"), (7, None), (None, "x y")]
    assert nearcopies.deduplicate(docs_of(["a"]).limit(0)).count() == 0


def test_the_pipeline_leaves_no_near_copies(spark, docs_of, copies, sf):
    import corpus_pipeline as P

    out = dict(P.STAGES)["simhash_near_dedup"](spark, docs_of(copies), sf)
    texts = [r["text"] for r in out.collect()]
    assert texts and brute_groups(texts) == list(range(len(texts)))
