import hashlib
import re

import pytest

from sparkvane.llm import decontam

WORD = re.compile(rb"(?:[0-9a-z]|[\x80-\xff])+")


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(texts, items):
    out = []
    for k, t in enumerate(texts):
        w = words(t)
        hit, ids = set(), set()
        for i, x in items:
            q = words(x)
            n = min(10, len(q))
            grams = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)} if q else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    ids.add(str(i))
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(sample):
    long = [t for t in sample if t and len(t.split()) > 30]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(1, cut(long[0], 2, 20)), (2, cut(long[1], 0, 4)), (10, cut(long[2], 5, 15).upper()), (11, cut(long[2], 5, 15)), (3, None), (4, ""), (5, "absent " * 12), (6, "ÇA naïve"), (7, cut(long[0], 8, 25)), (None, cut(long[3], 0, 20))]


@pytest.mark.parametrize("limit", [decontam.AUTOMATON_BYTES, 200])
def test_report_equals_brute_force(spark, docs_of, sample, items, limit, monkeypatch):
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", limit)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.report(docs_of(sample), bench).collect()))
    assert got == brute(sample, [(i, t) for i, t in items if i is not None])
    clean = {r["doc_id"] for r in decontam.clean(docs_of(sample), bench).collect()}
    assert clean == {g[0] for g in got if not g[5]}


def test_no_benchmark_and_no_documents(spark, docs_of, sample, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert not any(r["contaminated"] for r in decontam.report(docs_of(sample), bench.limit(0)).collect())
    assert decontam.clean(docs_of(sample), bench.limit(0)).count() == len(sample)
    assert decontam.report(docs_of(["x"]).limit(0), bench).count() == 0


def test_spans_map_to_the_original():
    text = "Ça — One,  TWO;three\nfour"
    spans = [(2, 4)]  # the dash is a word: every non-ASCII character is
    assert [text[a:b] for a, b in decontam.char_spans(text, spans)] == ["One,  TWO"]
    assert decontam.char_spans("one one Two", [(1, 3)]) == [(4, 11)]


@pytest.mark.parametrize("group", [decontam.GROUP_BYTES, 60])
@pytest.mark.parametrize("limit", [decontam.AUTOMATON_BYTES, 60])
def test_rows_stay_whole_in_blocks_and_groups(spark, monkeypatch, limit, group):
    """Rows of equal and null doc_id are reported each, however many automata and passes there are."""
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", limit)
    monkeypatch.setattr(decontam, "GROUP_BYTES", group)
    items = [(str(i), " ".join(f"q{i}w{j}" for j in range(12))) for i in range(5)]
    rows = [(1, "a " + items[0][1]), (1, "b " + items[4][1] + " c " + items[0][1]), (None, items[2][1]), (None, "clean words only"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.report(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 13, 12, 1), (1, 26, 24, 2), (None, 12, 12, 1), (None, 3, 0, 0), (2, 0, 0, 0)], key=repr)
    assert sorted(map(tuple, decontam.clean(docs, bench).collect()), key=repr) == [(2, None), (None, "clean words only")]


def test_a_worker_builds_its_automaton_once(spark):
    sent = spark.sparkContext.broadcast(("name", [[("a", b"one two")]]))
    assert decontam._matcher(sent, 0, 10) is decontam._matcher(sent, 0, 10)
