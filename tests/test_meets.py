"""Pairs of sets and titles that meet in chunks, against brute force."""

import random

import pytest

from sparkvane.operators import meets, similar


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(meets, "CHUNK", 300)
    monkeypatch.setattr(similar, "LEAST_WEIGHT", 1)


def rows_of_sets(seed):
    """Near copies, copies and strangers of many sizes; common words, null blocks and empty sets."""
    r = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([3, 4, 8, 20, 60]))] + ["the", "and"]
        for _ in range(6):
            new = [x for x in base if r.random() > 0.15] + [f"n{r.randrange(900)}" for _ in range(r.randint(0, len(base) // 3))]
            rows.append((len(rows), r.choice(["a", "b", None]), new, r.choice([None, *range(30)])))
    rows += [(len(rows) + i, b, t, o) for i, (_, b, t, o) in enumerate(r.sample(rows, 12))]
    return [*rows, (900, "a", [], 1), (901, "a", ["x"], 1), (902, "a", ["x"], 1)]


@pytest.mark.parametrize("overlap,at_least", [(3, 0.22), (3, 0.5), (1, 0.8)])
def test_token_pairs_in_chunks_equal_brute_force(spark, small, overlap, at_least):
    rows = rows_of_sets(5)
    d = spark.createDataFrame(rows, "id long, block string, t array<string>, o int")
    sets = {i: (b, set(t)) for i, b, t, _ in rows if b is not None}
    want = {}
    for i, (b, s) in sets.items():
        for j, (c, t) in sets.items():
            if i < j and b == c and len(s & t) >= overlap and len(s & t) / len(s | t) >= at_least:
                want[b, i, j] = len(s & t)
    got = [tuple(x) for x in similar.token_pairs(d, ["block"], "id", "t", overlap, at_least).select("block", "a", "b", "shared").collect()]
    assert {x[:3]: x[3] for x in got} == want and len(got) == len(want) > 10
    # without copies: pairs of classes and each copy with its class; copies give no square of their number
    first = {}
    for i, (b, s) in sorted(sets.items()):
        first.setdefault((b, frozenset(s)), i)
    few = {k: v for k, v in want.items() if all(first[k[0], frozenset(sets[i][1])] == i for i in k[1:])}
    few |= {(b, first[b, frozenset(s)], i): len(s) for i, (b, s) in sets.items() if len(s) >= overlap and first[b, frozenset(s)] != i}
    got = [tuple(x) for x in similar.token_pairs(d, ["block"], "id", "t", overlap, at_least, copies=False).select("block", "a", "b", "shared").collect()]
    assert {x[:3]: x[3] for x in got} == few and len(got) == len(few)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_in_rounds_equal_the_sequential_pass(spark, small, seed):
    rows = rows_of_sets(seed)
    d = spark.createDataFrame(rows, "id long, block string, t array<string>, o int")
    got = {tuple(x) for x in similar.greedy_clusters(d, "block", "id", "t", "o").collect()}
    want, used = set(), set()
    ordered = sorted(rows, key=lambda x: (x[3] is None, x[3] or 0, x[0]))
    for i, b, t, _ in ordered:
        if i in used:
            continue
        like = [j for j, c, u, _ in ordered if c == b and j not in used and len({*t} & {*u}) >= 3 and len({*t} & {*u}) / len({*t} | {*u}) >= 0.22]
        if len(like) >= 2:
            used.update(like)
            want |= {(b, i, j) for j in like}
    assert got == want and len(want) > 20


def test_titles_in_chunks_lose_no_pair(spark, small):
    """Titles with edits of all kinds in many chunks, beside strangers; the same title on several days."""
    import datetime

    r = random.Random(9)
    rows = []
    for n in [3, 9, 14, 30, 60, 120, 260]:
        base = "".join(r.choice("abcçdeğ fghxyz") for _ in range(n - 1)) + "z"
        for edits in (0, 0, 1, 2, max(1, n // 14), max(1, n // 10)):
            t = list(base)
            for _ in range(edits):
                at = r.randrange(len(t) + 1)
                t[at : at + r.randint(0, 1)] = r.choice(["", "q", "xy"])
            rows.append((len(rows), r.choice(["a", "a", "b"]), "".join(t), r.choice([None, datetime.date(2026, 1, 1), datetime.date(2026, 6, 1)])))
    d = spark.createDataFrame(rows, "id long, block string, t string, d date")
    first = {}
    for i, b, t, day in rows:
        if t:
            first.setdefault((b, t, day), i)
    near = lambda x, y: x is None or y is None or abs((x - y).days) <= 60
    want = {(i, j) for (b, t, x), i in first.items() for (c, u, y), j in first.items() if i < j and b == c and near(x, y) and similar.ratio(t, u) >= 0.92}
    want |= {(first[b, t, x], i) for i, b, t, x in rows if t and first[b, t, x] != i}
    got = [(x["a"], x["b"]) for x in similar.fuzzy_pairs(d, "block", "id", "t", "d").collect()]
    assert set(got) == want and len(got) == len(want) > 10
