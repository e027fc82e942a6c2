"""Queries take whole texts and every row, however long or short."""

import random

from sparkvane.operators import similar
from sparkvane.plans import catalog


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_greedy_clusters_take_whole_texts(spark, tmp_path):
    opening, topic = "same opening words everywhere " * 12, "alpha bravo charlie delta echoes foxtrot golfing hotel india juliet"
    different = " ".join(f"filler{i}" for i in range(40)), " ".join(f"padding{i}" for i in range(40))
    rows = [(1, "short " * 60 + topic, "far", 1), (2, "brief " * 60 + topic, "far", 2)]  # alike beyond 300 characters only
    rows += [(3, opening + different[0], "near", 1), (4, opening + different[1], "near", 2)]  # alike within 300 characters only
    sf = stored(spark, tmp_path, "documents", rows, "doc_id long, text string, source string, n_chars long")
    assert sorted(map(tuple, catalog.QUERIES["greedy_clusters"](spark, sf).collect())) == [("far", 1, 1), ("far", 1, 2)]


def test_titles_of_any_length_are_compared(spark, tmp_path):
    titles = ["Kart", "Kart", "x" * 19, "long title " * 40, "long title " * 40 + "s", "", None, "a title of a usual length", "a title of a usual lengths"]
    rows = [(i, None if t is None else t + "\nbody", "s", i) for i, t in enumerate(titles)]
    sf = stored(spark, tmp_path, "documents", rows, "doc_id long, text string, source string, n_chars long")
    pairs = {(r["a"], r["b"]) for r in catalog.QUERIES["fuzzy_title_join"](spark, sf).collect()}
    known = [(i, " ".join(t.split())) for i, t in enumerate(titles) if t]
    assert pairs == {(i, j) for i, t in known for j, u in known if i < j and similar.ratio(t, u) >= 0.92} == {(0, 1), (3, 4), (7, 8)}
    got = {int(r["id"]): r["duplicate_of"] for r in catalog.QUERIES["greedy_dedup"](spark, sf).collect()}
    assert sorted(got) == list(range(len(titles)))
    assert {i: int(j) for i, j in got.items() if j is not None and j == j} == {1: 0, 4: 3, 8: 7}


def test_candidates_beyond_ten_stay(spark, tmp_path):
    links = "".join(f'<a href="/haberler/yeni-kart-duyurusu-{i}">Yeni kart duyurusu {i} Mayıs 2026</a>' for i in range(1, 31))
    sf = stored(spark, tmp_path, "pages", [(1, "https://y.com/a", f"<html><body><main>{links}</main></body></html>")], "page_id long, url string, html string")
    assert catalog.QUERIES["scored_candidates"](spark, sf).count() == 30


def test_fuzzy_pairs_of_classes_equal_brute_force(spark):
    """Titles of many lengths with edits of all kinds; copies come once each, with their class."""
    r = random.Random(3)
    titles = []
    for n in [1, 2, 3, 6, 12, 13, 25, 40, 80, 81, 150, 400]:
        base = "".join(r.choice("abcde fgh") for _ in range(n - 2)) + "xy" if n > 2 else "x" * n
        titles.append(base)
        for edits in (1, 2, max(1, n // 14), max(1, n // 12), n // 8):
            t = list(base)
            for _ in range(edits):
                at = r.randrange(len(t) + 1)
                t[at : at + r.randint(0, 1)] = r.choice(["", "z", "q"])
            titles.append("".join(t))
    titles += titles[:20] + [titles[-1]] * 5 + ["", None]
    d = spark.createDataFrame([(i, "b" if i % 7 else None, t) for i, t in enumerate(titles)], "id int, block string, t string")
    first = {}
    for i, t in enumerate(titles):
        if t and i % 7:
            first.setdefault(t, i)
    want = {(i, j) for t, i in first.items() for u, j in first.items() if i < j and similar.ratio(t, u) >= 0.92}
    want |= {(first[t], i) for i, t in enumerate(titles) if t and i % 7 and first[t] != i}
    got = [(x["a"], x["b"]) for x in similar.fuzzy_pairs(d, "block", "id", "t").collect()]
    assert set(got) == want and len(got) == len(want) > 30


def test_greedy_dedup_in_rounds_equals_the_sequential_pass(spark):
    """Copies, near copies and chains of them, dates on both sides of the window, null blocks, orders and titles."""
    import datetime
    import random

    r = random.Random(11)
    base = ["yeni kart duyurusu bugün yayında", "ticari kredi paketi genişliyor şimdi", "pos cihazı kampanyası başladı bugün"]
    rows = []
    for i in range(140):
        t = r.choice(base)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(t))
            t = t[:at] + r.choice("abcçxyz ") + t[at + 1 :]
        t = r.choice([t, t, t, base[0], "", None])
        day = r.choice([None, datetime.date(2026, 1, 1) + datetime.timedelta(days=r.randrange(200))])
        rows.append((i, r.choice(["a", "b", None]), t, r.choice([None, *range(60)]), day))
    schema = "id int, block string, t string, o int, d date"
    got = {x.id: x.duplicate_of for x in similar.greedy_dedup(spark.createDataFrame(rows, schema), "block", "id", "t", "o", "d").collect()}
    want, accepted = {}, {}
    for i, block, t, o, d in sorted(rows, key=lambda x: (x[3] is None, x[3] or 0, x[0])):
        hit = None
        for j, u, e in accepted.setdefault(block, []) if t else []:
            if (d is None or e is None or abs((d - e).days) <= 60) and similar.ratio(t, u) >= 0.92:
                hit = j
                break
        want[i] = hit
        if hit is None and t:
            accepted[block].append((i, t, d))
    assert got == want and sum(v is not None for v in want.values()) > 30
    assert similar.greedy_dedup(spark.createDataFrame([], schema), "block", "id", "t", "o", "d").count() == 0
