"""Row operators, merges, sources and the queue: literal cases and properties."""

import pytest
from pyspark.sql import functions as F

from sparkvane.operators import changes, queue, rows, similar
from sparkvane.sources import html, tables


def rowset(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_change_status_skips_failed_fetches(spark):
    d = spark.createDataFrame([("s", i, h, f) for i, (h, f) in enumerate([("a", False), ("", False), ("a", False), ("b", True), ("a", False), ("b", False), (None, False)])], "k string, t int, h string, failed boolean")
    got = [r[0] for r in d.select(changes.change_status(["k"], ["t"], F.col("h"), F.col("failed")).alias("c"), "t").orderBy("t").collect()]
    assert got == ["new_source", "error", "unchanged", "error", "unchanged", "changed", "error"]


def test_merges_are_idempotent_and_keep_decisions(spark):
    cols = ["id", "v", "review_status", "created_at"]
    old = spark.createDataFrame([("1", "a", "Onaylandı", "t0"), ("2", "b", "Beklemede", "t0"), ("3", "c", "Beklemede", "t0")], ", ".join(f"{c} string" for c in cols))
    new = spark.createDataFrame([("2", "B", "Beklemede", "t1"), ("4", "d", "Beklemede", "t1")], ", ".join(f"{c} string" for c in cols))
    once = changes.merge_preserving(old, new, "id", cols, ["Onaylandı"])
    assert rowset(once) == [("1", "a", "Onaylandı", "t0", "kept"), ("2", "B", "Beklemede", "t0", "updated"), ("4", "d", "Beklemede", "t1", "inserted")]
    assert rowset(changes.merge_preserving(once.drop("_action"), new, "id", cols, ["Onaylandı"]).drop("_action")) == rowset(once.drop("_action"))
    arch = spark.createDataFrame([("1", "RIA-1", "t0", "x")], "id string, archive_id string, archived_at string, reason string")
    more = spark.createDataFrame([("1", "RIA-9", "t1", "y"), ("2", "RIA-2", "t1", "z")], "id string, archive_id string, archived_at string, reason string")
    merged = changes.merge_archive(arch, more, "id", arch.columns)
    assert rowset(merged) == [("1", "RIA-1", "t0", "y", "updated"), ("2", "RIA-2", "t1", "z", "inserted")]
    again = changes.merge_archive(merged.drop("_action"), more, "id", arch.columns)
    assert {r["_action"] for r in again.collect()} == {"same"}


def test_diff_with_itself_is_empty(spark):
    d = spark.createDataFrame([("1", None), ("2", ""), ("3", "x")], "id string, v string")
    assert changes.diff(d, d, "id", ["id", "v"]).count() == 0
    assert changes.diff(d, d.withColumn("v", F.coalesce("v", F.lit(""))), "id", ["id", "v"]).count() == 0
    assert rowset(changes.diff(d, d.where("id > '1'").withColumn("v", F.lit("y")), "id", ["id", "v"])) == [("1", "removed"), ("2", "changed"), ("3", "changed")]


def test_joins_and_picks(spark):
    l = spark.createDataFrame([(1, None, "a"), (2, "k", ""), (3, "z", None)], "id int, k string, v string")
    r = spark.createDataFrame([(None, "n"), ("k", "m")], "k string, v string")
    assert rowset(rows.null_safe_join(l.drop("v"), r, ["k"])) == [(1, None, "n"), (2, "k", "m"), (3, "z", None)]
    assert rowset(rows.coalesce_join(l, r, ["k"], ["v"]).select("id", "v")) == [(1, "a"), (2, "m"), (3, None)]
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert rowset(rows.latest(d, ["k"], "t")) == [("a", 2, "y"), ("b", 1, None)]
    assert rowset(rows.first_value(d, "k", "v", [F.col("t")])) == [("a", "x"), ("b", None)]
    assert rowset(rows.repeated_keys(d, "k")) == [("a", 1, "x"), ("a", 2, "y")]
    assert rowset(rows.conform(d, ["v", "new"]).limit(1))[0][1] is None


def test_similarity(spark):
    assert similar.ratio("abc", "abc") == 1.0 and similar.ratio("abc", "xyz", 0.9) == 0.0
    d = spark.createDataFrame([(1, "b", "yeni kart kampanyası başladı", "2026-05-01"), (2, "b", "yeni kart kampanyası başladi", "2026-05-20"), (3, "b", "yeni kart kampanyası başladı", "2026-09-01"), (4, "c", "yeni kart kampanyası başladı", "2026-05-01")], "id int, blk string, t string, d string").withColumn("d", F.col("d").cast("date"))
    assert [(r["a"], r["b"]) for r in similar.fuzzy_pairs(d, "blk", "id", "t", "d").collect()] == [(1, 2)]
    got = rowset(similar.greedy_dedup(d.withColumn("o", F.col("id")), "blk", "id", "t", "o", "d"))
    assert [tuple(None if x != x else x for x in r) for r in got] == [(1, None), (2, 1), (3, None), (4, None)]
    cells = spark.createDataFrame([(1, "u", "a quote of good length"), (2, "u", "short"), (3, "u", "an invented quote here"), (4, "foreign", "a quote of good length"), (5, "u", "a quote … good length")], "id int, url string, quote string")
    src = spark.createDataFrame([("u", "Here is A  quote of\ngood length.")], "url string, text string")
    assert [r["id"] for r in similar.evidence(cells, src).where("accepted").collect()] == [1]


def test_queue(spark):
    jobs = spark.createDataFrame([(1, queue.QUEUED, 0.0, 5, ""), (2, queue.QUEUED, 0.0, 3, ""), (3, queue.RUNNING, 10.0, 1, "t")], "id int, status string, lease_until double, created_at int, worker_token string")
    now = F.lit(20.0)
    assert queue.next_queued(jobs).first()["id"] == 2
    claimed = queue.claim(jobs, 2, "tok", now)
    assert claimed.where("id = 2").first()["status"] == queue.RUNNING and queue.claim(claimed, 2, "other", now).where("id = 2").first()["worker_token"] == "tok"
    late = queue.update(queue.expire(jobs, now), 3, "t", now, status=queue.REVIEW)
    assert late.where("id = 3").first()["status"] == queue.CUT
    gone = queue.cancel(claimed, 2)
    assert queue.update(gone, 2, "tok", now, status=queue.REVIEW).where("id = 2").first()["status"] == queue.CANCELLED
    assert queue.heartbeat(claimed, 2, "tok", F.lit(30.0)).where("id = 2").first()["lease_until"] == 30.0 + queue.LEASE_SECONDS


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    at = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    assert tables.shared_folder(at("spark://h:7077", "hdfs://h/c/")) == "hdfs://h/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(at("spark://h:7077", None))


def test_tables(spark, tmp_path):
    p = f"file://{tmp_path}"
    (tmp_path / "a.csv").write_bytes("﻿id,name,extra\n1,\"a \"\"q\"\"\nb\",x\n2,,y\n".encode())
    d = tables.read_csv(spark, f"{p}/a.csv", ["id", "name", "more"])
    assert rowset(d) == [("1", 'a "q"\nb', None), ("2", None, None)]
    assert tables.read_csv(spark, f"{p}/none.csv", ["id"]).count() == 0
    assert tables.write_if_changed(d, f"{p}/t", ["id", "name"]) and not tables.write_if_changed(d.orderBy(F.desc("id")), f"{p}/t", ["id", "name"])
    assert tables.write_if_changed(d.limit(1), f"{p}/t", ["id", "name"]) and spark.read.parquet(f"{p}/t").count() == 1
    m = tables.snapshot({"t": (d, "id")}, f"{p}/snap")
    entry = m.first()
    assert entry["rows"] == 2 and sorted(r[0] for r in spark.read.parquet(entry["copy"]).select(entry["key"]).collect()) == ["1", "2"]
    assert tables.since_snapshot(m, d, "another", "id").count() == 2
    assert [r["id"] for r in tables.since_snapshot(m, d.union(spark.createDataFrame([("3", "", "")], d.schema)), "t", "id").collect()] == ["3"]
    tables.write_json(spark, f"{p}/s.json", {"b": 1, "a": "é"})
    assert (tmp_path / "s.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}'
    old = spark.createDataFrame([("1", "Araştırılıyor"), ("2", "Taslak")], "id string, status string")
    assert rowset(tables.copy_absent(old, old.where("id = '2'"), "id", ["Araştırılıyor"], "Kesildi")) == [("1", "Kesildi")]


PAGE = """<html><head><title>T &amp; U</title><script type="application/ld+json">{"datePublished": "2026-05-12", "dateModified": "2027-01-01"}</script></head>
<body><nav><a href="/giris">Login</a></nav><main><h2>Haberler</h2><p>Bir satır</p><p>Bir satır</p><div>İki<br>üç</div>
<a href="/haberler/yeni-kart-duyurusu?utm_source=x">Yeni kart duyurusu 12 Mayıs 2026</a><a href="https://other.com/haber/x">Dış haber bağlantısı burada</a>
<a href="/haberler/yeni-kart-duyurusu">Yeni</a><script>var x = "<p>no</p>";</script></main><footer>alt</footer>"""


def test_html(spark):
    assert html.clean_text(PAGE)[0] == "T & U" and html.clean_text(PAGE)[1].split("\n")[:4] == ["Haberler", "Bir satır", "İki", "üç"]
    assert html.clean_text(PAGE)[1].count("Bir satır") == 1 and "alt" not in html.clean_text(PAGE)[1] and html.clean_text(None) == ("", "")
    assert html.markup_date(PAGE) == "2026-05-12"
    pages = spark.createDataFrame([(1, "https://y.com/a", PAGE), (2, "https://y.com/b", None)], "page_id long, url string, html string")
    links = html.links(pages)
    assert [(r["href"], r["in_furniture"], r["heading"]) for r in links.orderBy("position").collect()][:2] == [("/giris", True, ""), ("/haberler/yeni-kart-duyurusu?utm_source=x", False, "Haberler")]
    c = html.candidates(links).collect()
    assert [(r["url"], r["title"], str(r["date"])) for r in c] == [("https://y.com/haberler/yeni-kart-duyurusu", "Yeni kart duyurusu 12 Mayıs 2026", "2026-05-12")]
    m = html.link_metrics(links).first()
    assert (m["links"], m["dated"]) == (4, 1) and m["menu_share"] == pytest.approx(0.25)
    rules = spark.createDataFrame([("y.com", "/haberler/.+", "(?i)kart", "", 24, 8, 10, 25)], "site string, path_pattern string, positive string, negative string, score int, dated_bonus int, shortest int, k int")
    assert [(r["url"], r["score"]) for r in html.adapt(links, rules).collect()] == [("https://y.com/haberler/yeni-kart-duyurusu", 32)]


def test_next_ids_over_many_ranges(spark):
    from sparkvane.plans import sourcing

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    new = spark.createDataFrame([(f"u{i:03d}",) for i in range(50)], "url string").repartition(5)
    have = spark.createDataFrame([("REG-007",), ("x",)], "source_id string")
    got = {r["url"]: r["source_id"] for r in sourcing.next_ids(new, have).collect()}
    spark.conf.set(key, old)
    assert got == {f"u{i:03d}": f"REG-{i + 8:03d}" for i in range(50)}
