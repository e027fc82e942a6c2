"""Discovery, search responses, bundles, partition rewrites, stored-row recompute, institutions."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkvane.functions import institutions
from sparkvane.operators import frontier
from sparkvane.plans import catalog, recency, restate
from sparkvane.sources import bundles, html, responses


def one_by_one(roots, links, budget):
    """A queue for each root, as a loop."""
    after = defaultdict(list)
    for url, link, position in sorted(links, key=lambda x: (x[2], x[1])):
        if link not in after[url]:
            after[url].append(link)
    starts = defaultdict(list)
    for root, url, position in sorted(roots, key=lambda x: (x[2], x[1])):
        starts[root].append(url)
    out = []
    for root, urls in starts.items():
        queue, visited = list(dict.fromkeys(urls)), []
        while queue and len(visited) < budget:
            url = queue.pop(0)
            visited.append(url)
            queue += [x for x in after[url] if x not in visited and x not in queue]
        out += [(root, url, i + 1) for i, url in enumerate(visited)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_frontier_equals_a_queue_on_graphs_with_cycles(spark, seed):
    r = random.Random(seed)
    n = r.choice([6, 30])
    links = [(r.randrange(n), r.randrange(n), i) for i in range(n * r.choice([1, 3]))]
    roots = [(root, r.randrange(n), i) for root in range(6) for i in range(r.randint(1, 10))]
    got = frontier.explore(spark.createDataFrame(roots, "root int, url int, position int"), spark.createDataFrame([*links, (None, 1, 0), (1, None, 0)], "url int, link int, position int"), 8)
    assert sorted((x.root, x.url, x.place) for x in got.collect()) == one_by_one(roots, links, 8)


def test_frontier_query_equals_a_queue(spark, sf):
    c = [(x.c_custkey, x.c_nationkey) for x in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    roots = [(n, k, i) for n in {n for _, n in c} for i, k in enumerate(sorted(k for k, m in c if m == n)[:2])]
    links = [(x.o_custkey, x.o_orderkey * 31 % len(c), x.o_orderkey) for x in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    assert sorted((x.root, x.url, x.place) for x in catalog.QUERIES["discovery_frontier"](spark, sf).collect()) == one_by_one(roots, links, 8)


def test_page_links_stay_on_their_host(spark):
    page = '<a href="/a#x">Kobi paketi</a><a href="https://www.b.com/c">POS</a><a href="/d">hava durumu</a><a href="https://o.com/e">kobi</a>'
    rows = html.links(spark.createDataFrame([(1, "https://www.b.com/", page)], "page_id long, url string, html string"))
    assert sorted(x.link for x in frontier.page_links(rows, "kobi|pos").collect()) == ["https://www.b.com/a", "https://www.b.com/c"]


RESPONSE = """{"content": [
 {"type": "text", "text": "https://bank.test/invented"}, {"type": "server_tool_use", "name": "web_search", "input": {"query": "bank saas"}},
 {"type": "web_search_tool_result", "content": [{"type": "web_search_result", "url": "https://bank.test/offer#details"}, {"type": "web_search_result", "url": "https://bank.test.evil.test/offer"}, {"type": "web_search_result", "url": "https://bank.test/offer"}]},
 {"type": "web_search_tool_result", "content": {"error_code": "max_uses_exceeded"}}]}"""


def test_search_response(spark):
    many = '{"a": [[{"b": {"type": "web_search_tool_result", "content": [' + ",".join(f'{{"type": "web_search_result", "url": "https://x.bank.test/{i}"}}' for i in range(11)) + ']}}]], "type": "message"}'
    rows = [(1, RESPONSE), (2, "no json"), (3, None), (4, many), (5, '{"content": [{"type": "web_search_tool_result", "content": {}}, {"type": "web_search_result", "url": "https://bank.test/outside"}]}'), (6, "[]")]
    got = {x.response_id: (x.urls, x.queries, x.errors) for x in responses.search_results(spark.createDataFrame(rows, "response_id int, body string"), ["bank.test"]).collect()}
    assert got[1] == (["https://bank.test/offer"], ["bank saas"], ["max_uses_exceeded"])
    assert got[4] == ([f"https://x.bank.test/{i}" for i in range(8)], [], []) and got[5] == ([], [], ["search_error"]) and got[6] == ([], [], [])
    assert 2 not in got and 3 not in got


def test_bundle_round_trip_and_damage(spark, tmp_path):
    a, b, to = f"{tmp_path}/a", f"{tmp_path}/b", f"file://{tmp_path}/bundle"
    spark.range(50).repartition(3).write.parquet(a)
    spark.range(5).selectExpr("id", "'x' AS v").write.parquet(b)
    m = bundles.make_bundle(spark, {"a": a, "b": b}, to)
    assert {(x["table"], x["target"]) for x in m.collect()} == {("a", a), ("b", b)} and all(len(x["sha256"]) == 64 for x in m.collect())
    spark.range(3).write.mode("overwrite").parquet(a)
    assert bundles.restore_bundle(spark, to) == ["a", "b"]
    assert sorted(x.id for x in spark.read.parquet(a).collect()) == list(range(50)) and spark.read.parquet(b).count() == 5
    copies = sorted(x for x in os.listdir(f"{tmp_path}/bundle/a") if x.endswith(".parquet"))
    os.remove(f"{tmp_path}/bundle/a/{copies[0]}")
    with open(f"{tmp_path}/bundle/a/{copies[1]}", "r+b") as f:
        f.seek(20)
        f.write(b"\xff\x00\xff")
    os.remove(f"{tmp_path}/bundle/a/.{copies[1]}.crc")
    assert sorted((x.file, x.problem) for x in bundles.damaged(spark, to).collect()) == sorted([(copies[0], "missing"), (copies[1], "changed")])
    with pytest.raises(ValueError, match="damaged"):
        bundles.restore_bundle(spark, to)


def test_file_digests(spark, tmp_path):
    import hashlib

    os.makedirs(tmp_path / "d" / "e")
    for name, data in (("d/x.txt", b"one"), ("d/e/y.bin", bytes(range(256)) * 50)):
        (tmp_path / name).write_bytes(data)
    want = sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in (("x.txt", b"one"), ("e/y.bin", bytes(range(256)) * 50)))
    assert sorted(map(tuple, bundles.file_digests(spark, f"{tmp_path}/d").collect())) == want
    assert bundles.file_digests(spark, f"{tmp_path}/d/x.txt").first()["file"] == "x.txt"


def stored(spark, path):
    rows = []
    for i in range(12):
        done = i % 4 != 0 if i < 8 else True
        rows.append((f"week{i // 4}", i, f"Kobi kartı tahsilat kampanyası {i}", "Kampanya 12.05.2026 - 20.06.2026" if i % 2 else "Duyuru 3 Haziran 2026", f"https://x.com/haber/{i}", "", "Haber", "", *(("2026-01-01",) * 5 if done else ("",) * 5), "Yayın Tarihi" if done else "", "Yüksek" if done else "", "visible" if done else "", False, "old", False, "Haber" if i % 3 else "", False))
    names = ["week", "id", "item_title", "item_text", "item_url", "item_date", "source_type", "announcement_date", *restate.FIELDS]
    kinds = {"id": "int", "is_recent": "boolean", "is_active_campaign": "boolean", "is_actual_development": "boolean"}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    df.repartition("week").write.partitionBy("week").parquet(path)
    return df


def files(path):
    return {d: sorted(x for x in os.listdir(f"{path}/{d}") if x.endswith(".parquet")) for d in os.listdir(path) if d.startswith("week=")}


def test_recompute_touches_only_partitions_with_affected_rows(spark, tmp_path):
    path = f"{tmp_path}/items"
    df = stored(spark, path)
    before = files(path)
    touched = restate.restate_table(spark, path, "week", "2026-05-01")
    assert sorted(x.week for x in touched.collect()) == ["week0", "week1"]
    after = files(path)
    assert after["week=week2"] == before["week=week2"] and all(after[f"week={w}"] != before[f"week={w}"] for w in ("week0", "week1"))
    got = sorted(map(tuple, spark.read.parquet(path).select(*df.columns).collect()))
    want = restate.restated(df.where("week <> 'week2'"), "2026-05-01").unionByName(df.where("week = 'week2'"))
    assert got == sorted(map(tuple, want.collect()))
    rows = {x.id: x for x in spark.read.parquet(path).collect()}
    assert rows[4].campaign_start_date == rows[4].recency_basis_date == "2026-06-03" and rows[4].recency_reason == "Düşük tarih güveni: Düşük" and rows[1].recency_basis_date == "2026-01-01" and not rows[1].is_recent and rows[1].recency_reason.startswith("Kesim tarihinden eski")
    assert rows[0].is_actual_development and rows[0].development_candidate_type == "Kampanya" and rows[9].recency_reason == "old"
    assert recency.DEFAULT_START == "2026-05-01"
    untouched = files(path)
    assert bundles.rewrite_partitions(spark, path, "week", F.lit(False), lambda d: d).count() == 0 and files(path) == untouched


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Garanti BBVA", ("garanti_bbva", "Garanti BBVA", "Büyük Ölçekli Bankalar", "Türkiye Bankacılığı")),
        ("  TÜRKİYE İŞ BANKASI ", ("is_bankasi", "İş Bankası", "Büyük Ölçekli Bankalar", "Türkiye Bankacılığı")),
        ("Enpara Bank A.Ş.", ("enpara", "Enpara", "Dijital/Gelişen Oyuncular", "Türkiye Bankacılığı")),
        ("Alternatif-Bank", ("alternatif_bank", "Alternatif Bank", "Orta/Küçük Ölçekli Özel Bankalar", "Türkiye Bankacılığı")),
        ("fiba  banka", ("fibabanka", "Fibabanka", "Orta/Küçük Ölçekli Özel Bankalar", "Türkiye Bankacılığı")),
        ("Checkout.com", ("checkout_com", "Checkout.com", "Diğer", "Global Gelişmeler")),
        ("BKM", ("bkm", "BKM", "Sektör / Altyapı", "Türkiye Bankacılığı")),
        ("Webrazzi", ("webrazzi", "Webrazzi", "Diğer", "Türkiye Bankacılığı")),
        (None, ("", "", "Diğer", "Türkiye Bankacılığı")),
    ],
)
def test_institutions(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(df.select(institutions.institution_id("n"), institutions.institution_name("n"), institutions.group("n"), institutions.market_scope("n")).first()) == want


def test_duplicate_owners_and_alias_join(spark):
    df = spark.createDataFrame([("QNB",), ("Enpara.com",), ("ING",)], "n string")
    assert [x[0] for x in df.select(institutions.duplicate_owner("n")).collect()] == ["enpara_qnb_alias_group"] * 2 + ["ing"]
    right = spark.createDataFrame([("Qnb Finansbank", 1), ("ing", 2)], "who string, v int")
    left = spark.createDataFrame([("QNB",), ("ING",), ("x",), (None,)], "n string")
    assert sorted(((x.n, x.v) for x in institutions.alias_join(left, right, "n", "who").collect()), key=repr) == sorted([("QNB", 1), ("ING", 2), ("x", None), (None, None)], key=repr)


def test_pages_of_a_batch_are_parsed_in_slices(spark):
    """However many pages an Arrow batch holds, few at once become Python texts and rows; none is lost."""
    import pyarrow as pa

    from sparkvane.sources import html, selectors

    class Asked:
        """Takes the function that would run over the batches."""

        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            return Asked(self.df.select(*columns))

        def __getattr__(self, name):
            return getattr(self.df, name)

        def mapInArrow(self, run, schema):
            return run

    n = 1000
    pages = Asked(spark.createDataFrame([], "page_id long, url string, html string, source_id string"))
    ids, url, text = pa.array(range(n), pa.int64()), pa.array(["https://a.org/"] * n), pa.array([f'<p><a href="/{i}">t{i}</a>' for i in range(n - 1)] + [None])
    wide = pa.RecordBatch.from_arrays([ids, url, pa.nulls(n, pa.string()), text], names=["page_id", "base", "source_id", "html"])
    for run, batch, kept in (
        (html.links(pages), wide.select(["page_id", "base", "html"]), n - 1),
        (html.clean_pages(pages), wide.select(["page_id", "html"]), n),
        (selectors.anchors(pages, {"p": "p"}), wide, n - 1),
    ):
        out = list(run(iter([batch])))
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(kept))
        assert max(b.num_rows for b in out) <= html.PAGES_AT_ONCE
