"""The weekly run end to end on stored pages, and its invariants."""

import pytest
from pyspark.sql import functions as F

from sparkvane.plans import weekly
from sparkvane.sources import adapters, html, report

LIST = "<html><body><main>" + "".join(f'<a href="/haberler/{slug}">{title}</a>' for slug, title in [
    ("kobi-kart-kampanyasi", "KOBİ kart kampanyası başladı"), ("kobi-kart-kampanyasi-2", "KOBİ kart kampanyası başladi"), ("eski-kampanya", "Eski bir kart kampanyası duyurusu"), ("iletisim", "İletişim sayfası bağlantısı burada"),
]) + "</main></body></html>"
BODY = "<html><head><title>x</title></head><body><p>{}</p><p>" + "Bu metin yeterince uzun olsun diye yazıldı. " * 30 + "</p></body></html>"


@pytest.fixture(scope="module")
def tables(spark):
    pages = [
        (1, "https://a.com/haberler", LIST),
        (2, "https://a.com/haberler/kobi-kart-kampanyasi", BODY.format("Kampanya 12.05.2026 - 30.06.2026 arasında")),
        (3, "https://a.com/haberler/kobi-kart-kampanyasi-2", BODY.format("Kampanya 13.05.2026 - 30.06.2026 arasında")),
        (4, "https://a.com/haberler/eski-kampanya", BODY.format("Kampanya 12.05.2020 - 30.06.2020 arasında")),
    ]
    fetches = [(9, "S1", "2026-06-01", "fetched", "h0"), (1, "S1", "2026-06-08", "fetched", "h1"), (5, "S2", "2026-06-01", "fetched", "k"), (6, "S2", "2026-06-08", "fetched", "k")]
    reg = [(s, "a", "A Bank", "Duyurular", "Duyuru", f"https://a.com/{u}", "True", "True", "static_scrape", "both", "", "") for s, u in (("S1", "haberler"), ("S2", "x"))]
    reg_cols = "source_id institution_id institution_name source_name source_type url active mvp_active collection_method extraction_mode monitoring_mode weekly_collection_enabled"
    item_cols = "recent_item_id institution_name canonical_item_url content_fingerprint normalized_title recency_basis_date"
    return {
        "registry": spark.createDataFrame(reg, ", ".join(f"{c} string" for c in reg_cols.split())),
        "fetches": spark.createDataFrame(fetches, "document_id long, source_id string, fetched_at string, status string, content_hash string"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "items": spark.createDataFrame([], ", ".join(f"{c} string" for c in item_cols.split())),
    }


S = weekly.Settings("r1", "2026-06-08", institutions=("A Bank",), types=("Duyuru",))


def test_run(spark, tables):
    out = weekly.run(tables, S)
    audit = {r["item_url"].rsplit("/", 1)[1]: r["rejected_reason"] for r in out["audit"].collect()}
    assert audit["kobi-kart-kampanyasi"] == audit["kobi-kart-kampanyasi-2"] == "" and audit["eski-kampanya"].startswith("Kesim tarihinden eski") and "iletisim" not in audit
    assert [r["item_url"].rsplit("/", 1)[1] for r in out["new_items"].collect()] == ["kobi-kart-kampanyasi"]
    f = out["figures"].first()
    assert (f["sources_checked"], f["unchanged_sources"], f["changed_sources"], f["new_items"], f["duplicates"]) == (2, 1, 1, 1, 1)
    assert sum(out[k].count() for k in ("review", "awareness", "archive")) == out["summaries"].count() == 1


def test_second_run_adds_nothing(spark, tables):
    first = weekly.run(tables, S)
    items = spark.createDataFrame(first["items"].collect(), first["items"].schema)
    again = weekly.run(tables | {"items": items}, S)
    assert again["new_items"].count() == 0 and again["items"].count() == items.count()


def test_adapters_and_reports(spark, tables, tmp_path):
    found = html.adapt(html.links(tables["pages"]), adapters.rules(spark, {"a.com": "announcement"})).collect()
    assert {r["url"].rsplit("/", 1)[1] for r in found} == {"kobi-kart-kampanyasi", "kobi-kart-kampanyasi-2"} and {r["score"] for r in found} == {18}
    page = spark.createDataFrame([(1, '<script>{"announcementList": [{"title": "Duyuru", "date": "2026-05-01"}], "x": 1}</script>')], "page_id long, html string")
    assert [tuple(r) for r in adapters.embedded(page, "announcementList", "title string, date string").collect()] == [(1, "Duyuru", "2026-05-01")]
    press = spark.createDataFrame([(1, "/a", "12 Mayıs 2026"), (1, "/a", "Yeni bir basın bülteni"), (1, "/b", "1.1.2026")], "page_id long, href string, anchor string")
    assert [(r["href"], r["title"], str(r["date"])) for r in adapters.grouped_press(press).collect()] == [("/a", "Yeni bir basın bülteni", "2026-05-12")]
    img = spark.createDataFrame([("/img/120526-x.png",), ("/up/2026/05/a.png",), ("/a.png",)], "u string")
    assert [str(r[0]) for r in img.select(adapters.asset_date("u")).collect()] == ["2026-05-12", "2026-05-01", "None"]
    assert "| 1 | a\\|b |" in report.markdown(spark.createDataFrame([(1, "a|b")], "i int, s string"), "T")
    p = f"file://{tmp_path}/t"
    tables["registry"].write.parquet(p)
    report.reset(spark, p, f"file://{tmp_path}/old")
    assert spark.read.parquet(p).count() == 0 and spark.read.parquet(f"file://{tmp_path}/old").count() == 2
