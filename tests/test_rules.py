"""Literal cases of the rule cascades."""

import pytest
from pyspark.sql import functions as F

from sparkvane.plans import boards, classify, feed, health, lint, lints, network, recency, sourcing, triage
from sparkvane.plans.cascade import all_reasons, first_match, first_reason


def row(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def test_cascade_order_and_nulls(spark):
    n = F.lit(None).cast("boolean")
    d = spark.range(1)
    assert d.select(first_match([(n, {"a": 1}), (F.lit(True), {"a": 2}), (F.lit(True), {"a": 3})], {"a": 4})["a"]).first()[0] == 2
    assert d.select(first_reason([(n, "x"), (F.lit(False), "y")])).first()[0] == ""
    assert d.select(all_reasons([(F.lit(True), "x"), (n, "y"), (F.lit(True), "z")])).first()[0] == ["x", "z"]


H = {"status": "fetched", "code": 200, "length": 2000, "candidates": 3, "failures": 0, "method": "static_scrape", "mode": "weekly_development", "seen": "2026-06-01"}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "Sağlıklı"),
        ({"failures": 3}, "Hatalı"),
        ({"candidates": 0}, "Uyarı"),
        ({"method": "browser_required"}, "Manuel Kontrol Gerekli"),
        ({"code": 503}, "Uyarı"),
        ({"code": 503, "failures": 2}, "Hatalı"),
        ({"status": "error"}, "Uyarı"),
        ({"length": 50}, "Hatalı"),
        ({"failures": 1}, "Uyarı"),
        ({"seen": "2026-01-01"}, "Uzun Süredir Güncellenmedi"),
        ({"code": 0}, "Uyarı"),
        ({"status": ""}, "Uyarı"),
    ],
)
def test_source_health(spark, change, want):
    d = row(spark, **{**H, **change})
    c = F.col
    h = health.source_health(status=c("status"), code=c("code"), length=c("length"), candidates=c("candidates"), failures=c("failures"), last_seen=c("seen").cast("date"), method=c("method"), mode=c("mode"), now=F.lit("2026-06-29").cast("date"))
    assert d.select(h["status"]).first()[0] == want


DATES = dict.fromkeys(("publication_date", "announcement_date", "campaign_start_date", "recency_basis_date", "normalized_item_date", "campaign_end_date"), "") | {"date_confidence": "Yüksek"}


@pytest.mark.parametrize(
    ("change", "recent", "active"),
    [
        ({"campaign_end_date": "2026-12-31"}, False, True),
        ({"campaign_start_date": "2022-04-01", "campaign_end_date": "2026-12-31"}, False, True),
        ({"publication_date": "2026-05-12"}, True, False),
        ({"publication_date": "2026-05-12", "date_confidence": "Düşük"}, False, False),
        ({}, False, False),
        ({"publication_date": "x"}, False, False),
        ({"recency_basis_date": "2026-12-31", "campaign_end_date": "2026-12-31"}, False, True),
        ({"campaign_start_date": "2026-05-02", "campaign_end_date": "2026-12-31"}, True, True),
    ],
)
def test_recency(spark, change, recent, active):
    r = row(spark, **(DATES | change)).select(recency.evaluate("2026-05-01").alias("r")).first()["r"]
    assert (r["is_recent"], r["is_active_campaign"]) == (recent, active)


def test_recency_flags(spark):
    undated = row(spark, **DATES).select(recency.evaluate(allow_undated=True)["is_recent"]).first()[0]
    end = row(spark, **(DATES | {"campaign_end_date": "2026-12-31"})).select(recency.evaluate(allow_end_date=True)["is_recent"]).first()[0]
    assert undated and end


def test_date_semantics(spark):
    def of(visible, source_type="Basın"):
        d = row(spark, v=visible, u="", l="", m="", i="", s=source_type)
        return recency.add_date_semantics(d, "v", "u", "l", "m", "i", "s", "r").first()["r"]

    assert str(of("Duyuru 12 Mayıs 2026")["publication_date"]) == "2026-05-12"
    r = of("Kampanya 1-15 Mayıs 2026 arasında", "Kampanya")
    assert (str(r["campaign_start_date"]), str(r["campaign_end_date"]), r["event_date_type"]) == ("2026-05-01", "2026-05-15", "Kampanya Başlangıç Tarihi")
    r = of("Kampanya 31.12.2026 tarihine kadar geçerlidir", "Kampanya")
    assert (r["campaign_start_date"], str(r["campaign_end_date"]), r["date_source"]) == (None, "2026-12-31", "campaign_end_date")
    assert of("2026 ilk çeyrek")["date_source"] == "missing"


@pytest.mark.parametrize(
    ("title", "url", "source", "want"),
    [
        ("KOBİ kart kampanyası", "https://x/kampanyalar/1", "", "Kampanya"),
        ("Yeni ortaklık imzalandı", "https://x/a", "", "İş Birliği"),
        ("Softpos lansman", "https://x/a", "", "Ürün / Özellik Gelişmesi"),
        ("BDDK yönetmelik", "https://x/a", "", "Regülasyon"),
        ("Konser sponsorluk", "https://x/a", "", "Sosyal Sorumluluk / PR"),
        ("Şube ve atm", "https://x/sube", "", "Statik Ürün Sayfası"),
        ("Pazar endeksi yayınlandı endeks", "https://x/a", "", "Rapor / Araştırma"),
        ("Bir metin", "https://x/a", "Basın odası", "Basın Bülteni"),
        ("Bir metin", "https://x/a", "", "Belirsiz"),
    ],
)
def test_development(spark, title, url, source, want):
    d = row(spark, t=title, b="", u=url, s=source)
    assert d.select(classify.development("t", "b", "u", "s")["development_candidate_type"]).first()[0] == want


S = dict.fromkeys("relevance_status impact_on_us importance_level recommended_action strategic_theme development_type confidence_level content_role headline item_title summary core_assessment review_status".split(), "")


@pytest.mark.parametrize(
    ("change", "lane"),
    [
        ({"review_status": "Reddedildi", "impact_on_us": "Yüksek"}, "archive"),
        ({"headline": "Türkiye'nin en iyi bankası ödül", "recommended_action": "Yönetici Bilgilendirme Notuna Ekle"}, "awareness"),
        ({"impact_on_us": "Orta"}, "review"),
        ({"impact_on_us": "Düşük", "importance_level": "Düşük"}, "archive"),
        ({"headline": "öğrenci müze"}, "archive"),
        ({}, "review"),
        ({"suppress": True}, "none"),
        ({"content_role": "Yönetici Bilgilendirme"}, "awareness"),
    ],
)
def test_lanes(spark, change, lane):
    assert row(spark, **(S | {"suppress": False} | change)).select(triage.route()).first()[0] == lane


def test_suppression(spark):
    base = S | {"covered_by_cluster": "True", "cluster_status": "Küme İncelemede", "impact_on_us": "Orta", "recommended_action": "İzle", "development_type": "Kampanya", "product_area": ""}
    rule = triage.suppressed(["Yönetime Eskale Et"], ["İzle"], ["tcmb"], ["maxipuan"])
    of = lambda **c: row(spark, **(base | c)).select(rule).first()[0]
    assert of() and not of(impact_on_us="Yüksek") and not of(cluster_status="") and not of(headline="TCMB kararı") and of(headline="TCMB maxipuan") and not of(recommended_action="Yönetime Eskale Et")


def test_run_status_and_alerts(spark):
    zero = dict.fromkeys("stage_failures sources_failed changed_sources new_items summaries review_additions awareness_additions archive_additions cluster_additions candidates duplicates model_calls".split(), 0)
    def of(alerts=False, **c):
        m = {k: F.lit(v) for k, v in ({**zero, "sources_checked": 2, "unchanged_sources": 2, "sources_succeeded": 2} | c).items()}
        mean = {k: F.lit(10.0) for k in ("candidates", "review_additions", "model_calls")}
        return spark.range(1).select(health.final_status(m, F.lit(False), F.lit(False), F.lit(alerts)), health.alerts(m, mean)).first()

    assert of()[0] == "Başarılı — Değişiklik Yok"
    assert of(unchanged_sources=1, changed_sources=1, new_items=1)[0] == "Başarılı"
    assert of(sources_failed=1)[0] == "Kısmi Başarılı" and of(alerts=True, new_items=1)[0] == "Kısmi Başarılı"
    assert of(candidates=31, changed_sources=1)[1] == ["candidate_volume"]
    assert of(changed_sources=1)[1] == ["no_candidates"]
    assert of(candidates=10, duplicates=7, archive_additions=10)[1] == ["duplicate_share", "archive_share"]


def test_registry_lint(spark):
    cols = "source_id institution_id institution_name url active collection_method collector_capability extraction_mode mvp_active claude_eligible weekly_collection_enabled monitoring_mode".split()
    rows = [("1", "a", "A", "https://x/a", "True", "manual", "c", "", "", "", "", ""), ("1", "a", "A", "https://www.x/a/", "", "", "", "", "True", "True", "False", ""), ("2", "", "B", "", "True", "static_scrape", "", "", "", "True", "", "blocked_source_watch")]
    got = {(r["source_id"], r["issue_type"], r["severity"]) for r in lints.registry(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))).collect()}
    assert got == {("1", "duplicate_source_id", "error"), ("1", "duplicate_canonical_url", "warning"), ("1", "manual_source_skipped_from_automation", "warning"), ("1", "mvp_active_weekly_disabled", "error"), ("2", "invalid_institution_alias", "error"), ("2", "active_missing_collector_capability", "warning"), ("2", "eligible_without_mvp", "error"), ("2", "blocked_source_enters_weekly", "error")}


def test_language_lint(spark):
    r = row(spark, t="Bu adım önem arz ediyor ve gereklidir; ürün sunulmaktadır. Bu kapsamında").select(lint.full("t").alias("r")).first()["r"]
    assert r["score"] == 3 + 3 + (2 + 3) + 1 and r["needs_rewrite"] and len(r["warnings"]) == 5


def test_network_signals(spark):
    m = network.Market(own=r"\bown bank\b", competitors=r"(rival bank)", home=r"(türkiye|turkey)", bank="Own Bank", network="Net")
    def of(title, date="2026-06-01", url="https://n.com/news/x-2026"):
        d = row(spark, t=title, u=url, b="").withColumn("d", F.lit(date).cast("date"))
        return d.select(network.classify(m, "t", "u", "b", F.col("d"), "2026-05-01").alias("r")).first()["r"]

    r = of("Own Bank launches token card for merchants")
    assert (r["signal"], r["relevance"], r["layer"], r["destination"]) == ("Doğrudan Own Bank Sinyali", "Kritik", "Tokenizasyon", "Stratejik / BD Gündemi")
    assert of("Own Bank card", "2020-01-01")["role"] == "Bağlamsal Veri"
    assert of("Rival Bank commercial card")["signal"] == "Türkiye Rakip Banka Uygulaması"
    assert of("Football sponsorship")["rejection"] == "brand_lifestyle_or_consumer_noise"
    assert of("Weather", None, "https://n.com/x")["accepted"] == "False"


def test_source_selection_and_gate(spark):
    cols = "source_id institution_id institution_name source_type active mvp_active collection_method extraction_mode monitoring_mode weekly_collection_enabled"
    base = ["a", "A Bank", "Duyuru", "True", "True", "static_scrape", "both", "", ""]
    rows = [("1", *base), ("2", *base[:7], "blocked_source_watch", ""), ("3", *base[:3], "Evet", *base[4:]), ("4", *base[:5], "manual", *base[6:]), ("5", "z", "Z", *base[2:])]
    d = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    got = lambda f="": {r["source_id"] for r in sourcing.eligible(d, ["A BANK"], ["Duyuru"], f).collect()}
    assert got() == {"1", "3"} and got("4") == {"1", "3", "4"}
    item = DATES | {"publication_date": "2026-05-12", "normalized_item_date": "2026-05-12", "source_active": "True", "source_mvp_active": "True", "source_claude_eligible": "", "item_quality": "Good", "item_url": "https://x/1", "source_url": "https://x", "registry_source_url": "", "canonical_item_url": "", "content_role": "", "development_candidate_type": "Kampanya", "is_actual_development": "True", "actual_development_reason": "", "extraction_method": "detail"}
    gate = lambda **c: row(spark, **(item | c)).select(sourcing.summary_gate("2026-05-01")).first()[0]
    assert gate() == "" and gate(source_active="") == "kaynak active=True değil" and gate(item_url="https://x") == "item_url source_url ile aynı" and gate(item_quality="Poor").startswith("item_quality")


def test_boards(spark):
    fees = spark.createDataFrame([("1", "A", "POS", "%2,49"), ("2", "B", "POS", "%1,99"), ("3", "B", "Havale", "0 TL"), ("4", "C", "Kart aidat", "1.250 TL"), ("5", "C", "POS", "%1,99")], "fee_id string, institution_name string, fee_family string, fee_value string")
    fees = fees.select("*", *[F.lit(v).alias(k) for k, v in (("fee_item", "kredi kart peşin yeni kazanım"), ("product_or_channel", ""), ("fee_basis", ""), ("notes", ""), ("market_scope", "Türkiye"), ("update_date", "2026-06-01"))])
    r = boards.pricing_figures(fees).first()
    assert (r["institutions"], r["points"], r["free"], r["best_rate"], str(r["checked"])) == (3, 5, 1, 1.99, "2026-06-01")
    assert {(x["bucket"], x["fee_id"]) for x in boards.best_fees(fees).collect()} == {("POS", "2"), ("POS", "5"), ("Yurt içi transfer", "3"), ("Kartlar", "4")}
    docs = spark.createDataFrame([(1, "Kısa pos. " + "Sanal POS ile ödeme alan üye işyerleri için yeni bir çözüm. " * 2 + "Mobil başvuru ile hesap açma süreci tamamen dijital hale geldi burada.")], "doc_id int, body string")
    assert [(x["product_area"]) for x in boards.facts(docs, "doc_id", "body").collect()] == ["Ödemeler ve POS", "KOBİ Mevduat"]
    cells = spark.createDataFrame([(0, "Fiyat", "v"), (0, "Süre", "w"), (1, "Fiyat", "x")], "finding int, criterion string, value string")
    verdicts = spark.createDataFrame([(0, 0, "Fiyat: %50"), (1, 0, "Süre"), (2, 7, "Fiyat"), (3, 1, "Yok")], "position int, finding int, criterion string")
    assert [tuple(x) for x in boards.review_cells(cells, verdicts).collect()] == [(0, "Fiyat", "v")]


def test_clusters(spark):
    cols = "recent_item_id institution_name item_title headline summary core_assessment recency_basis_date normalized_item_date strategic_theme product_area"
    rows = [
        ("1", "A", "Ticari kart maxipuan", "", "", "", "2026-05-01", "", "K", "P"),
        ("2", "A", "Maximum ticari kart", "", "", "", "2026-05-20", "", "K", "P"),
        ("3", "A", "taksit cihaz", "", "", "", "2026-01-01", "", "K", "P"),
        ("4", "A", "POS cihaz", "", "", "", "2026-06-01", "", "K", "P"),
        ("5", "B", "dijital onboarding platform servis", "", "", "", "", "2026-05-01", "T", "P"),
        ("6", "B", "dijital onboarding platform hizmet", "", "", "", "", "2026-05-02", "T", "Q"),
        ("7", "B", "dijital onboarding platform undated", "", "", "", "", "", "T", "Q"),
    ]
    got = boards.clusters(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))).collect()
    assert sorted((r["institution_name"], r["pattern"], r["item_count"], r["item_ids"]) for r in got) == [("A", "commercial_card_campaigns", 2, '["1","2"]'), ("B", "keyword_overlap", 2, '["5","6"]')]
    assert all(r["cluster_id"].startswith("CL-") for r in got)


def test_feed(spark):
    items = spark.createDataFrame([("1", "A", "s", "u1", "u1", "T1", "2026-05-01", ""), ("2", "A", "s", "u2", "u2", "T2", "", "2026-05-03")], "recent_item_id string, institution_name string, source_id string, canonical_item_url string, item_url string, item_title string, item_date string, detected_at string")
    summaries = spark.createDataFrame([("1", "S1", "x")], "recent_item_id string, summary_id string, created_at string")
    queue = spark.createDataFrame([("1", "Beklemede", "S1", "R1", "A", "s", "u1", "T1")], "recent_item_id string, review_status string, summary_id string, review_id string, institution_name string, source_id string, item_url string, item_title string")
    none = queue.limit(0)
    u = {r["recent_item_id"]: (r["status"], str(r["date_dt"])) for r in feed.unified(items, summaries, queue, none, none, none).collect()}
    assert u == {"1": ("İncelemede", "2026-05-01"), "2": ("Henüz Özetlenmedi", "2026-05-03")}
    previous = spark.createDataFrame([("1", "2026-01-01", "old")], "recent_item_id string, first_seen_at string, first_run_id string")
    archive = queue.withColumn("recent_item_id", F.lit("9"))
    seen = {r["recent_item_id"]: (r["current_status"], r["first_seen_at"], r["first_run_id"]) for r in feed.seen_index(previous, items, summaries, queue, none, archive, none, "run", "now").collect()}
    assert seen == {"1": ("Beklemede", "2026-01-01", "old"), "2": ("Keşfedildi", "now", "run"), "9": ("Arşivlendi", "now", "run")}
    done = feed.decide(queue, spark.createDataFrame([("R1", "approve"), ("R9", "x")], "review_id string, decision string"), "now", "me").first()
    assert (done["review_status"], done["reviewer"]) == ("Onaylandı", "me")
    approved = queue.select("recent_item_id", "summary_id")
    once = feed.publish(approved.limit(0).withColumn("development_id", F.lit("")), approved, "x", "now")
    assert once.count() == 1 and feed.publish(once, approved, "x", "later").count() == 1


def test_guarded_patterns_count_as_the_patterns_alone(spark):
    from pyspark.sql import functions as F

    words = ["yapmaktadır", "YAPMAKTADIR", "yapmaktadir", "YAPMAKTADİR", "maktadır", "maktadırlar", "gereklidir", "GEREKLİDİR", "gere\u212al\u0131dir", "bulunmaktadır", "\u017funulmaktadır", "açısından", "AÇISINDAN", "müştdilde", "ifade edilmektedir", "olmalıdır"]
    d = spark.createDataFrame([(" ".join(words[i:j]),) for i in range(len(words)) for j in (i + 1, len(words))] + [("",), (None,)], "t string")
    patterns = [p for p, _, _ in lint.PATTERNS] + [rf"\b{f}\b" for f in lint.FILLERS]
    alone = [F.regexp_count(F.coalesce("t", F.lit("")), F.lit("(?iuU)" + p)) for p in patterns]
    got = d.select(F.array(*[lint.found(lint.readings("t"), p) for p in patterns]).alias("a"), F.array(*alone).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and all(any(r["b"][i] for r in got) for i in range(4))


def test_the_lint_folds_a_text_once(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(lint.full("t").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") <= 2


def test_development_seeks_words_in_one_plain_reading(spark):
    """Signals are what the patterns alone find, in any letters; a pattern runs over the text only where gaps ask for it."""
    from pyspark.sql import functions as F

    from sparkvane.functions.text import contains_plain, literal_words, plain

    literal = [p for p in (*classify.PATTERNS.values(), classify.SOCIAL, classify.SMALL_BUSINESS) if p not in classify.ASKED]
    words = sorted({w for p in literal for w in p.strip("()").split("|")})
    turns = (str, str.upper, str.title, lambda w: w.replace("i", "İ").replace("s", "ſ").replace("k", "K"), lambda w: w.replace("i", "ı"), lambda w: w[1:])
    d = spark.createDataFrame([(f"x\n{f(w)}y",) for w in words for f in turns] + [("",)], "t string")
    found, alone = F.array(*[contains_plain(plain("t"), literal_words(p)) for p in literal]), F.array(*[F.rlike("t", F.lit("(?iuU)" + p)) for p in literal])
    assert all(literal_words(p) for p in literal) and d.where(~found.eqNullSafe(alone)).count() == 0
    assert literal_words(classify.GREEN_FINANCE) == [] and literal_words(r"\bpos\b") == [] and literal_words("(softpos|pos)") == ["pos"]
    rows = spark.createDataFrame([(1, "YİL", "YEŞİL bir KREDİ"), (2, "x", "yeşil\nkredi"), (3, "x", "sürdürülebilir yeni swap"), (4, "konser", "yeşil tahvil"), (5, "konser", "x"), (6, None, None), (7, "x", "Kampanya")], "i int, t string, b string")
    got = {r.i: r.k.development_candidate_type for r in rows.select("i", classify.development("t", "b", F.lit("https://a.org/x").alias("u"), F.lit("liste")).alias("k")).collect()}
    green, social, none = classify.KINDS[6][2], classify.KINDS[1][2], classify.UNCLEAR[0]
    assert got == {1: green, 2: none, 3: green, 4: green, 5: social, 6: none, 7: "Kampanya"}
    plan = rows.select(classify.development("t", "b", "t", "b").alias("k"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("RLIKE") <= 4
