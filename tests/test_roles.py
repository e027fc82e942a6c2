"""Literal cases of roles, gazetteers, lookups and title scores."""

import pytest
from pyspark.sql import functions as F

from sparkvane.operators import similar
from sparkvane.plans import classify, roles


@pytest.mark.parametrize(
    ("owner", "title", "mode", "want"),
    [
        ("another", "konut kredisi", "both", ("Bağımsız Gelişme", "legacy_institution_default")),
        ("hsbc", "global insights", "both", ("Kapsam Dışı", "hsbc_global_content_without_turkiye_evidence")),
        ("hsbc", "global insights KOBİ türkiye", "both", ("Bağımsız Gelişme", "explicit_sme_signal:KOBİ")),
        ("turk_ticaret_bankasi", "ihracat şubesi hizmete açıldı", "both", ("Bağımsız Gelişme", "exporter_branch_channel_expansion")),
        ("turk_ticaret_bankasi", "genel kurul ihracat şubesi açıldı", "both", ("Bağımsız Gelişme", "exporter_branch_channel_expansion")),
        ("turk_ticaret_bankasi", "genel kurul ihracat", "both", ("Kapsam Dışı", "legal_event_or_operational_noise")),
        ("turk_ticaret_bankasi", "finansal sonuç eximbank", "both", ("Yönetici Bilgilendirme", "financial_results_with_export_finance_evidence")),
        ("t_bank", "finansal sonuç eximbank", "both", ("Bağlamsal Veri", "financial_report_without_segment_evidence")),
        ("turkish_bank", "group haberi", "both", ("Kapsam Dışı", "group_level_without_turkiye_or_bank_entity_evidence")),
        ("odeabank", "finansal sonuç", "both", ("Kapsam Dışı", "no_explicit_sme_signal_in_local_title_path_or_body")),
        ("odeabank", "genel kurul", "both", ("Kapsam Dışı", "operational_or_retail_noise_without_sme_signal")),
        ("odeabank", "tüketici araştırması", "both", ("Bağlamsal Veri", "consumer_or_general_research_context_only")),
        ("enpara", "bir metin", "Benchmark_Fact", ("Benchmark Bilgisi", "benchmark_fact_source")),
        ("odeabank", "ödül esnaf", "both", ("Yönetici Bilgilendirme", "product_or_commercial_award:explicit_sme_signal:esnaf")),
        ("odeabank", "ödül", "both", ("Kapsam Dışı", "generic_award_without_commercial_relevance")),
    ],
)
def test_content_role(spark, owner, title, mode, want):
    role = roles.content_role(F.lit(owner), F.lit(mode), F.lit("https://x/y"), F.lit(title), F.lit(""))
    assert tuple(spark.range(1).select(role.alias("r")).first()["r"]) == want


def test_first_evidence_of_the_gate(spark):
    """The path speaks before the title, the institution before both, the source before the body."""
    said = lambda *named: spark.range(1).select(roles.content_role(F.lit("fibabanka"), F.lit("both"), F.lit("https://x/esnaf/haber"), F.lit("kobi paketi"), F.lit("ihracat"), *map(F.lit, named)).alias("r")).first()["r"]["role_reason"]
    assert said() == said("Fibabanka", "ticari haberler", "basın") == "explicit_sme_signal:esnaf"
    assert said("Ticari Bank") == "explicit_sme_signal:Ticari"
    late = roles.content_role(F.lit("fibabanka"), F.lit("both"), F.lit("https://x/haber"), F.lit("paket"), F.lit("ihracat"), F.lit("b"), F.lit("esnaf sayfası"))
    assert spark.range(1).select(late.alias("r")).first()["r"]["role_reason"] == "explicit_sme_signal:esnaf"


@pytest.mark.parametrize(("title", "want"), [("tekil gelişme kontrol sayfası başlığı", "bad_fallback_title"), ("A long enough Fallback title here", "bad_fallback_title"), ("devamını oku", "title_too_short"), ("a title of over twenty letters", "acceptable")])
def test_bad_titles_of_any_length(spark, title, want):
    got = classify.quality(F.lit(title), F.lit("x" * 400), F.lit("i"), F.lit("s"), F.lit("m"))
    assert spark.range(1).select(got.alias("q")).first()["q"]["quality_reason"] == want


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(roles.small_business_gate(F.lit("yeni Esnaf paketi"))["reason"]) == "explicit_sme_signal:Esnaf"
    assert one(roles.named_entities(F.lit("Visa ile Stripe ve visa"), ["stripe", "visa", "wise"])) == "stripe; visa"
    assert one(roles.first_named(F.lit("wise and visa"), ["visa", "wise"])) == "visa"
    assert one(roles.without_dates_and_calls(F.lit("New card May 12, 2026 5 min read Read more"))) == "New card"
    assert one(roles.pack_decision(F.lit(False), F.lit("API lansmanı"), "api", "ödül")) == "approve" and one(roles.pack_decision(F.lit(False), F.lit("x"), "api", "ödül")) == "research"
    assert one(roles.tagged(F.lit("a:1; fact:F-1;x"), "fact", F.lit("F-1"))) and not one(roles.tagged(F.lit("fact:F-12"), "fact", F.lit("F-1")))


def test_lookups_layers_and_title_scores(spark):
    d = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int")
    by_a = spark.createDataFrame([(1, "x"), (2, "")], "a int, v string")
    by_b = spark.createDataFrame([(10, "y"), (20, "z")], "b int, w string")
    assert sorted((r["a"], r["f"]) for r in roles.first_of_lookups(d, [(by_a, "a", "v"), (by_b, "b", "w")], "f").collect()) == [(1, "x"), (2, "z"), (3, None)]
    items = spark.createDataFrame([("token card", "T1"), ("card", "T2"), ("x", "T3")], "blob string, title string")
    got = roles.layer_preview(items, [("cards", "card"), ("tokens", "token")], "blob", "title").collect()
    assert sorted((r["bucket"], r["n"], r["titles"]) for r in got) == [("cards", 2, "T1; T2"), ("tokens", 1, "T1")]
    t = spark.createDataFrame([("New Card", "new card", ["card", "bank"]), ("a", "", [])], "e string, c string, k array<string>")
    assert [r["score"] for r in similar.title_match(t, "e", "c", "k").collect()] == [0.825, 0.0]


@pytest.mark.parametrize("name", ["content_roles", "network_signals"])
def test_rules_on_a_small_file_run_in_many_tasks(spark, sf, name):
    from sparkvane.plans import catalog

    assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
