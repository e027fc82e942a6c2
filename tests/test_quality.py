"""Language reports, term scans, cluster texts and synthesis over small tables."""

import json

from sparkvane.plans import quality


def test_report_totals_phrases_and_worst_rows(spark):
    rows = [("a.csv", 1, "T1", "Ödeme açısından bulunmaktadır"), ("a.csv", 2, "T2", "düz metin"), ("b.csv", 1, "x" * 200, "teşkil etmektedir ve edilmelidir"), ("b.csv", 2, None, "  "), ("b.csv", 3, "T", None)]
    out = {(r.section, r.name): (r.value, r.detail) for r in quality.language_report(spark.createDataFrame(rows, "file string, id int, title string, text string")).collect()}
    totals = {n: v for (s, n), (v, _) in out.items() if s == "total"}
    assert totals == {"rows_scanned": 3, "needs_review": 2, "needs_rewrite": 2, "formal_suffixes": 2, "obligations": 1}
    assert {n: v for (s, n), (v, _) in out.items() if s == "phrase"} == {"açısından": 1, "edilmelidir": 1, "teşkil etmektedir": 1}
    worst = {n: d for (s, n), (_, d) in out.items() if s == "worst"}
    assert set(worst) == {"a.csv 1", "b.csv 1"} and worst["b.csv 1"].startswith("x" * 160 + ": ") and "Pasif rapor dili (+3)" in worst["a.csv 1"]
    empty = quality.language_report(spark.createDataFrame([], "file string, id int, title string, text string")).collect()
    assert {r.name: r.value for r in empty} == dict.fromkeys(totals, 0)


def test_controlled_counts(spark):
    df = spark.createDataFrame([("High", "x"), ("Orta", "High"), (None, "Low")], "impact_on_us string, importance_level string")
    assert {r["column"]: r.n for r in quality.controlled_counts(df).collect()} == {"impact_on_us": 1, "importance_level": 2}


def test_terms_in_lines_against_brute_force(spark):
    files = [("a.py", "import Review\nSave the Review  \r\nx https://s/Save\n\nReviewed"), ("b.md", "﻿Source: Review Source"), ("skip.py", "Save"), ("n", None)]
    terms, allowed = ("Review", "Reviewed", "Source", "Save"), (r"^\s*(?:from|import)\s+", "https?://", r"b\.md:.*Source:")
    import re

    want = []
    for name, body in files:
        for i, line in enumerate((body or "").lstrip("﻿").splitlines(), 1):
            want += [(name, i, t, line.strip(), name == "skip.py" or any(re.search(p, line) or re.search(p, f"{name}:{line}") for p in allowed)) for t in terms if t in line]
    got = quality.term_scan(spark.createDataFrame(files, "file string, text string"), terms, allowed, r"^skip\.py$")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cluster_texts_keep_to_their_budget(spark):
    rows = [("c", i, "t" * 100) for i in range(40)] + [("one", 1, "u" * 5000), (None, 1, "x")]
    df = spark.createDataFrame(rows, "c string, i int, t string")
    line = quality.item_line("t", "c", "c", "c", "c", "c", "c")
    got = {r.c: r for r in quality.cluster_texts(df.withColumn("t", df.t), "c", ["i"], line, 1000).collect()}
    each = len(got["c"].text.split("\n- ")[0])
    assert got["c"].n_items == (1000 + 1) // (each + 1) and got["c"].n_items + got["c"].n_left == 40 and len(got["c"].text) <= 1000
    assert got["one"].n_items == 1 and set(got) == {"c", "one"}  # a field is cut at 800 characters, so it fits


def test_synthesis(spark):
    cols = "cluster_id string, item_count string, why_it_matters string, cluster_title string, cluster_summary string, cluster_core_assessment string, impact_on_us string, item_titles string"
    rows = [("a", "2", "", "A", "s", "core", "Yüksek", '["x","y"]'), ("b", "3", " ", "B", "s", "core", None, ""), ("c", "1", "", "C", "", "", "", ""), ("d", "5", "done", "D", "", "", "", ""), ("e", "2", None, "E", "", "", "Orta", "z")]
    said = {"cluster_title": "New", "why_it_matters": "w" * 600, "impact_on_us": "Çok", "recommended_action": "Yanıt Geliştir", "extracted_facts": ["f"]}
    responses = [("a", "```json\n" + json.dumps(said, ensure_ascii=False) + "\n```"), ("b", "{broken")]
    df = spark.createDataFrame(rows, cols)
    got = {r.cluster_id: r for r in quality.synthesised(df, spark.createDataFrame(responses, "cluster_id string, response string")).collect()}
    assert set(got) == {"a", "b", "e"}
    a, b = got["a"], got["b"]
    assert (a.cluster_title, len(a.why_it_matters), a.impact_on_us, a.recommended_action, a.importance_level, a.extracted_facts_json, a.error_message) == ("New", 500, "Yüksek", "Yanıt Geliştir", "Orta", '["f"]', "")
    assert (b.cluster_title, b.impact_on_us, b.confidence_level, b.error_message, b.extracted_facts_json) == ("B", "Orta", "Düşük", "no usable response", "[]") and b.why_it_matters.startswith("Küme sentezi")
    assert got["e"].extracted_facts_json == '["z"]' and a.needs_language_review is False
    every = quality.synthesised(df, spark.createDataFrame([], "cluster_id string, response string"), singletons=True, force=True)
    assert every.count() == 5


def test_reasons_of_developments(spark):
    from pyspark.sql import functions as F

    from sparkvane.plans import classify

    cases = [
        (("Login sayfası", "", "https://a.org/x", "liste"), (False, "Statik Ürün Sayfası")),
        (("Login sayfası kampanya", "", "https://a.org/x", "Basın"), (True, "Kampanya")),
        (("Yeni kredi", "", "https://a.org/bireysel-bankacilik/krediler/x", ""), (False, "Statik Ürün Sayfası")),
        (("Konser", "", "https://a.org/x", ""), (False, "Sosyal Sorumluluk / PR")),
        (("Esnaf konseri", "yeni bir metin", "https://a.org/x", ""), (False, "Belirsiz")),
        (("Yeşil tahvil", "", "https://a.org/x", ""), (True, "Ürün / Özellik Gelişmesi")),
        (("Sade", "x" * 5001 + "kampanya", "https://a.org/x", "Haberler"), (True, "Basın Bülteni")),
        (("Sade", "", "https://a.org/duyuru", ""), (True, "Haber")),
        ((None, None, None, None), (False, "Belirsiz")),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "t string, b string, u string, s string")
    got = [r.k for r in df.select(classify.development("t", "b", "u", "s").alias("k")).collect()]
    assert [(k.is_actual_development, k.development_candidate_type) for k in got] == [w for _, w in cases]
    why = {(a, n): r for _, a, n, r in classify.KINDS if n != "Ürün / Özellik Gelişmesi"}
    assert all(k.actual_development_reason == why.get((k.is_actual_development, k.development_candidate_type), k.actual_development_reason) for k in got)
    assert got[5].actual_development_reason.startswith("Sürdürülebilir finansman") and got[-1].actual_development_reason.startswith("Yeni kampanya, ürün")
    places = [("Kartlar", "paracard aidatsız", 2), ("POS", "x", 3), ("Paket / Kredi", "SWIFT paketi", 2), ("Yurt dışı / SWIFT", "aynı gün", 2), ("Başka", "x", None)]
    rows = spark.createDataFrame(places, "b string, t string, p int")
    assert all(r.p == r.g for r in rows.withColumn("g", classify.fee_place(F.col("b"), F.col("t"))).collect())
