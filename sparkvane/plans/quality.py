"""Reports on the language of what is shown, scans for terms, and the synthesis of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.functions import arrays
from sparkvane.functions.text import clean, fold, matches, occurrences, squeeze, text
from sparkvane.operators.rows import once
from sparkvane.plans import lint

# fixed values: phrases that a report counts, forms that it sums, and English values that stand in controlled columns
REPORTED = (
    "gereklidir", "edilmelidir", "değerlendirilmelidir", "bulunmamaktadır", "sunmaktadır", "göstermektedir", "hedeflemektedir", "teşkil etmektedir", "önem arz etmektedir",
    "doğrudan rakip bir hamle", "değer yaratma potansiyeli", "açısından", "kapsamında", "müştdilde",
)
FORMAL_SUFFIX = r"\b\w+(?:maktadır|mektedir)\b"
OBLIGATION = r"\b(?:gereklidir|edilmelidir|değerlendirilmelidir)\b"
ENGLISH_VALUES = (
    "High", "Medium", "Low", "Monitor", "Respond", "Copy / Adapt", "Ignore", "Escalate to Leadership", "Add to BD Talking Points", "Campaign", "Product Launch", "Partnership", "Market Signal",
    "Payments & POS", "SME Lending", "Cash Management",
)
CONTROLLED = ("strategic_theme", "product_area", "development_type", "impact_on_us", "recommended_action", "importance_level", "confidence_level")
ACTIONS = (
    "İzle", "Yanıt Geliştir", "İş Birliği Fırsatını İncele", "Uyarlama Fırsatını Değerlendir", "Önceliklendirme", "Yönetime Eskale Et", "BD Konuşma Notlarına Ekle", "Yönetici Bilgilendirme Notuna Ekle",
)
LEVELS = ("Yüksek", "Orta", "Düşük")
#: Columns of a synthesis, and how many characters of them stay.
SYNTHESIS = {"cluster_title": 140, "cluster_summary": 400, "cluster_core_assessment": 420, "why_it_matters": 500, "competitor_intent": 400, "management_takeaway": 400}
#: A line of a cluster's text has at least so many characters, which bounds the lines that a budget can hold.
SHORTEST_ITEM = 60


def language_report(rows: DataFrame, worst: int = 10) -> DataFrame:
    """(section, name, value, detail) of rows (file, id, title, text): totals, phrases that occur, and the worst rows.

    One pass sums everything; its single row is unpivoted. Empty texts are not scanned; the worst rows are those
    of the highest score, then by file and id, with their titles and warnings.
    """
    t = text("text")
    shown = rows.where(clean("text") != "").select("file", "id", F.substring(text("title"), 1, 160).alias("title"), t.alias("text"))
    counted = {"formal_suffixes": FORMAL_SUFFIX, "obligations": OBLIGATION}
    shown = once(shown.select("file", "id", "title", *(c.alias("_" + n) for n, c in lint.readings("text").items())))
    t = {n: F.col("_" + n) for n in ("text", "folded", "plain")}
    counts = {n: lint.found(t, p) for n, p in counted.items()}
    scored = once(shown.select("file", "id", "title", lint.full(t).alias("lint"), *(c.alias(n) for n, c in counts.items()), F.array(*[occurrences(t["folded"], p, folded=True) for p in REPORTED]).alias("phrases")))
    flags = [F.count("*").alias("rows_scanned"), F.count_if("lint.needs_review").alias("needs_review"), F.count_if("lint.needs_rewrite").alias("needs_rewrite"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts)]
    sums = scored.agg(*flags, *(F.coalesce(F.sum(F.col("phrases")[i]), F.lit(0)).alias(f"phrase_{i}") for i in range(len(REPORTED))))
    long = sums.unpivot([], [F.col(c).cast("long").alias(c) for c in sums.columns], "name", "value")
    number = F.regexp_extract("name", r"^phrase_(\d+)$", 1).try_cast("int")
    totals = long.where(number.isNull()).select(F.lit("total").alias("section"), "name", "value", F.lit("").alias("detail"))
    phrases = long.where(number.isNotNull() & (F.col("value") > 0)).select(F.lit("phrase").alias("section"), F.element_at(F.array(*map(F.lit, REPORTED)), number + 1).alias("name"), "value", F.lit("").alias("detail"))
    bad = scored.where("lint.score > 0").orderBy(F.desc("lint.score"), "file", "id").limit(worst)
    bad = bad.select(F.lit("worst").alias("section"), F.concat_ws(" ", "file", F.col("id").cast("string")).alias("name"), F.col("lint.score").cast("long").alias("value"), F.concat_ws(": ", "title", F.array_join("lint.warnings", "; ")).alias("detail"))
    return totals.unionByName(phrases).unionByName(bad)


def controlled_counts(df: DataFrame, columns: Sequence[str] = CONTROLLED, values: Sequence[str] = ENGLISH_VALUES) -> DataFrame:
    """(column, n): how often a column that should hold controlled values holds one of ``values``; columns that are missing are left out."""
    there = [c for c in columns if c in df.columns]
    counted = df.agg(*(F.count_if(text(c).isin(*values)).alias(c) for c in there))
    return counted.unpivot([], there, "column", "n")


def term_scan(texts: DataFrame, terms: Sequence[str], allowed: Sequence[str] = (), allowed_files: str = "") -> DataFrame:
    """(file, line_no, term, line, acceptable): the terms that occur in each line of texts (file, text), with case.

    Every term counts by itself, also where one lies within another. A finding is acceptable if the line, alone or
    behind the file's name, has an allowed pattern, or if the file's name has ``allowed_files``.
    """
    body = F.regexp_replace(text("text"), "^﻿", "")
    lines = texts.select("file", F.posexplode(F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n")).alias("at", "raw"))
    hits = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("raw"), t))
    ok = matches("file", allowed_files, False) if allowed_files else F.lit(False)
    for p in allowed:
        ok = ok | F.col("raw").rlike(p) | F.concat_ws(":", "file", "raw").rlike(p)
    return lines.select("file", (F.col("at") + 1).alias("line_no"), F.explode(hits).alias("term"), F.trim("raw").alias("line"), ok.alias("acceptable"))


def item_line(title: str, date: str, theme: str, product: str, summary: str, assessment: str, url: str) -> Column:
    """An item as it stands in the text of its cluster."""
    short = lambda c: F.substring(squeeze(c), 1, 800)
    return F.concat(
        F.lit("- Başlık: "), short(title), F.lit("\n  Tarih: "), short(date), F.lit("\n  Tema/ürün: "), short(theme), F.lit(" / "), short(product),
        F.lit("\n  Özet: "), short(summary), F.lit("\n  Kısa değerlendirme: "), short(assessment), F.lit("\n  URL: "), short(url),
    )


def cluster_texts(items: DataFrame, cluster: str, order: Sequence[str], line: Column, budget: int = 24_000) -> DataFrame:
    """(cluster, text, n_items, n_left): the lines of a cluster's items in order, as many as fit the budget.

    Only as many rows of a cluster as could fit are sorted, the rest are counted; an item that does not fit ends the text.
    """
    most = budget // SHORTEST_ITEM + 1
    w = W.partitionBy(cluster).orderBy(*order)
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(cluster, "_n", line.alias("_line"))
    upto = F.sum(F.length("_line") + 1).over(W.partitionBy(cluster).orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
    fits = first.withColumn("_upto", upto - 1).where(F.col("_upto") <= budget)
    texts = fits.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias("text"), F.count("*").alias("n_items"))
    all_ = items.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("_all"))
    out = all_.join(texts, cluster, "left")
    n = F.coalesce("n_items", F.lit(0))
    return out.select(cluster, F.coalesce("text", F.lit("")).alias("text"), n.cast("long").alias("n_items"), (F.col("_all") - n).alias("n_left"))


def synthesised(clusters: DataFrame, responses: DataFrame, singletons: bool = False, force: bool = False) -> DataFrame:
    """Clusters with the fields of a synthesis, from model responses (cluster_id, response).

    Due are clusters of two or more items without a synthesis. A response that is no JSON, or none, leaves the
    deterministic payload; values out of the controlled ones fall back to the cluster's own; texts are cut.
    """
    due = F.lit(force) | (clean("why_it_matters") == "")
    due = due if singletons else due & (F.coalesce(F.col("item_count").try_cast("double"), F.lit(0)) >= 2)
    fields = [*SYNTHESIS, "recommended_action", "impact_on_us", "importance_level", "confidence_level"]
    body = arrays.object_text("response")
    read = F.from_json(body, ", ".join(f"{c} string" for c in fields) + ", extracted_facts array<string>")
    said = F.when(F.try_parse_json(body).isNotNull(), read)
    joined = once(clusters.join(responses.select("cluster_id", said.alias("_said")), "cluster_id", "left").withColumn("_due", due))
    own = {c: text(c) for c in ("cluster_title", "cluster_summary", "cluster_core_assessment")}
    own |= {"why_it_matters": F.lit("Küme sentezi için analist kontrolü gerekli."), "competitor_intent": F.lit("Henüz model tarafından sentezlenmedi."), "management_takeaway": text("cluster_core_assessment")}
    new = {c: F.substring(squeeze(F.when(text(f"_said.{c}") != "", F.col(f"_said.{c}")).otherwise(own[c])), 1, n) for c, n in SYNTHESIS.items()}
    for c, values in (("recommended_action", ACTIONS), ("impact_on_us", LEVELS), ("importance_level", LEVELS), ("confidence_level", LEVELS)):
        default = {"recommended_action": "İzle", "confidence_level": "Düşük"}.get(c, "Orta")
        kept = F.coalesce(F.col(c), F.lit(default)) if c in clusters.columns else F.lit(default)
        new[c] = F.when(clean(f"_said.{c}").isin(*values), clean(f"_said.{c}")).otherwise(kept)
    facts = F.coalesce("_said.extracted_facts", arrays.json_list("item_titles") if "item_titles" in clusters.columns else F.array().cast("array<string>"))
    error = F.when(F.col("_said").isNull(), "no usable response").otherwise("")
    keep = [c for c in clusters.columns if c not in new]
    judged = once(joined.where("_due").select(*keep, *(v.alias(c) for c, v in new.items()), F.to_json(facts).alias("extracted_facts_json"), error.alias("error_message")))
    return once(judged.withColumn("_lint", lint.full(F.concat_ws(" ", *SYNTHESIS)))).select(*judged.columns, F.col("_lint.score").alias("language_lint_score"), F.col("_lint.needs_review").alias("needs_language_review"))
