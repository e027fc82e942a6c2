"""Figures of the boards: pricing, offers, initiatives, research, payloads, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import arrays, dates, ids, money
from sparkvane.functions.text import clean, contains_any, count_of, first_sentences, fold, occurrences, sentences, squeeze, text, tokens
from sparkvane.operators.rows import mode, pick
from sparkvane.operators.similar import greedy_clusters
from sparkvane.plans.cascade import first_match
from sparkvane.plans.classify import fee_bucket


# --- pricing -------------------------------------------------------------------------------


def priced(fees: DataFrame) -> DataFrame:
    free_text = F.concat_ws(" ", *[text(c) for c in ("fee_family", "fee_item", "product_or_channel", "fee_basis", "notes")])
    return fees.withColumns({"bucket": fee_bucket("fee_family", free_text), "amount": money.amount("fee_value"), "rate": money.percentage("fee_value"), "free": money.is_free("fee_value")})


def acquiring_rate() -> Column:
    """The rate of a card-present acquiring fee for newly won merchants; null for other rows."""
    t = fold(F.concat_ws(" ", *[text(c) for c in ("fee_family", "fee_item", "fee_basis", "product_or_channel")]))
    card = contains_any(t, ["kredi kart", "credit card", "card-present", "card payment", "merchant", "acquiring"])
    home = F.trim(F.coalesce(F.col("market_scope"), F.lit("Türkiye"))) == "Türkiye"
    new = t.contains("yeni kazanım") & t.contains("kredi kart") & t.contains("peşin") & ~t.contains("sektör")
    return F.when((F.col("bucket") == "POS") & card & (~home | new), F.col("rate"))


def pricing_figures(fees: DataFrame) -> DataFrame:
    p = priced(fees)
    return p.agg(F.countDistinct("institution_name").alias("institutions"), F.count("*").alias("points"), F.count_if("free").alias("free"), F.min(acquiring_rate()).alias("best_rate"), F.max(dates.any_format("update_date")).alias("checked"))


def best_fees(fees: DataFrame) -> DataFrame:
    """Ids of the cheapest fee of each bucket, all of equal ones; free counts as zero."""
    p = priced(fees).withColumn("v", F.when(F.col("free"), 0.0).otherwise(F.coalesce("rate", "amount")))
    least = p.groupBy("bucket").agg(F.min("v").alias("v"))
    return p.join(least, ["bucket", "v"]).select("bucket", "fee_id")


# --- offers --------------------------------------------------------------------------------


def offer_figures(offers: DataFrame, today: Column) -> DataFrame:
    return offers.agg(
        F.count_if(dates.offer_active(F.col("status"), dates.any_format("valid_until"), today)).alias("active"),
        F.count_if(fold(clean("dob_required")) == "evet").alias("onboarding"),
        F.count_if(fold("offer_type").contains("faizsiz")).alias("interest_free"),
        F.count_if(clean("fee_waiver") != "").alias("fee_waivers"),
        F.max(dates.any_format("last_checked")).alias("checked"),
    )


def refresh_offers(offers: DataFrame, checks: DataFrame, today: Column, run_id: str) -> DataFrame:
    """Offers with refreshed status and the results of the url checks (source_url, http_status, error)."""
    c = checks.select("source_url", F.col("http_status").alias("_h"), F.col("error").alias("_e"))
    joined = offers.join(c, "source_url", "left")
    ok = F.when(F.col("_h").between(200, 399), "Başarılı").when(F.col("_h").isNotNull() | (clean("_e") != ""), "Hata")
    return joined.withColumns(
        {
            "status": dates.offer_status(F.col("status"), dates.any_format("valid_until"), today),
            "last_http_status": F.col("_h").cast("string"),
            "last_check_status": ok,
            "last_check_error": F.when(ok == "Hata", F.coalesce("_e", F.concat(F.lit("HTTP "), F.col("_h").cast("string")))),
            "last_check_run_id": F.when(ok.isNotNull(), F.lit(run_id)),
        }
    ).drop("_h", "_e")


def offer_order() -> list[Column]:
    rank = F.when(F.col("status") == "Aktif", 3).when(F.col("status") == "Yakında bitecek", 2).when(F.col("status") == "Süresi doldu", 0).otherwise(1)
    return [rank.desc(), dates.any_format("valid_until").asc_nulls_last(), F.asc("institution_name")]


# --- initiatives ---------------------------------------------------------------------------


def initiative_bucket() -> Column:
    c, t = text("ai_category"), text("initiative_type")
    return (
        F.when((c == "KOBİ AI Çözümü") | (t == "SaaS / İş Birliği"), "KOBİ & SaaS")
        .when(c == "Müşteri Asistanı", "Müşteri AI")
        .when((c == "Pazarlama & Deneyim") | (t == "AI Kampanyası"), "Pazarlama")
        .when(c.isin("Çalışan Verimliliği", "Risk & Operasyon"), "İç Kullanım")
        .when(c == "Ekosistem & Girişimcilik", "Ekosistem")
        .otherwise("Yönetişim")
    )


def initiative_cards(initiatives: DataFrame) -> DataFrame:
    """Per institution: counts by use, and the initiative that matters most to small business."""
    order = F.when(F.col("sme_relevance") == "Yüksek", 0).when(F.col("sme_relevance") == "Orta", 1).when(F.col("sme_relevance") == "Dolaylı", 2).when(F.col("sme_relevance") == "Düşük", 3).otherwise(4)
    return initiatives.groupBy("institution_name").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sme_relevance") == "Yüksek").alias("small_business"),
        F.count_if(F.col("delivery_model").isin("Banka ürünü", "Platform entegrasyonu")).alias("customer"),
        F.count_if(F.col("delivery_model") == "İç kullanım").alias("internal"),
        F.min_by("initiative_name", F.struct(order, F.col("initiative_id"))).alias("highlight"),
    )


# --- research ------------------------------------------------------------------------------


def rank_sources(rows: DataFrame, terms: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(url, score): https urls by the occurrences of the topic's terms in their rows, the best row of each."""
    blob = F.concat_ws(" ", *[text(c) for c in columns])
    score = sum((occurrences(blob, t) for t in terms), F.lit(0))
    return rows.where(text("url").startswith("https://")).groupBy("url").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "url")


def review_cells(cells: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cells (finding, criterion, …) that verdicts (position, finding, criterion) keep.

    A verdict names known findings; only its first mention of a finding counts, and of its
    criteria only the label before a colon, and only known ones.
    """
    known = cells.select("finding").distinct()
    label = F.trim(F.substring_index("criterion", ":", 1))
    named = verdicts.join(known, "finding", "left_semi").withColumn("criterion", label)
    valid = named.join(cells.select("finding", "criterion"), ["finding", "criterion"], "left_semi")
    first = valid.groupBy("finding").agg(F.min("position").alias("position"))
    kept = valid.join(first, ["finding", "position"]).select("finding", "criterion").distinct()
    return cells.join(kept, ["finding", "criterion"], "left_semi")


def brief(topic: str, institutions: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """One row with the research brief; institutions by market and tier."""
    listed = institutions.groupBy("market", "tier").agg(F.array_join(F.array_sort(F.collect_set("institution_name")), ", ").alias("names"))
    line = F.concat_ws(" / ", "market", "tier")
    body = F.array_join(F.array_sort(F.collect_list(F.concat(line, F.lit(": "), F.col("names")))), "\n")
    return listed.agg(F.concat(F.lit(f"{topic}\n{', '.join(criteria)}\n"), body).alias("brief"))


# --- facts and payloads --------------------------------------------------------------------

# fixed values: words of the fact areas, in the order in which they decide
FACT_AREAS = (
    ("Ödemeler ve POS", ("sanal pos", "pos", "kartlı ödeme", "ödeme")),
    ("KOBİ Kredileri", ("kredi", "finansman", "limit")),
    ("KOBİ Mevduat", ("mevduat", "hesap", "vadeli", "vadesiz")),
    ("Dijital KOBİ Yolculuğu", ("mobil", "internet", "dijital", "başvuru")),
)


def facts(documents: DataFrame, key: str, body: str, k: int = 5, areas=FACT_AREAS) -> DataFrame:
    """The first k distinct sentences of 45 to 420 characters that belong to an area, with the area."""
    each = documents.select(key, F.posexplode(F.split(text(body), r"(?<=\.)\s+|\n+")).alias("at", "s")).withColumn("fact_text", squeeze("s"))
    area = first_match([(contains_any("fact_text", w), {"a": name}) for name, w in areas], {"a": F.lit(None).cast("string")})["a"]
    kept = each.withColumn("product_area", area).where(F.length("fact_text").between(45, 420) & F.col("product_area").isNotNull())
    once = pick(kept, [key, "fact_text"], [F.asc("at")])
    return pick(once, [key], [F.asc("at")], k).select(key, ids.identifier("fact", key, "fact_text").alias("fact_id"), "product_area", "fact_text")


def payload(allowed: dict[str, Sequence[str]], fallback: dict[str, str], title: str, institution: str) -> dict[str, Column]:
    """Columns of a summary from a model's raw ones: coerced values, cut texts, deterministic fallbacks."""
    out = {c: arrays.coerce_value(c, list(values), fallback[c]) for c, values in allowed.items()}
    or_else = lambda c, d: F.when(clean(c) != "", clean(c)).otherwise(d)
    out["headline"] = F.substring(squeeze(or_else("headline", F.concat(clean(institution), F.lit(": "), clean(title)))), 1, 120)
    for c, n in (("summary", 2), ("core_assessment", 1), ("strategic_relevance", 2)):
        out[c] = first_sentences(or_else(c, F.lit(fallback.get(c, ""))), n)
    return out


# --- clusters ------------------------------------------------------------------------------

# fixed values: words of the cluster patterns, and how many of them an item needs
CLUSTER_PATTERNS = (
    ("commercial_card_campaigns", 2, ("ticari kart", "ticari kredi kart", "ticari bankamatik", "maximum business", "maxipuan", "yurt dışı harcama", "yurt disi harcama", "maximum")),
    ("pos_okc_device_finance", 1, ("pos", "ökc", "okc", "mobil ökc", "cihaz", "ingenico", "paygo", "hugin", "üye işyeri", "uye isyeri", "taksit")),
    ("esg_sustainability_finance", 1, ("sürdürülebilirlik", "esg", "atık su", "atik su", "çevre", "yeşil finansman", "leasing", "enerji verimliliği", "arıtma")),
)
STOP = ("ve", "ile", "icin", "için", "bir", "yeni", "özel", "kampanyası", "kampanya", "bankası", "turkiye", "türkiye")


def clusters(items: DataFrame, days: int = 45, key: str = "recent_item_id") -> DataFrame:
    """Clusters of two or more dated items of an institution: by patterns within ``days``, then by shared words.

    One row per cluster with its id, bounds, members and modes of theme and product.
    """
    words = F.concat_ws(" ", *[clean(c) for c in ("item_title", "headline", "summary", "core_assessment")])
    dated = items.withColumn("_d", F.coalesce(dates.any_format("recency_basis_date"), dates.any_format("normalized_item_date"))).where("_d IS NOT NULL")
    dated = dated.withColumns({"_inst": clean("institution_name"), "_text": words})
    hits = F.array(*[F.when(count_of("_text", w) >= n, F.lit(name)) for name, n, w in CLUSTER_PATTERNS])
    member = dated.select("_inst", key, "_d", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_key"))
    span = member.groupBy("_inst", "_key").agg(F.count("*").alias("n"), F.datediff(F.max("_d"), F.min("_d")).alias("span")).where(f"n >= 2 AND span <= {days}")
    patterned = member.join(span.select("_inst", "_key"), ["_inst", "_key"], "left_semi").select("_inst", "_key", key)
    rest = dated.join(patterned.select(key).distinct(), key, "left_anti").select(key, "_inst", "_d", tokens("_text", 4, STOP).alias("_t"))
    like = greedy_clusters(rest.withColumn("_o", F.col("_d")), "_inst", key, "_t", "_o")
    greedy = like.select(F.col("block").alias("_inst"), F.concat(F.lit("keyword_overlap:"), F.col("cluster").cast("string")).alias("_key"), F.col("id").alias(key))
    members = patterned.unionByName(greedy).join(dated.select(key, "_d", "item_title", "strategic_theme", "product_area"), key)
    ids_ = F.array_sort(F.collect_list(F.col(key).cast("string")))
    agg = members.groupBy("_inst", "_key").agg(ids_.alias("_ids"), F.count("*").alias("item_count"), F.min("_d").alias("cluster_start_date"), F.max("_d").alias("cluster_end_date"))
    for c in ("strategic_theme", "product_area"):
        agg = agg.join(mode(members, ["_inst", "_key"], c).select("_inst", "_key", F.col("mode").alias(c)), ["_inst", "_key"])
    name = F.substring_index("_key", ":", 1)
    cid = ids.identifier("cluster", "_inst", name, F.array_join("_ids", ","))
    return agg.select(cid.alias("cluster_id"), F.col("_inst").alias("institution_name"), name.alias("pattern"), "item_count", F.to_json("_ids").alias("item_ids"), "cluster_start_date", "cluster_end_date", "strategic_theme", "product_area")


def covered(summaries: DataFrame, cluster_queue: DataFrame, key: str = "recent_item_id") -> DataFrame:
    """Summaries with the cluster that covers them, if one does."""
    m = cluster_queue.select("cluster_id", F.col("review_status").alias("cluster_status"), F.explode(arrays.id_list("item_ids")).alias(key))
    m = pick(m, [key], [F.asc("cluster_id")])
    return summaries.drop("cluster_id", "cluster_status", "covered_by_cluster").join(m, key, "left").withColumn("covered_by_cluster", F.col("cluster_id").isNotNull())


def executive_reason(a: str, b: str) -> Column:
    """At most two sentences of two texts that do not repeat each other."""
    from sparkvane.functions.text import repeats

    every = F.concat(F.coalesce(sentences(a), F.array()), F.coalesce(sentences(b), F.array()))
    kept = F.aggregate(every, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) >= 2) | F.exists(acc, lambda o: repeats(s, o)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(kept, " ")
