"""Queries on sourcing, gates, boards, feed and clusters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvane.functions import dates, translate
from sparkvane.operators import rows
from sparkvane.plans import boards, feed, health, network, recency, roles, sourcing
from sparkvane.plans.q_text import stem_sql
from sparkvane.plans.registry import query, table
from sparkvane.sources import html


def registry(spark, sf):
    """supplier as a source registry."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return s.select(
        k.cast("string").alias("source_id"),
        F.col("n_nationkey").cast("string").alias("institution_id"),
        F.col("n_name").alias("institution_name"),
        F.col("s_name").alias("source_name"),
        F.when(k % 4 == 0, "Duyuru").otherwise("Haber").alias("source_type"),
        F.when(k % 5 == 0, "False").otherwise("True").alias("active"),
        F.when(k % 3 == 0, "").otherwise("yes").alias("mvp_active"),
        F.when(k % 7 == 0, "manual").otherwise("Static_Scrape").alias("collection_method"),
        F.when(k % 2 == 0, "both").otherwise("weekly_development").alias("extraction_mode"),
        F.when(k % 11 == 0, "blocked_source_watch").otherwise("").alias("monitoring_mode"),
        F.lit("").alias("weekly_collection_enabled"),
        F.lit("").alias("validation"),
    )


_ELIGIBLE = "s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 4 = 0 AND (n_name IN ('FRANCE', 'GERMANY', 'CHINA') OR n_nationkey = 3)"


@query("eligible_sources", f"SELECT CAST(s_suppkey AS VARCHAR) AS source_id, n_name AS institution_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE {_ELIGIBLE} OR s_suppkey = 5")
def eligible_sources(spark, sf):
    return sourcing.eligible(registry(spark, sf), ["France", "GERMANY", "china", "3"], ["Duyuru"], "5").select("source_id", "institution_name")


@query(
    "fresh_documents",
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'fetched' END AS status, event_id % 3 AS c FROM events)
       SELECT user_id AS source_id, event_id AS document_id FROM e WHERE c <> 0 AND user_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
)
def fresh_documents(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("document_id"), F.col("ts").alias("fetched_at"), F.when(F.col("event_type") == "error", "error").otherwise("fetched").alias("status"), F.when(F.col("event_id") % 3 == 0, "unchanged").when(F.col("event_id") % 3 == 1, "changed").otherwise("new_source").alias("change_status"))
    reg = e.select("source_id").distinct().select("source_id", F.when(F.col("source_id") % 2 == 0, "Duyuru").otherwise("x").alias("source_type"), F.lit("both").alias("extraction_mode"), F.lit("i").alias("institution_name"), F.lit("i").alias("institution_id"), F.lit("s").alias("source_name"))
    return sourcing.fresh_documents(e, reg, ["Duyuru"]).select("source_id", "document_id")


@query(
    "summary_gate",
    """WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS act, doc_id % 3 AS q, doc_id % 5 = 0 AS same, doc_id % 7 = 0 AS role, DATE '2026-04-25' + CAST(doc_id % 20 AS INT) AS day FROM documents)
       SELECT doc_id, CASE WHEN NOT act THEN 'kaynak active=True değil' WHEN q = 0 THEN 'item_quality uygun değil: Poor' WHEN same THEN 'item_url source_url ile aynı' WHEN role THEN 'content_role uygun değil: Kapsam Dışı'
         WHEN day < DATE '2026-05-01' THEN 'Kesim tarihinden eski: ' || strftime(day, '%Y-%m-%d') || ' < 2026-05-01' ELSE '' END AS reason FROM d""",
)
def summary_gate(spark, sf):
    k = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2026-04-25").cast("date"), (k % 20).cast("int")), "yyyy-MM-dd")
    none = F.lit("")
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.when(k % 2 == 0, "True").otherwise("").alias("source_active"),
        F.lit("1").alias("source_mvp_active"),
        none.alias("source_claude_eligible"),
        F.when(k % 3 == 0, "Poor").otherwise("Good").alias("item_quality"),
        F.when(k % 5 == 0, "s").otherwise("i").alias("item_url"),
        F.lit("s").alias("source_url"),
        *[none.alias(c) for c in ("registry_source_url", "canonical_item_url", "extraction_method", "actual_development_reason", "announcement_date", "campaign_start_date", "campaign_end_date", "recency_basis_date")],
        F.when(k % 7 == 0, "Kapsam Dışı").otherwise("").alias("content_role"),
        F.lit("Kampanya").alias("development_candidate_type"),
        F.lit("True").alias("is_actual_development"),
        F.lit("Yüksek").alias("date_confidence"),
        day.alias("publication_date"),
        day.alias("normalized_item_date"),
    )
    return d.select("doc_id", sourcing.summary_gate("2026-05-01").alias("reason"))


@query("problem_sources", "SELECT CAST(s_suppkey AS VARCHAR) AS source_id FROM supplier WHERE s_suppkey % 5 <> 0 AND (s_suppkey % 6 = 0 OR s_suppkey % 13 = 0)")
def problem_sources(spark, sf):
    r = registry(spark, sf).withColumns({"h": F.when(F.col("source_id").cast("int") % 6 == 0, "Hatalı").otherwise("Sağlıklı"), "validation": F.when(F.col("source_id").cast("int") % 13 == 0, "Needs review").otherwise("ok")})
    return r.where(sourcing.problem_source(F.col("h"), "validation")).select("source_id")


@query("next_source_ids", "SELECT r_name AS url, 'REG-' || lpad(CAST((SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_name) AS VARCHAR), 3, '0') AS source_id FROM region")
def next_source_ids(spark, sf):
    have = table(spark, sf, "nation").select(F.concat(F.lit("REG-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0")).alias("source_id"))
    return sourcing.next_ids(table(spark, sf, "region").select(F.col("r_name").alias("url")), have).select("url", "source_id")


@query(
    "date_semantics",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Yayın Tarihi' WHEN 1 THEN 'Kampanya Başlangıç Tarihi' ELSE 'Kampanya Bitiş Tarihi' END AS event_date_type,
         CAST(o_orderdate AS DATE) AS recency_basis_date, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + 10 WHEN o_orderkey % 3 = 2 THEN CAST(o_orderdate AS DATE) END AS campaign_end_date FROM orders""",
)
def date_semantics(spark, sf):
    d, e = F.date_format("o_orderdate", "d.M.yyyy"), F.date_format(F.date_add(F.to_date("o_orderdate"), 10), "d.M.yyyy")
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, F.concat(F.lit("Duyuru "), d)).when(k == 1, F.concat(F.lit("Kampanya "), d, F.lit(" - "), e)).otherwise(F.concat(F.lit("Kampanya "), d, F.lit(" tarihine kadar geçerlidir")))
    o = table(spark, sf, "orders").select("o_orderkey", body.alias("v"), *[F.lit("").alias(c) for c in ("u", "l", "m", "i", "s")])
    return recency.add_date_semantics(o, "v", "u", "l", "m", "i", "s", "r").select("o_orderkey", "r.event_date_type", "r.recency_basis_date", "r.campaign_end_date")


def fees(spark, sf):
    """part as a pricing matrix."""
    k = F.col("p_partkey")
    value = F.when(k % 9 == 0, "Ücretsiz").when(k % 2 == 0, F.concat(F.lit("%"), F.col("p_size").cast("string"), F.lit(",50"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" TL")))
    family = F.when(k % 4 == 0, "POS").when(k % 4 == 1, "Havale").when(k % 4 == 2, "SWIFT").otherwise("Kart")
    return table(spark, sf, "part").select(k.alias("fee_id"), F.col("p_brand").alias("institution_name"), family.alias("fee_family"), F.lit("kredi kart peşin yeni kazanım").alias("fee_item"), F.lit("").alias("product_or_channel"), F.lit("").alias("fee_basis"), F.lit("").alias("notes"), value.alias("fee_value"), F.lit("Türkiye").alias("market_scope"), F.lit("2026-06-01").alias("update_date"))


@query(
    "pricing_kpis",
    """SELECT count(DISTINCT p_brand) AS institutions, count(*) AS points, count(*) FILTER (p_partkey % 9 = 0) AS free, CAST(min(p_size + 0.5) FILTER (p_partkey % 4 = 0 AND p_partkey % 9 <> 0) AS DOUBLE) AS best_rate, DATE '2026-06-01' AS checked FROM part""",
)
def pricing_kpis(spark, sf):
    return boards.pricing_figures(fees(spark, sf))


@query(
    "best_fees_with_ties",
    """WITH f AS (SELECT p_partkey AS fee_id, CASE p_partkey % 4 WHEN 0 THEN 'POS' WHEN 1 THEN 'Yurt içi transfer' WHEN 2 THEN 'Yurt dışı / SWIFT' ELSE 'Kartlar' END AS bucket,
         CASE WHEN p_partkey % 9 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN p_size + 0.5 ELSE p_size END AS v FROM part)
       SELECT bucket, fee_id FROM f QUALIFY rank() OVER (PARTITION BY bucket ORDER BY v) = 1""",
)
def best_fees_with_ties(spark, sf):
    return boards.best_fees(fees(spark, sf))


@query(
    "offer_kpis",
    """SELECT count(*) FILTER (o_orderstatus = 'O' AND (o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1996-01-01')) AS active, count(*) FILTER (o_orderkey % 4 = 0) AS onboarding,
         count(*) FILTER (o_orderpriority = '1-URGENT') AS interest_free, count(*) FILTER (o_orderkey % 3 = 0) AS fee_waivers, max(CAST(o_orderdate AS DATE)) AS checked FROM orders""",
)
def offer_kpis(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "Aktif").otherwise("Belirsiz").alias("status"),
        F.when(k % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("valid_until"),
        F.when(k % 4 == 0, "Evet").otherwise("").alias("dob_required"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "FAİZSİZ avans").when(F.col("o_orderpriority") == "2-HIGH", "x").otherwise("").alias("raw"),
        F.when(k % 3 == 0, " var ").otherwise(" ").alias("fee_waiver"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_checked"),
    )
    o = o.withColumn("offer_type", F.when(F.col("raw") == "FAİZSİZ avans", "Faizsiz avans").otherwise(F.col("raw")))
    return boards.offer_figures(o, F.lit("1996-01-01").cast("date"))


@query(
    "offer_refresh",
    """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-06-01' THEN 'Süresi doldu' WHEN o_orderstatus = 'F' THEN 'Aktif' ELSE 'Belirsiz' END AS status FROM orders""",
)
def offer_refresh(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Süresi doldu").otherwise("").alias("s"), F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", dates.offer_status(F.col("s"), F.col("d"), F.lit("1995-06-01").cast("date")).alias("status"))


@query(
    "initiative_cards",
    """SELECT p_brand AS institution_name, count(*) AS n, count(*) FILTER (p_size % 4 = 0) AS small_business, count(*) FILTER (p_partkey % 3 = 0) AS customer, count(*) FILTER (p_partkey % 3 = 1) AS internal, arg_min(p_name, (p_size % 4, p_partkey)) AS highlight FROM part GROUP BY p_brand""",
)
def initiative_cards(spark, sf):
    s, m = F.col("p_size") % 4, F.col("p_partkey") % 3
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("institution_name"),
        F.col("p_partkey").alias("initiative_id"),
        F.col("p_name").alias("initiative_name"),
        F.when(s == 0, "Yüksek").when(s == 1, "Orta").when(s == 2, "Dolaylı").otherwise("Düşük").alias("sme_relevance"),
        F.when(m == 0, "Banka ürünü").when(m == 1, "İç kullanım").otherwise("Partner SaaS").alias("delivery_model"),
    )
    return boards.initiative_cards(p)


@query(
    "initiative_matrix",
    """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN p_size % 6 = 0 OR p_partkey % 10 = 0 THEN 'KOBİ & SaaS' WHEN p_size % 6 = 1 THEN 'Müşteri AI' WHEN p_size % 6 = 2 THEN 'Pazarlama' WHEN p_size % 6 = 3 THEN 'İç Kullanım' WHEN p_size % 6 = 4 THEN 'Ekosistem' ELSE 'Yönetişim' END AS bucket FROM part) GROUP BY bucket""",
)
def initiative_matrix(spark, sf):
    names = F.array(*[F.lit(x) for x in ("KOBİ AI Çözümü", "Müşteri Asistanı", "Pazarlama & Deneyim", "Risk & Operasyon", "Ekosistem & Girişimcilik", "Diğer")])
    p = table(spark, sf, "part").select(F.element_at(names, (F.col("p_size") % 6 + 1).cast("int")).alias("ai_category"), F.when(F.col("p_partkey") % 10 == 0, "SaaS / İş Birliği").otherwise("").alias("initiative_type"))
    return p.groupBy(boards.initiative_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "unified_status_feed",
    """SELECT doc_id, CASE WHEN l.toxic = 1 THEN 'Düşük Öncelik / Arşiv' WHEN l.quality = 1 THEN 'Özetlendi' ELSE 'Henüz Özetlenmedi' END AS status, DATE '2026-05-01' + CAST(doc_id % 30 AS INT) AS date_dt FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def unified_status_feed(spark, sf):
    day = F.date_format(F.date_add(F.lit("2026-05-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    items = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("recent_item_id"), F.when(F.col("doc_id") % 2 == 0, day).otherwise("").alias("item_date"), day.alias("detected_at"))
    labels = table(spark, sf, "labels")
    of = lambda c: labels.where(c).select(F.col("doc_id").cast("string").alias("recent_item_id"), F.lit("").alias("created_at"))
    none = of("false")
    u = feed.unified(items, of("quality = 1"), none, none, of("toxic = 1"), none)
    return u.select(F.col("recent_item_id").cast("long").alias("doc_id"), "status", "date_dt")


@query("weekly_figures", """WITH w AS (SELECT date_trunc('week', ts) AS w, event_type FROM events), m AS (SELECT max(w) AS m FROM w), t AS (SELECT event_type, count(*) AS n FROM w, m WHERE w = m GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3)
  SELECT count(*) FILTER (w = m) AS this_week, count(*) FILTER (w = m - INTERVAL 7 DAY) AS last_week, count(*) FILTER (w = m) - count(*) FILTER (w = m - INTERVAL 7 DAY) AS delta, (SELECT string_agg(event_type, ', ' ORDER BY n DESC, event_type) FROM t) AS top_institutions FROM w, m""")
def weekly_figures(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("institution_name"))
    return feed.weekly_figures(e)


@query("watchlist_top3", "SELECT o_orderkey AS development_id FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 0 END DESC, o_orderdate DESC, o_orderkey LIMIT 3")
def watchlist_top3(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("development_id"),
        F.when(F.col("o_orderstatus") == "F", "Yüksek").when(F.col("o_orderstatus") == "O", "medium").otherwise("Düşük").alias("impact_on_us"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Kritik").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("?").alias("importance_level"),
        F.col("o_orderdate").alias("date"),
    )
    return feed.watchlist(o).select("development_id")


@query("publish_idempotent", "SELECT c_custkey, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 GROUP BY c_custkey")
def publish_idempotent(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("recent_item_id"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("summary_id"), "c_custkey")
    once = feed.publish(c.limit(0).withColumn("development_id", F.lit("")), c.where("c_custkey % 2 = 0"), "x", "t0")
    twice = feed.publish(feed.publish(once, c.where("c_custkey % 3 = 0"), "x", "t1"), c.where("c_custkey % 2 = 0"), "x", "t2")
    return twice.groupBy("c_custkey").agg(F.count("*").alias("n"))


@query(
    "pattern_clusters",
    """WITH m AS (SELECT source, doc_id, DATE '2026-05-01' + CAST(doc_id % 60 AS INT) AS d FROM documents WHERE contains(lower(text), 'taksit') OR contains(lower(text), 'esg'))
       SELECT source AS institution_name, count(*) AS item_count FROM m GROUP BY source HAVING count(*) >= 2 AND max(d) - min(d) <= 45""",
)
def pattern_clusters(spark, sf):
    day = F.date_format(F.date_add(F.lit("2026-05-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")
    low = F.lower("text")
    d = table(spark, sf, "documents").where(low.contains("taksit") | low.contains("esg")).select(
        F.col("doc_id").alias("recent_item_id"), F.col("source").alias("institution_name"), F.lit("taksit").alias("item_title"), *[F.lit("").alias(c) for c in ("headline", "summary", "core_assessment", "normalized_item_date")],
        day.alias("recency_basis_date"), F.lit("t").alias("strategic_theme"), F.lit("p").alias("product_area"),
    )
    return boards.clusters(d).where("pattern = 'pos_okc_device_finance'").select("institution_name", "item_count")


@query("source_facts", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\.\s+', '.' || chr(10), 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\.\s+', '.' || chr(10), 'g'), chr(10)), 1) AS n FROM documents),
  f AS (SELECT doc_id, n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM s), k AS (SELECT * FROM f WHERE length(t) BETWEEN 45 AND 420 AND (contains(lower(t), 'the ') OR contains(lower(t), 'der '))),
  u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY n) = 1)
  SELECT doc_id, t AS fact_text FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 5""")
def source_facts(spark, sf):
    return boards.facts(table(spark, sf, "documents"), "doc_id", "text", areas=(("A", ("the ",)), ("B", ("der ",)))).select("doc_id", "fact_text")


@query("source_ranking", "SELECT 'https://' || p_brand AS url, CAST(max((length(lower(p_type)) - length(replace(lower(p_type), 'o', ''))) + (length(lower(p_name)) - length(replace(lower(p_name), 'a', '')))) AS BIGINT) AS score FROM part GROUP BY 1")
def source_ranking(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("https://"), F.col("p_brand")).alias("url"), F.regexp_replace(F.lower("p_type"), "[^o]", "").alias("a"), F.regexp_replace(F.lower("p_name"), "[^a]", "").alias("b"))
    return boards.rank_sources(p, ["o", "a"], ["a", "b"]).select("url", F.col("score").cast("long").alias("score"))


def cases(table, signals: dict[str, str], field: int, value=lambda v: f"'{v}'") -> str:
    """A rule table as SQL: CASE over the wanted signals, with the values of one field."""
    *rows, last = table
    wanted = lambda w: " AND ".join(f"NOT ({signals[x[1:]]})" if x[0] == "-" else f"({signals[x]})" for x in w.split())
    return "CASE " + " ".join(f"WHEN {wanted(r[0])} THEN {value(r[field])}" for r in rows) + f" ELSE {value(last[field])} END"


def found(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


_MARKET = network.Market(own=r"\bown bank\b", competitors=r"(rival bank)", home=r"(anatolia)", bank="Own Bank", network="Net")
#: Titles that set off each signal, dates before and after the cut-off, and urls with and without weight.
_HEADS = (
    "Own Bank note", "Rival Bank virtual card launch", "anatolia merchant news", "anatolia notes", "europe office", "acquiring and virtual card", "agentic token pilot", "open banking study",
    "research survey", "football festival", "award for b2b working capital", "receivables for suppliers", "cross-border stablecoin settlement", "small business day", "nothing here", "Own Bank fraud award",
)
_URLS = ("https://n.com/newsroom/x", "https://n.com/solutions/", "https://n.com/x")
_DATES = ("2026-06-01", "2026-04-01", "", "June 2026")


def _network_sql() -> str:
    pick = lambda values, by: f"list_extract([{', '.join(repr(v) for v in values)}], CAST({by} % {len(values)} AS INT) + 1)"
    s = {k: found("blob", p) for k, p in network.PATTERNS.items()}
    s |= {"own": found("blob", _MARKET.own), "named": found("blob", _MARKET.competitors), "dated": "day <> ''", "fresh": r"regexp_matches(day, '^20\d{2}-\d{2}-\d{2}$') AND day >= '2026-05-01'", "product_root": found("url", network.PRODUCT_ROOT)}
    s["competitor"] = f"{s['named']} AND NOT {s['own']}"
    s["home"] = f"{found('blob', _MARKET.home)} OR {s['own']} OR {s['named']}"
    s["pressing"] = " OR ".join(s[k] for k in ("merchant", "security", "agentic", "commercial"))
    s["capable"] = " OR ".join(s[k] for k in ("pressing", "open_data", "cross_border", "small"))
    s["noise"] = f"{s['lifestyle']} AND NOT ({s['own']} OR {s['competitor']} OR {s['pressing']})"
    flags = list(s)
    near = [(r[0], *[v.format(bank=_MARKET.bank, network=_MARKET.network) for v in r[1:]]) for r in network.NEAR]
    base = {k: k for k in flags}
    later = base | {"at_home": "scope IN ('Own Bank', 'Türkiye')", "in_scope": "signal <> 'Kapsam Dışı'", "high": f"score >= {network.HIGH}", "worth": f"score >= {network.WORTH}", "evidence": f"{found('url', network.ITEM_PATH)} OR fresh", "proximity": "home OR scope IN ('Own Bank', 'EEMEA')"}
    score = " + ".join([f"CASE WHEN {later[k]} THEN {w} ELSE 0 END" for k, w in network.WEIGHTS.items()] + [f"CASE WHEN transferability = '{k}' THEN {w} ELSE 0 END" for k, w in network.REACH.items()])
    verdicts = ", ".join(f"{cases(network.VERDICTS, later, i)} AS {n}" for i, n in ((1, "role"), (2, "destination"), (3, "accepted"), (4, "rejection")))
    return f"""WITH c AS (SELECT c_custkey, {pick(_HEADS, 'c_custkey')} AS title, {pick(_URLS, 'c_nationkey')} AS url, {pick(_DATES, '(c_custkey // 16)')} AS day FROM customer),
      t AS (SELECT *, title || ' ' || url || ' ' AS blob FROM c), f AS (SELECT *, {', '.join(f'({s[k]}) AS {k}' for k in flags)} FROM t),
      n AS (SELECT *, {', '.join(f'{cases(near, base, i)} AS {x}' for i, x in ((1, 'signal'), (2, 'scope'), (3, 'relevance'), (4, 'transferability')))}, {cases(network.LAYERS, base, 1)} AS layer FROM f),
      v AS (SELECT *, {score} AS score FROM n)
      SELECT c_custkey, signal, layer, scope, CASE WHEN named THEN regexp_extract(blob, '{_MARKET.competitors}', 1, 'i') WHEN own THEN 'Own Bank' ELSE '' END AS partner, CASE WHEN own THEN 'True' ELSE 'False' END AS direct,
        CASE WHEN home THEN 'True' ELSE 'False' END AS home, relevance, transferability, {cases(network.HORIZONS, later, 1)} AS horizon, score, {verdicts} FROM v"""


@query("network_signals", _network_sql())
def network_signals(spark, sf):
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", pick(_HEADS, k).alias("t"), pick(_URLS, F.col("c_nationkey")).alias("u"), F.lit("").alias("b"), pick(_DATES, F.floor(k / 16)).alias("d"))
    return rows.spread(c).select("c_custkey", network.classify(_MARKET, "t", "u", "b", F.col("d"), "2026-05-01").alias("r")).select("c_custkey", "r.*")


_ROLE_HEADS = (
    "genel kurul", "ihracat şubesi hizmete açıldı", "finansal sonuç ve eximbank", "finansal sonuç", "turkishbank group", "tüketici araştırması", "global insights", "ödül", "kobi ödül",
    "esnaf paketi", "konut kredisi kampanyası", "kobi konut kredisi", "bir metin", "ihracat haberi", "local research",
)


def _roles_sql() -> str:
    pick = lambda values, by: f"list_extract([{', '.join(repr(v) for v in values)}], CAST({by} % {len(values)} AS INT) + 1)"
    names = {"scope_out": "SCOPE_OUT", "group": "GROUP", "bank_entity": "BANK_ENTITY", "report": "FINANCIAL_REPORT", "export_evidence": "EXPORT_EVIDENCE", "export": "EXPORT", "opening": "BRANCH_OPENING", "home": "HOME", "abroad": "ABROAD", "context": "CONTEXT_ONLY", "award": "AWARD"}
    s = {k: found("blob", getattr(roles, v)) for k, v in names.items()} | {k: f"owner IN ({', '.join(repr(i) for i in ids)})" for k, ids in roles.OWNERS.items()}
    s |= {"sme": "hit <> ''", "benchmark": "mode = 'benchmark_fact'"}
    gate = "CASE WHEN hit <> '' THEN 'explicit_sme_signal:' || hit ELSE 'no_explicit_sme_signal_in_local_title_path_or_body' END"
    reason = lambda r: f"'{r.removesuffix('{gate}')}' || {gate}" if r.endswith("{gate}") else f"'{r}'"
    owners = (*roles.OWNERS["gated"], "another_bank")
    return f"""WITH p AS (SELECT p_partkey, {pick(owners, 'p_partkey')} AS owner, {pick(('both', 'both', 'benchmark_fact'), '(p_partkey // 11)')} AS mode, {pick(_ROLE_HEADS, '(p_partkey // 7)')} AS title, p_name, p_brand FROM part),
      b AS (SELECT *, trim(title || ' /haber/' || p_partkey || ' ' || p_name) AS blob FROM p),
      g AS (SELECT *, regexp_extract(p_brand || ' /haber/' || p_partkey || ' ' || title || ' ' || p_name, '{roles.SMALL_BUSINESS}', 1, 'i') AS hit FROM b)
      SELECT p_partkey, {cases(roles.ROLES, s, 1)} AS content_role, {cases(roles.ROLES, s, 2, reason)} AS role_reason FROM g"""


@query("content_roles", _roles_sql())
def content_roles(spark, sf):
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_brand", pick((*roles.OWNERS["gated"], "another_bank"), k).alias("owner"), pick(("both", "both", "benchmark_fact"), F.floor(k / 11)).alias("mode"),
        pick(_ROLE_HEADS, F.floor(k / 7)).alias("title"), F.concat(F.lit("https://x/haber/"), k.cast("string")).alias("url"),
    )
    return rows.spread(p).select("p_partkey", roles.content_role("owner", "mode", "url", "title", "p_name", "p_brand").alias("r")).select("p_partkey", "r.*")


_LINK_SIGNALS = {
    "good_length": "length(t) BETWEEN 20 AND 180", "positive": found("blob", html.POSITIVE), "low": f"({found('blob', html.LOW_VALUE)} OR {found('blob', html.LOW_VALUE_RESEARCH)})", "commerce": found("blob", html.COMMERCE), "detail": found("p", html.DETAIL_PATH),
    "listing": found("p", html.LISTING_PATH), "product": found("p", html.PRODUCT_PATH), "press": f"contains(p, '{html.PRESS_PATH}')", "call": "lower(t) IN ('detaylı bilgi', 'detayli bilgi')",
}
_LINK_PATHS = ("/news/", "/haber/", "/kampanyalar/", "/kobi/kartlar/", "/content/public-website/kurumsal-iletisim/", "/kurumsal-iletisim/sanat/", "/odul/")


def _link_sql() -> str:
    met = [(" AND ".join(_LINK_SIGNALS[w] for w in wanted.split()), points, name) for wanted, points, name in html.POINTS]
    total = " + ".join(f"CASE WHEN {c} THEN {points} ELSE 0 END" for c, points, _ in met)
    named = "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, _, name in met) + "] IF x IS NOT NULL], ',')"
    s = _LINK_SIGNALS | {"length_only": "reasons = 'title_length'"}
    table = [("low -commerce", 0, "'low_value_pr_noise'"), ("product -listing -press", 0, "'product_nav'"), ("length_only", 0, "'title_only'"), ("", "total", "reasons")]
    return f"""WITH l AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, list_extract([{', '.join(repr(x) for x in _LINK_PATHS)}], CAST(page_id % {len(_LINK_PATHS)} AS INT) + 1) || CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(page_id AS VARCHAR) END AS p FROM pages),
      b AS (SELECT *, t || ' ' || p AS blob FROM l), r AS (SELECT *, {total} AS total, {named} AS reasons FROM b)
      SELECT page_id, CAST({cases(table, s, 1, str)} AS BIGINT) AS score, {cases(table, s, 2, str)} AS reason FROM r"""


@query("link_score", _link_sql())
def link_score(spark, sf):
    k = F.col("page_id")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in _LINK_PATHS]), (k % len(_LINK_PATHS)).cast("int") + 1), F.when(k % 3 == 0, "").otherwise(k.cast("string")))
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), F.concat(F.lit("https://x"), path).alias("u"))
    return p.select("page_id", html.link_score(F.col("t"), F.col("u")).alias("r")).select("page_id", F.col("r.score").cast("long").alias("score"), F.col("r.reason").alias("reason"))


@query("stemmed_words", f"SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {stem_sql('w')} AS word, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zçğıöşü]+')) AS w FROM documents) GROUP BY w)) WHERE word <> '' GROUP BY word")
def stemmed_words(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zçğıöşü]+)"), F.lit(1))).alias("w"))
    return d.groupBy("w").agg(F.count("*").alias("n")).select(translate.word_stem("w").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"), F.max(F.length("word")).alias("l")).where("l > 0").drop("l")


@query("latest_n_runs", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def latest_n_runs(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id")


@query("open_rows", "SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1")
def open_rows(spark, sf):
    status = F.when(F.col("quality") == 0, "Beklemede").when(F.col("toxic") == 1, "başka").otherwise("Onaylandı")
    return table(spark, sf, "labels").withColumn("review_status", status).where(feed.open_rows()).select("doc_id")


@query("best_per_key_by_score", "SELECT p_brand, arg_max(p_partkey, (p_retailprice, length(p_name), -p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def best_per_key_by_score(spark, sf):
    p = table(spark, sf, "part").withColumns({"l": F.length("p_name"), "o": -F.col("p_partkey")})
    return rows.latest(p, ["p_brand"], "p_retailprice", "l", "o").select("p_brand", "p_partkey")


@query(
    "run_alerts",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)
       SELECT day, array_to_string([x FOR x IN [CASE WHEN c > 60 THEN 'candidate_volume' END, CASE WHEN v * 1.0 / greatest(c, 1) > 0.6 AND c > 0 THEN 'duplicate_share' END] IF x IS NOT NULL], ',') AS alerts FROM d""",
)
def run_alerts(spark, sf):
    e = F.col("event_type")
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(e == "click").alias("c"), F.count_if(e == "view").alias("v"))
    m = dict.fromkeys(("changed_sources", "archive_additions", "review_additions", "awareness_additions", "model_calls"), F.lit(0)) | {"candidates": F.col("c"), "duplicates": F.col("v"), "sources_succeeded": F.lit(1)}
    mean = {"candidates": F.lit(20.0), "review_additions": F.lit(1.0), "model_calls": F.lit(1.0)}
    return d.select("day", F.array_join(health.alerts(m, mean), ",").alias("alerts"))
