"""Queries on rule cascades: recency, classification, lanes, status, lints, queue, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkvane.operators import queue
from sparkvane.plans import classify, health, lints, recency, triage
from sparkvane.plans.registry import query, table
from sparkvane.sources import tables
from sparkvane.streaming import jobs


@query(
    "recency_gate",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k, o_orderkey % 4 AS c FROM orders),
       v AS (SELECT *, CASE WHEN c = 3 THEN 'Düşük' ELSE 'Yüksek' END AS conf, DATE '1995-01-01' AS cut FROM o)
       SELECT o_orderkey, CASE WHEN k = 0 THEN FALSE WHEN conf = 'Düşük' THEN FALSE WHEN k = 1 THEN FALSE WHEN d < cut THEN FALSE ELSE TRUE END AS is_recent,
         CASE WHEN k = 0 THEN 'Tarih yok; varsayılan kapıdan geçmedi' WHEN conf = 'Düşük' THEN 'Düşük tarih güveni: Düşük'
              WHEN k = 1 THEN 'Sadece kampanya bitiş tarihi bulundu; yeni gelişme kanıtı değil'
              WHEN d < cut THEN 'Kesim tarihinden eski: ' || strftime(d, '%Y-%m-%d') || ' < 1995-01-01' ELSE 'Kesim tarihi ve tarih güveni uygun: ' || strftime(d, '%Y-%m-%d') END AS recency_reason,
         CASE WHEN k = 0 THEN FALSE WHEN conf = 'Düşük' THEN FALSE WHEN k = 1 THEN d >= cut ELSE FALSE END AS is_active_campaign FROM v""",
)
def recency_gate(spark, sf):
    d, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 5
    none = F.lit("")
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k > 2, d).otherwise(none).alias("publication_date"),
        none.alias("announcement_date"),
        F.when(k == 2, d).otherwise(none).alias("campaign_start_date"),
        none.alias("recency_basis_date"),
        none.alias("normalized_item_date"),
        F.when(k == 1, d).otherwise(none).alias("campaign_end_date"),
        F.when(F.col("o_orderkey") % 4 == 3, "Düşük").otherwise("Yüksek").alias("date_confidence"),
    )
    return recency.add_recency(o, "1995-01-01", "r").select("o_orderkey", "r.is_recent", "r.recency_reason", "r.is_active_campaign")


_KIND = """CASE WHEN contains(x, 'apache license') THEN 'İş Birliği' WHEN contains(x, 'gnu general') THEN 'Regülasyon' WHEN contains(x, 'rights reserved') THEN 'Rapor / Araştırma' ELSE 'Belirsiz' END"""


@query("classify_cascade", f"SELECT doc_id, {_KIND} AS development_candidate_type, {_KIND} <> 'Belirsiz' AS is_actual_development FROM (SELECT doc_id, lower(text[1:5000]) AS x FROM documents)")
def classify_cascade(spark, sf):
    from sparkvane.plans.cascade import first_match

    x = F.lower(F.substring("text", 1, 5000))
    kind = lambda a, n: {"is_actual_development": a, "development_candidate_type": n}
    rules = [(x.contains("apache license"), kind(True, "İş Birliği")), (x.contains("gnu general"), kind(True, "Regülasyon")), (x.contains("rights reserved"), kind(True, "Rapor / Araştırma"))]
    d = table(spark, sf, "documents").select("doc_id", first_match(rules, kind(False, "Belirsiz")).alias("k"))
    return d.select("doc_id", "k.development_candidate_type", "k.is_actual_development")


@query("development_types")
def development_types(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"), F.lit("press").alias("source_type"))
    return p.select("page_id", classify.development("title", "body", "url", "source_type").alias("k")).select("page_id", "k.development_candidate_type", "k.is_actual_development")


@query(
    "quality_gate",
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text, doc_id % 7 = 0 AS same FROM documents)
        SELECT doc_id, CASE WHEN length(title) < 20 THEN 'Poor' WHEN same THEN 'Poor' WHEN length(text) < 300 THEN 'Poor' WHEN length(text) >= 900 THEN 'Good' ELSE 'Medium' END AS item_quality,
          CASE WHEN length(title) < 20 THEN 'title_too_short' WHEN same THEN 'item_url_equals_source_url' WHEN length(text) < 300 THEN 'detail_text_too_short' WHEN length(text) >= 900 THEN 'detail_text_rich' ELSE 'acceptable' END AS quality_reason FROM d""",
)
def quality_gate(spark, sf):
    q = classify.quality(F.substring_index("text", "\n", 1), "text", F.when(F.col("doc_id") % 7 == 0, "s").otherwise("i"), F.lit("s"), F.lit("detail_page_fetch"))
    return table(spark, sf, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.item_quality", "q.quality_reason")


def summaries(spark, sf):
    """labels as summaries: quality as impact, toxic as noise."""
    none = F.lit("")
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf, "labels").select(
        "doc_id",
        F.when(quality & ~toxic, "İlgili").when(toxic, "İlgisiz").otherwise("Belirsiz").alias("relevance_status"),
        F.when(quality, "Orta").otherwise("Düşük").alias("impact_on_us"),
        F.when(F.col("doc_id") % 3 == 0, "Orta").otherwise("Düşük").alias("importance_level"),
        F.when(F.col("doc_id") % 10 == 0, "Yönetici Bilgilendirme Notuna Ekle").otherwise("İzle").alias("recommended_action"),
        none.alias("strategic_theme"),
        F.when(toxic, "Kampanya").otherwise("").alias("development_type"),
        none.alias("product_area"),
        F.lit("Orta").alias("confidence_level"),
        none.alias("content_role"),
        none.alias("headline"),
        none.alias("item_title"),
        none.alias("summary"),
        none.alias("core_assessment"),
        F.when(F.col("doc_id") % 17 == 0, "Reddedildi").otherwise("").alias("review_status"),
        F.when(F.col("doc_id") % 4 == 0, "True").otherwise("").alias("covered_by_cluster"),
        F.lit("Küme İncelemede").alias("cluster_status"),
    )


_LABELS = "SELECT *, CASE WHEN quality = 1 AND toxic = 0 THEN 'İlgili' WHEN toxic = 1 THEN 'İlgisiz' ELSE 'Belirsiz' END AS rel, doc_id % 3 = 0 AS imp FROM labels"


@query(
    "triage_lanes",
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Yönetici Bilgilendirme' WHEN rel = 'İlgili' OR quality = 1 OR imp THEN 'İncelemeye Gönder' ELSE 'Düşük Öncelik / Arşiv' END AS triage_status,
          CASE WHEN doc_id % 10 = 0 THEN 'Aksiyon önerisi yönetici bilgilendirme notuna ekleme.' WHEN rel = 'İlgili' OR quality = 1 OR imp THEN
            array_to_string([x FOR x IN [CASE WHEN rel = 'İlgili' THEN 'LLM gelişmeyi ilgili işaretledi' END, CASE WHEN quality = 1 THEN 'Etki seviyesi Orta' END, CASE WHEN imp THEN 'Önem seviyesi Orta' END] IF x IS NOT NULL], '; ')
          ELSE 'Düşük etki/önem ve ilgisiz-belirsiz gelişme' END AS triage_reason FROM ({_LABELS})""",
)
def triage_lanes(spark, sf):
    return summaries(spark, sf).select("doc_id", triage.lane().alias("l")).select("doc_id", "l.triage_status", "l.triage_reason")


_LANE = """CASE WHEN doc_id % 17 = 0 THEN 'archive' WHEN doc_id % 4 = 0 AND toxic = 1 AND doc_id % 10 <> 0 THEN 'none' WHEN doc_id % 10 = 0 THEN 'awareness' WHEN rel = 'İlgili' OR quality = 1 OR imp THEN 'review' ELSE 'archive' END"""


def routed(spark, sf):
    s = summaries(spark, sf)
    s = s.withColumn("suppress", triage.suppressed(["Yönetime Eskale Et"], ["İzle"], ["tcmb"], ["kampanya"]))
    return s.withColumn("lane", triage.route())


@query("route_summaries", f"SELECT doc_id, {_LANE} AS lane FROM ({_LABELS})")
def route_summaries(spark, sf):
    return routed(spark, sf).select("doc_id", "lane")


@query(
    "single_lane_reconciliation",
    f"""SELECT intended, lane, count(*) AS n, count(*) FILTER (lane = 'none') AS without_lane FROM (SELECT {_LANE} AS lane, CASE WHEN doc_id % 10 = 0 THEN 'Yönetici Bilgilendirme' WHEN rel = 'İlgisiz' OR (quality = 0 AND NOT imp) THEN 'Düşük Öncelik / Arşiv' ELSE 'Analist Onay Kuyruğu' END AS intended FROM ({_LABELS})) GROUP BY ALL""",
)
def single_lane_reconciliation(spark, sf):
    r = routed(spark, sf).select("lane", triage.intended_destination().alias("intended"))
    return r.groupBy("intended", "lane").agg(F.count("*").alias("n"), F.count_if(F.col("lane") == "none").alias("without_lane"))


def _flags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    l = table(spark, sf, "labels")
    mark = lambda x, name: x.select("doc_id").distinct().withColumn(name, F.lit(True))
    out = d.join(mark(l.where("quality = 1 AND toxic = 1"), "published"), "doc_id", "left").join(mark(l.where("quality = 1"), "queued"), "doc_id", "left")
    out = out.join(mark(l.where("toxic = 1"), "archived"), "doc_id", "left").join(mark(l, "summarised"), "doc_id", "left")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))
    return out.join(mark(c, "aware"), "doc_id", "left").fillna(False)


_FLAGS = """SELECT doc_id, coalesce(quality = 1 AND toxic = 1, false) AS p, coalesce(quality = 1, false) AS q, coalesce(toxic = 1, false) AS a, quality IS NOT NULL AS s,
  doc_id IN (SELECT conv_id FROM conversations) AS w FROM documents LEFT JOIN labels USING (doc_id)"""


@query("status_precedence", f"SELECT doc_id, CASE WHEN p THEN 'Yayınlandı' WHEN q THEN 'İncelemede' WHEN w THEN 'Yönetici Bilgilendirme' WHEN a THEN 'Düşük Öncelik / Arşiv' WHEN s THEN 'Özetlendi' ELSE 'Henüz Özetlenmedi' END AS status FROM ({_FLAGS})")
def status_precedence(spark, sf):
    return _flags(spark, sf).select("doc_id", health.item_status(*[F.col(c) for c in ("published", "queued", "aware", "archived", "summarised")]).alias("status"))


@query("seen_status_precedence", f"SELECT doc_id, CASE WHEN p THEN 'Yayınlandı' WHEN a THEN 'Arşivlendi' WHEN doc_id % 13 = 0 THEN 'Reddedildi' WHEN q THEN 'İncelemede' WHEN w THEN 'Yönetici Bilgilendirme' WHEN s THEN 'Özetlendi' ELSE 'Keşfedildi' END AS status FROM ({_FLAGS})")
def seen_status_precedence(spark, sf):
    status = health.seen_status(F.col("published"), F.col("archived"), F.col("doc_id") % 13 == 0, F.when(F.col("queued"), ""), F.when(F.col("aware"), ""), F.col("summarised"))
    return _flags(spark, sf).select("doc_id", status.alias("status"))


@query(
    "registry_lint",
    """WITH r AS (SELECT s_suppkey % 95 AS id, s_name, s_nationkey, s_acctbal, s_suppkey FROM supplier), d AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r)
       SELECT s_suppkey, 'duplicate_source_id' AS issue_type, 'error' AS severity FROM d WHERE n > 1
       UNION ALL SELECT s_suppkey, 'active_missing_collector_capability', 'warning' FROM d WHERE s_acctbal > 0 AND s_nationkey % 3 = 0
       UNION ALL SELECT s_suppkey, 'eligible_without_weekly', 'error' FROM d WHERE s_nationkey % 4 = 1 AND s_acctbal < 1000""",
)
def registry_lint(spark, sf):
    s = table(spark, sf, "supplier").withColumn("id", F.col("s_suppkey") % 95)
    often = s.groupBy("id").count().where("count > 1").select("id").withColumn("_dup", F.lit(True))
    rules = [
        (F.col("_dup"), "duplicate_source_id", "error"),
        ((F.col("s_acctbal") > 0) & (F.col("s_nationkey") % 3 == 0), "active_missing_collector_capability", "warning"),
        ((F.col("s_nationkey") % 4 == 1) & (F.col("s_acctbal") < 1000), "eligible_without_weekly", "error"),
    ]
    return lints.issues(s.join(often, "id", "left"), ["s_suppkey"], rules)


@query(
    "run_status",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS items, count(*) AS n FROM events GROUP BY 1)
       SELECT day, CASE WHEN failed > 70 THEN 'Kısmi Başarılı' WHEN items = 0 THEN 'Başarılı — Değişiklik Yok' ELSE 'Başarılı' END AS final_status FROM d""",
)
def run_status(spark, sf):
    e = F.col("event_type")
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(e == "error").alias("failed"), F.count_if(e == "purchase").alias("items"), F.count("*").alias("n"))
    zero = F.lit(0)
    m = dict.fromkeys(("stage_failures", "changed_sources", "summaries", "review_additions", "awareness_additions", "archive_additions", "cluster_additions", "unchanged_sources"), zero)
    m |= {"sources_failed": F.when(F.col("failed") > 70, F.col("failed")).otherwise(0), "sources_checked": F.col("n"), "new_items": F.col("items"), "sources_succeeded": F.col("n")}
    return d.select("day", health.final_status(m, F.lit(False), F.lit(False), F.lit(False)).alias("final_status"))


_JOBS = "SELECT conv_id AS id, max(turn) AS turns, CASE WHEN max(turn) % 3 = 0 THEN 'Sırada' WHEN max(turn) % 3 = 1 THEN 'Araştırılıyor' ELSE 'Taslak' END AS status, max(turn) * 60.0 AS lease_until FROM conversations GROUP BY conv_id"


def _jobs(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("turns"))
    status = F.when(F.col("turns") % 3 == 0, "Sırada").when(F.col("turns") % 3 == 1, "Araştırılıyor").otherwise("Taslak")
    return c.select("id", status.alias("status"), (F.col("turns") * 60.0).alias("lease_until"), F.col("id").alias("created_at"), F.lit("t").alias("worker_token"))


@query("queue_transitions", f"SELECT id, CASE WHEN status = 'Araştırılıyor' AND lease_until < 300 THEN 'Kesildi' ELSE status END AS status FROM ({_JOBS})")
def queue_transitions(spark, sf):
    return queue.expire(_jobs(spark, sf), F.lit(300.0)).select("id", "status")


@query("queue_claim", f"SELECT id, status FROM ({_JOBS}) WHERE status = 'Sırada' ORDER BY id LIMIT 1")
def queue_claim(spark, sf):
    return queue.next_queued(_jobs(spark, sf)).select("id", "status")


# --- streams: run over what is there, and held against the batch form ---------------------


def _events_stream(spark, sf):
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _once(spark, stream):
    at = f"{tables.shared_folder(spark)}/sparkvane-stream-{uuid.uuid4().hex}"
    return jobs.run_once(stream, f"{at}/out", f"{at}/state")


@query("stream_change_detection")
def stream_change_detection(spark, sf):
    e = _events_stream(spark, sf)
    log = e.select(F.col("user_id").alias("source_id"), F.col("ts").alias("fetched_at"), "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("content_hash"))
    return _once(spark, jobs.change_stream(log)).select("event_id", "source_id", "change_status")


@query("stream_dedup")
def stream_dedup(spark, sf):
    return _once(spark, jobs.dedup_stream(_events_stream(spark, sf).select("event_id", "ts", "user_id"), ["event_id"], "ts")).select("event_id", "user_id")


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf):
    return jobs.tumbling(table(spark, sf, "events"), "ts", "1 day", ["event_type"], "value").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "window_sliding",
    """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL""",
)
def window_sliding(spark, sf):
    return jobs.sliding(table(spark, sf, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value").select("start", "event_type", "n")


@query(
    "window_session",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM b GROUP BY user_id, s""",
)
def window_session(spark, sf):
    return jobs.sessions(table(spark, sf, "events"), "ts", "6 hours", ["user_id"], "value").select("user_id", "start", "end", "n")
