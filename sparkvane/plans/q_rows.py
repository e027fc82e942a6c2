"""Queries on rows: changes, lookups, joins, aggregates, windows, top-k, merges."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.functions.arrays import parts
from sparkvane.functions.text import clean
from sparkvane.operators import changes, rows
from sparkvane.plans import health
from sparkvane.plans.registry import query, table


def fetch_log(spark, sf):
    """events as a log of fetches: user as source, event_type as content hash, 'error' as failure."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("source_id"), F.col("ts").alias("fetched_at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("content_hash"), "event_type", "value")


CHANGES_SQL = """
  SELECT event_id, user_id AS source_id, ts, CASE WHEN event_type = 'error' THEN 'error'
    WHEN prev IS NULL THEN 'new_source' WHEN prev = event_type THEN 'unchanged' ELSE 'changed' END AS change_status
  FROM (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)
"""


@query("change_detection", f"SELECT event_id, source_id, change_status FROM ({CHANGES_SQL})")
def change_detection(spark, sf):
    log = fetch_log(spark, sf)
    status = changes.change_status(["source_id"], ["fetched_at", "event_id"], F.col("content_hash"), F.col("content_hash").isNull())
    return log.select("event_id", "source_id", status.alias("change_status"))


@query("change_counts", f"SELECT change_status, count(*) AS n FROM ({CHANGES_SQL}) GROUP BY change_status")
def change_counts(spark, sf):
    return change_detection(spark, sf).groupBy("change_status").agg(F.count("*").alias("n"))


@query(
    "latest_per_source",
    "SELECT user_id AS source_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_per_source(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "source_id")
    return rows.latest(e, ["source_id"], "ts", "event_id").select("source_id", "event_id", "event_type", "value")


@query(
    "first_last_dedup",
    """SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n, arg_min(source, doc_id) AS first_source
       FROM documents GROUP BY text""",
)
def first_last_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "source")
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"), F.min_by("source", "doc_id").alias("first_source"))


@query(
    "failure_streak",
    """WITH a AS (SELECT event_id, user_id AS source_id, ts, CAST(event_type = 'error' AS INT) AS bad FROM events),
       b AS (SELECT *, sum(1 - bad) OVER (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
       c AS (SELECT *, sum(bad) OVER (PARTITION BY source_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM b)
       SELECT event_id, source_id, CAST(failures AS BIGINT) AS failures FROM c""",
)
def failure_streak(spark, sf):
    out = changes.failure_streak(fetch_log(spark, sf), ["source_id"], ["fetched_at", "event_id"], F.col("content_hash").isNull())
    return out.select("event_id", "source_id", F.col("failures").cast("long").alias("failures"))


@query(
    "source_health",
    """WITH a AS (SELECT *, CAST(event_type = 'error' AS INT) AS bad FROM events),
       b AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
       c AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM b),
       s AS (SELECT user_id AS source_id, count(*) AS n, sum(CAST(event_type = 'click' AS INT)) AS candidates, max(CASE WHEN bad = 0 THEN ts END) AS last_good,
               arg_max(event_type, (ts, event_id)) AS latest, arg_max(failures, (ts, event_id)) AS failures, arg_max(value, (ts, event_id)) AS value FROM c GROUP BY user_id),
       g AS (SELECT CAST(max(ts) AS DATE) AS now FROM events)
       SELECT source_id, CAST(failures AS BIGINT) AS failures, CAST(candidates AS BIGINT) AS candidates,
         CASE WHEN source_id % 11 = 0 THEN 'Manuel Kontrol Gerekli' WHEN failures >= 3 THEN 'Hatalı'
              WHEN latest = 'error' THEN CASE WHEN failures >= 2 THEN 'Hatalı' ELSE 'Uyarı' END
              WHEN value <= 50 THEN 'Hatalı'
              WHEN failures IN (1, 2) THEN 'Uyarı' WHEN candidates = 0 THEN 'Uyarı'
              WHEN date_diff('day', CAST(last_good AS DATE), now) >= 2 THEN 'Uzun Süredir Güncellenmedi' ELSE 'Sağlıklı' END AS status
       FROM s, g""",
)
def source_health(spark, sf):
    log = changes.failure_streak(fetch_log(spark, sf), ["source_id"], ["fetched_at", "event_id"], F.col("content_hash").isNull())
    at = F.struct("fetched_at", "event_id")
    s = log.groupBy("source_id").agg(
        F.count_if(F.col("event_type") == "click").alias("candidates"),
        F.max(F.when(F.col("content_hash").isNotNull(), F.col("fetched_at"))).alias("last_good"),
        F.max_by("event_type", at).alias("latest"),
        F.max_by("failures", at).alias("failures"),
        F.max_by("value", at).alias("value"),
    )
    now = log.agg(F.to_date(F.max("fetched_at")).alias("now")).scalar()
    h = health.source_health(
        status=F.when(F.col("latest") == "error", "error").otherwise("fetched"),
        code=F.lit(200),
        length=F.col("value"),
        candidates=F.col("candidates"),
        failures=F.col("failures"),
        last_seen=F.to_date("last_good"),
        method=F.when(F.col("source_id") % 11 == 0, "manual").otherwise("static_scrape"),
        mode=F.lit("both"),
        now=now,
        stale_days=2,
    )
    return s.select("source_id", F.col("failures").cast("long").alias("failures"), "candidates", h["status"].alias("status"))


@query(
    "coverage_matrix",
    """WITH x AS (SELECT n_name AS institution, r_name AS tier, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
       SELECT institution, any_value(tier) AS tier, count(*) AS sources, count(*) FILTER (s_acctbal > 8000) AS active, count(*) FILTER (s_acctbal > 6000) AS weekly,
         count(*) FILTER (s_acctbal > 4000) AS benchmark, count(*) FILTER (s_acctbal < 0) AS manual,
         CASE WHEN count(*) FILTER (s_acctbal > 8000) > 0 THEN 'Tam Kapsama' WHEN count(*) FILTER (s_acctbal > 4000) > 0 THEN 'Kısmi Kapsama'
              WHEN count(*) FILTER (s_acctbal < 0) > 0 THEN 'Manuel Kontrol Gerekli' ELSE 'Kapsama Yok' END AS coverage,
         array_to_string(list_sort(list(s_suppkey))[1:5], '; ') AS top_sources
       FROM x GROUP BY institution""",
)
def coverage_matrix(spark, sf):
    x = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = F.col("s_acctbal")
    agg = x.groupBy(F.col("n_name").alias("institution")).agg(
        F.first("r_name").alias("tier"),
        F.count("*").alias("sources"),
        F.count_if(b > 8000).alias("active"),
        F.count_if(b > 6000).alias("weekly"),
        F.count_if(b > 4000).alias("benchmark"),
        F.count_if(b < 0).alias("manual"),
        F.array_join(F.slice(F.array_sort(F.collect_list("s_suppkey")), 1, 5).cast("array<string>"), "; ").alias("top_sources"),
    )
    c = health.coverage(active=F.col("active"), weekly=F.col("weekly"), benchmark=F.col("benchmark"), browser=F.lit(0), manual=F.col("manual"))
    return agg.withColumn("coverage", c)


@query(
    "conditional_multi_agg",
    """SELECT l_returnflag, l_linestatus, count(*) AS rows_n, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity >= 40) AS large,
         round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY ALL""",
)
def conditional_multi_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("rows_n"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.count_if(F.col("l_quantity") >= 40).alias("large"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
    )


@query(
    "score_pivot",
    """SELECT l_suppkey % 25 AS institution_id, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS N,
         round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1""",
)
def score_pivot(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("institution_id", F.col("l_suppkey") % 25)
    return l.groupBy("institution_id").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_discount"), 6))


@query("overall_ranking", "SELECT n_name AS institution, round(avg(s_acctbal), 6) AS score, row_number() OVER (ORDER BY avg(s_acctbal) DESC, n_name) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def overall_ranking(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("score"))
    j = s.join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    # one row per institution: 25 rows, so the ranking window is small by construction
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "n_name"))
    return j.select(F.col("n_name").alias("institution"), F.round("score", 6).alias("score"), place.cast("long").alias("place"))


@query("dimension_ranking", "SELECT p_brand AS institution, round(avg(p_retailprice), 6) AS score FROM part WHERE p_size > 25 GROUP BY p_brand ORDER BY score DESC, institution LIMIT 10")
def dimension_ranking(spark, sf):
    p = table(spark, sf, "part").where("p_size > 25").groupBy(F.col("p_brand").alias("institution")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"))
    return p.orderBy(F.desc("score"), "institution").limit(10)


@query(
    "top_in_dimension_text",
    """SELECT concat('Öncü: ', arg_max(n_name, (s, -n_nationkey)), ' | ', arg_min(n_name, (s, n_nationkey))) AS gap
       FROM (SELECT n_nationkey, n_name, sum(s_acctbal) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)""",
)
def top_in_dimension_text(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("s")).join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    best, least = F.max_by("n_name", F.struct("s", -F.col("n_nationkey"))), F.min_by("n_name", F.struct("s", "n_nationkey"))
    return s.agg(F.concat(F.lit("Öncü: "), best, F.lit(" | "), least).alias("gap"))


_ORDINALS = "CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END"


@query(
    "briefing_score_topk",
    f"""SELECT o_orderkey, 3 * (CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) + 2 * ({_ORDINALS}) + CAST(o_totalprice > 200000 AS INT) AS briefing_score
        FROM orders ORDER BY briefing_score DESC, o_orderkey LIMIT 20""",
)
def briefing_score_topk(spark, sf):
    impact = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    importance = F.expr(_ORDINALS)
    score = 3 * impact + 2 * importance + (F.col("o_totalprice") > 200000).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", score.alias("briefing_score")).orderBy(F.desc("briefing_score"), "o_orderkey").limit(20)


@query("value_counts_topk", "SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 10")
def value_counts_topk(spark, sf):
    return rows.value_counts(table(spark, sf, "documents"), "source", 10)


@query("mode_with_ties", "SELECT source, lang AS mode, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def mode_with_ties(spark, sf):
    return rows.mode(table(spark, sf, "documents"), ["source"], "lang")


@query(
    "distinct_and_duplicates",
    """SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_n, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source""",
)
def distinct_and_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"))
    each = d.groupBy("source", "h").agg(F.count("*").alias("k"))  # two-step distinct: hot sources combine map-side
    return each.groupBy("source").agg(F.sum("k").alias("n"), F.count("*").alias("distinct_n"), (F.sum("k") - F.count("*")).alias("duplicates"))


@query("repeated_keys", "SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) QUALIFY count(*) OVER (PARTITION BY host) > 1")
def repeated_keys(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    often = p.groupBy("host").count().where("count > 1").select("host")
    return p.join(often, "host", "left_semi").select("page_id", "host")


@query("daily_series", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_series(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "week_over_week",
    """WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1)
       SELECT week, n, n - lag(n) OVER (ORDER BY week) AS delta FROM w""",
)
def week_over_week(spark, sf):
    w = table(spark, sf, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    # the week before is a join on the date, so no global ordering is needed
    before = w.select(F.date_add("week", 7).alias("week"), F.col("n").alias("_before"))
    return w.join(before, "week", "left").select("week", "n", (F.col("n") - F.col("_before")).alias("delta"))


@query("trailing_30d", "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 6 FROM events) GROUP BY event_type")
def trailing_30d(spark, sf):
    e = table(spark, sf, "events")
    start = e.agg(F.date_sub(F.to_date(F.max("ts")), 6).alias("d")).scalar()
    return e.where(F.to_date("ts") >= start).groupBy("event_type").agg(F.count("*").alias("n"))


@query("explode_theme_coverage", "SELECT theme, count(DISTINCT p_brand) AS brands, count(*) AS n FROM (SELECT p_brand, unnest(list_distinct(string_split(p_type, ' '))) AS theme FROM part) GROUP BY theme")
def explode_theme_coverage(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.explode(F.array_distinct(parts("p_type", " "))).alias("theme"))
    return p.groupBy("theme").agg(F.countDistinct("p_brand").alias("brands"), F.count("*").alias("n"))


@query("best_per_bucket_with_ties", "SELECT p_size AS bucket, p_partkey, p_retailprice FROM part QUALIFY rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) = 1")
def best_per_bucket_with_ties(spark, sf):
    p = table(spark, sf, "part")
    least = p.groupBy("p_size").agg(F.min("p_retailprice").alias("p_retailprice"))
    return p.join(least, ["p_size", "p_retailprice"]).select(F.col("p_size").alias("bucket"), "p_partkey", "p_retailprice")


@query(
    "cell_matrix_preview",
    """SELECT p_brand, p_size, array_to_string(list_sort(list(p_partkey))[1:2], ', ') || CASE WHEN count(*) > 2 THEN ' +' || (count(*) - 2) ELSE '' END AS cell FROM part GROUP BY ALL""",
)
def cell_matrix_preview(spark, sf):
    cells = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    more = F.when(F.size("ids") > 2, F.concat(F.lit(" +"), (F.size("ids") - 2).cast("string"))).otherwise("")
    return cells.select("p_brand", "p_size", F.concat(F.array_join(F.slice("ids", 1, 2).cast("array<string>"), ", "), more).alias("cell"))


@query("semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "coalesce_join",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment ELSE o_orderpriority END AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def coalesce_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("segment"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return rows.coalesce_join(o, c, ["o_custkey"], ["segment"])


@query(
    "null_safe_composite_join",
    """WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg, c_nationkey AS nat FROM customer),
       r AS (SELECT seg, nat, count(*) AS n FROM l GROUP BY ALL)
       SELECT l.c_custkey, r.n FROM l LEFT JOIN r ON l.seg IS NOT DISTINCT FROM r.seg AND l.nat IS NOT DISTINCT FROM r.nat""",
)
def null_safe_composite_join(spark, sf):
    l = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"), F.col("c_nationkey").alias("nat"))
    r = l.groupBy("seg", "nat").agg(F.count("*").alias("n"))
    return rows.null_safe_join(l, r, ["seg", "nat"]).select("c_custkey", "n")


@query(
    "star_left_join",
    """SELECT o_orderkey, c_name, n_name, r_name, coalesce(l.n, 0) AS lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""",
)
def star_left_join(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    j = j.join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("lines"))


@query("dimension_enrichment", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_enrichment(spark, sf):
    dims = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf, "supplier").join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    "suffix_join",
    """SELECT d.doc_id, d.source, l.doc_id AS doc_id_summary, l.source AS source_summary FROM (SELECT doc_id, source, doc_id // 2 AS k FROM documents) d
       LEFT JOIN (SELECT doc_id, upper(source) AS source, doc_id AS k FROM documents WHERE doc_id % 2 = 0) l USING (k)""",
)
def suffix_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.expr("doc_id div 2").alias("k"))
    r = table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", F.upper("source").alias("source"), F.col("doc_id").alias("k"))
    return rows.suffix_join(d, r, ["k"]).select("doc_id", "source", "doc_id_summary", "source_summary")


@query("first_match_lookup", "SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def first_match_lookup(spark, sf):
    c = table(spark, sf, "conversations").where((F.col("role") == "user") & (F.trim("text") != ""))
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))


@query("last_match_lookup", "SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def last_match_lookup(spark, sf):
    return rows.latest(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn").select("conv_id", F.col("role").alias("last_role"), F.col("turn").alias("last_turn"))


@query(
    "range_join_60d",
    """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
       AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 60""",
)
def range_join_60d(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    # date bins of 61 days: a pair within 60 days lies in one bin or two neighbours, so each row meets few others
    bins = o.withColumn("bin", F.expr("unix_date(d) div 61"))
    near = bins.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    a, b = bins.alias("a"), near.alias("b")
    pairs = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.bin") == F.col("b.bin")))
    return pairs.where((F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (F.abs(F.datediff("a.d", "b.d")) <= 60)).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query(
    "asof_latest_before",
    """SELECT o_orderkey, (SELECT max(o2.o_orderdate) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND (o2.o_orderdate, o2.o_orderkey) < (o.o_orderdate, o.o_orderkey)) AS previous_date FROM orders o""",
)
def asof_latest_before(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderdate").over(w).alias("previous_date"))


_EXISTING = "SELECT c_custkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'Onaylandı' WHEN 1 THEN 'Beklemede' ELSE 'Reddedildi' END AS review_status FROM customer WHERE c_custkey % 3 <> 0"
_NEW = "SELECT c_custkey, upper(c_name) AS c_mktsegment, 'Beklemede' AS review_status FROM customer WHERE c_custkey % 2 = 0"


@query(
    "upsert_preserving",
    f"""WITH o AS ({_EXISTING}), n AS ({_NEW})
        SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(o.review_status, n.review_status) AS review_status,
          CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
        FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE n.c_custkey IS NOT NULL OR o.review_status IN ('Onaylandı', 'Reddedildi')""",
)
def upsert_preserving(spark, sf):
    c = table(spark, sf, "customer")
    status = F.when(F.col("c_custkey") % 4 == 0, "Onaylandı").when(F.col("c_custkey") % 4 == 1, "Beklemede").otherwise("Reddedildi")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment", status.alias("review_status"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_mktsegment"), F.lit("Beklemede").alias("review_status"))
    return changes.merge_preserving(old, new, "c_custkey", ["c_custkey", "c_mktsegment", "review_status"], ["Onaylandı", "Reddedildi"]).withColumnRenamed("_action", "action")


@query(
    "archive_upsert",
    """WITH o AS (SELECT c_custkey AS id, 'RIA-' || c_custkey AS archive_id, c_mktsegment AS reason FROM customer WHERE c_custkey % 3 <> 0),
       n AS (SELECT c_custkey AS id, 'new' AS archive_id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'x' END AS reason FROM customer WHERE c_custkey % 2 = 0)
       SELECT coalesce(o.id, n.id) AS id, coalesce(o.archive_id, n.archive_id) AS archive_id, coalesce(n.reason, o.reason) AS reason,
         CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN o.reason <> n.reason THEN 'updated' ELSE 'same' END AS action FROM o FULL JOIN n ON o.id = n.id""",
)
def archive_upsert(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    old = c.where("id % 3 <> 0").select("id", F.concat(F.lit("RIA-"), F.col("id").cast("string")).alias("archive_id"), F.col("c_mktsegment").alias("reason"))
    new = c.where("id % 2 = 0").select("id", F.lit("new").alias("archive_id"), F.when(F.col("id") % 4 == 0, F.col("c_mktsegment")).otherwise("x").alias("reason"))
    return changes.merge_archive(old, new, "id", ["id", "archive_id", "reason"]).withColumnRenamed("_action", "action")


@query(
    "registry_fill_empty",
    """WITH o AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS name FROM nation WHERE n_nationkey < 20),
       n AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation WHERE n_nationkey > 5)
       SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.name WHEN n.id IS NULL OR o.name <> '' THEN o.name ELSE n.name END AS name FROM o FULL JOIN n ON o.id = n.id""",
)
def registry_fill_empty(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "id")
    old = n.where("id < 20").select("id", F.when(F.col("id") % 2 == 0, F.col("n_name")).otherwise("").alias("name"))
    return changes.fill_empty(old, n.where("id > 5").select("id", F.lower("n_name").alias("name")), "id", ["id", "name"])


@query(
    "table_diff",
    """WITH b AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 <> 0)
       SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v <> b.v""",
)
def table_diff(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    after = c.where("id % 4 <> 0").select("id", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("v")).alias("v"))
    return changes.diff(c.where("id % 5 <> 0"), after, "id", ["id", "v"])


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, NULL AS brand FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, p_brand FROM part WHERE p_partkey % 2 = 1")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, sf, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return c.unionByName(p, allowMissingColumns=True)


@query(
    "insert_if_absent",
    """WITH o AS (SELECT c_custkey AS id, c_name AS k FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT c_custkey + 1 AS id, c_name AS k FROM customer)
       SELECT id, k FROM o UNION ALL SELECT id, k FROM n WHERE id NOT IN (SELECT id FROM o) AND k NOT IN (SELECT k FROM o)""",
)
def insert_if_absent(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("k"))
    return rows.insert_if_absent(old, c.select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("k")), ["id", "k"])


@query("provenance_collapse", "SELECT p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS p_type FROM part GROUP BY p_brand")
def provenance_collapse(spark, sf):
    return rows.collapse_origins(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_type"), ["p_brand"], ["p_retailprice", "p_partkey"], "p_type")


@query("cascading_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascading_delete(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept, _ = rows.cascade_delete({"lineitem": table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")}, gone, "l_orderkey")
    return kept["lineitem"]


@query("facet_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'")
def facet_filter(spark, sf):
    import datetime as dt

    chosen = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}
    return rows.facets_filter(table(spark, sf, "orders"), chosen, "o_orderdate", dt.datetime(1994, 1, 1), dt.datetime(1996, 12, 31)).select("o_orderkey")


@query("facet_domain", "SELECT DISTINCT p_brand FROM part WHERE trim(p_brand) <> '' ORDER BY p_brand")
def facet_domain(spark, sf):
    return rows.facet(table(spark, sf, "part"), "p_brand")


@query("ranked_preview", "SELECT p_brand, p_partkey, n FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 3")
def ranked_preview(spark, sf):
    out = rows.numbered(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], "n").where("n <= 3")
    return out.select("p_brand", "p_partkey", F.col("n").cast("long").alias("n"))


@query(
    "anomaly_vs_last5",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS candidates, count(*) FILTER (event_type = 'purchase') AS model_calls FROM events GROUP BY 1),
       m AS (SELECT *, avg(candidates) OVER w AS mc, avg(model_calls) OVER w AS mm FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
       SELECT day, candidates, round(mc, 6) AS mean_candidates, coalesce(candidates > 1.2 * mc, false) AS high, coalesce(model_calls > 1.2 * mm, false) AS model_high FROM m""",
)
def anomaly_vs_last5(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("candidates"), F.count_if(F.col("event_type") == "purchase").alias("model_calls"))
    # one row per run: the run log is ordered as a whole, and is small
    w = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-5, -1)
    m = d.withColumn("mc", F.avg("candidates").over(w)).withColumn("mm", F.avg("model_calls").over(w))
    return m.select("day", "candidates", F.round("mc", 6).alias("mean_candidates"), F.coalesce(F.col("candidates") > 1.2 * F.col("mc"), F.lit(False)).alias("high"), F.coalesce(F.col("model_calls") > 1.2 * F.col("mm"), F.lit(False)).alias("model_high"))


@query(
    "run_state_fold",
    """SELECT user_id AS source_id, count(*) AS fetches, count(*) FILTER (event_type = 'error') AS errors, max(ts) FILTER (event_type <> 'error') AS last_success_at FROM events GROUP BY user_id""",
)
def run_state_fold(spark, sf):
    log = fetch_log(spark, sf)
    of = lambda x: x.groupBy("source_id").agg(F.count("*").alias("fetches"), F.count_if(F.col("content_hash").isNull()).alias("errors"), F.max(F.when(F.col("content_hash").isNotNull(), F.col("fetched_at"))).alias("last_success_at"))
    half = F.col("fetched_at") < "2024-01-16"
    return changes.fold_state(of(log.where(half)), of(log.where(~half)), "source_id", ["fetches", "errors"], ["last_success_at"])


@query("update_by_join", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'Onaylandı' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_by_join(spark, sf):
    ids = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return changes.translate_status(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ids, "c_custkey", {"c_mktsegment": "Onaylandı"})


@query("ratio_kpis", "SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS archived, round(count(*) FILTER (toxic = 1) * 1.0 / count(*), 6) AS share FROM labels")
def ratio_kpis(spark, sf):
    hit = F.count_if(F.col("toxic") == 1)
    return table(spark, sf, "labels").agg(F.count("*").alias("total"), hit.alias("archived"), F.round(hit / F.count("*"), 6).alias("share"))


@query("rollup_coverage", "SELECT r_name, n_name, count(*) AS n, round(avg(s_acctbal), 6) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_coverage(spark, sf):
    j = dimension_enrichment(spark, sf).join(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("score"))


@query("nulls_last_ordinal_sort", "SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE " + _ORDINALS + " END DESC NULLS LAST, o_orderkey) AS place FROM orders) WHERE place <= 25")
def nulls_last_ordinal_sort(spark, sf):
    key = F.when(F.col("o_orderkey") % 7 != 0, F.expr(_ORDINALS))
    top = table(spark, sf, "orders").select("o_orderkey", key.alias("_k")).orderBy(F.desc_nulls_last("_k"), "o_orderkey").limit(25)
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("_k"), "o_orderkey"))  # 25 rows
    return top.select("o_orderkey", place.cast("long").alias("place"))


@query("blank_keys_stay", "SELECT count(*) AS n FROM documents WHERE trim(coalesce(source, '')) <> ''")
def blank_keys_stay(spark, sf):
    return table(spark, sf, "documents").where(clean("source") != "").agg(F.count("*").alias("n"))
