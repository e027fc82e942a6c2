"""The feed: unified view, seen index, publishers, decisions, headline figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import dates, ids, urls
from sparkvane.functions.text import clean, normal_title, text
from sparkvane.operators.changes import translate_status
from sparkvane.operators.rows import first_value, insert_if_absent, pick, suffix_join
from sparkvane.plans.health import item_status, seen_status

OPEN, CLOSED = ("Beklemede", "İncelemede"), ("Onaylandı", "Reddedildi", "Yayınlandı", "Arşivlendi")


def _mark(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(clean(key) != "").select(key).distinct().withColumn(name, F.lit(True))


def unified(items: DataFrame, summaries: DataFrame, queue: DataFrame, awareness: DataFrame, archive: DataFrame, published: DataFrame) -> DataFrame:
    """Items with their summaries, one status each, and a date (the item's, else when it was seen)."""
    key = "recent_item_id"
    out = suffix_join(items, pick(summaries, [key], [F.desc("created_at")]), [key])
    for df, name in ((published, "_p"), (queue, "_q"), (awareness, "_w"), (archive, "_a"), (summaries, "_s")):
        out = out.join(_mark(df, key, name), key, "left")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("_p", "_q", "_w", "_a", "_s")]
    when = F.coalesce(dates.any_format("item_date"), dates.any_format("detected_at"))
    return out.withColumns({"status": item_status(*flags), "date_dt": when}).drop("_p", "_q", "_w", "_a", "_s")


def seen_index(previous: DataFrame, items: DataFrame, summaries: DataFrame, queue: DataFrame, awareness: DataFrame, archive: DataFrame, published: DataFrame, run_id: str, now: str) -> DataFrame:
    """One row per item ever seen, with its status; first_seen and first_run come from the previous index."""
    key = "recent_item_id"
    lookup = lambda df, c, name: first_value(df, key, c, [F.col(key)]).withColumnRenamed(c, name)
    base = items.select(key, "institution_name", "source_id", F.coalesce("canonical_item_url", "item_url").alias("canonical_item_url"), normal_title("item_title").alias("normalized_title"))
    base = base.join(lookup(summaries, "summary_id", "summary_id"), key, "left").join(lookup(queue, "review_status", "_queue"), key, "left").join(lookup(awareness, "review_status", "_aware"), key, "left")
    rejected = _mark(queue.where("review_status = 'Reddedildi'"), key, "_r")
    for df in (_mark(archive, key, "_a"), _mark(published, key, "_p"), rejected):
        base = base.join(df, key, "left")
    base = base.join(_mark(published, "summary_id", "_ps"), "summary_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = seen_status(yes("_p") | yes("_ps"), yes("_a"), yes("_r"), F.col("_queue"), F.col("_aware"), clean("summary_id") != "")
    rows = base.select(key, "institution_name", "source_id", "canonical_item_url", "normalized_title", "summary_id", status.alias("current_status"))
    others = [(queue, "İncelemede"), (awareness, "Yönetici Bilgilendirme"), (archive, "Arşivlendi"), (published, "Yayınlandı")]
    for df, s in others:  # rows known only from another table; later ones win
        extra = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in (key, "institution_name", "source_id", "item_url", "item_title", "summary_id")])
        extra = extra.select(key, "institution_name", "source_id", F.col("item_url").alias("canonical_item_url"), normal_title("item_title").alias("normalized_title"), "summary_id", F.lit(s).alias("current_status"))
        rows = insert_if_absent(rows, extra.dropDuplicates([key]), [key])
    old = previous.select(F.col(key), F.col("first_seen_at").alias("_seen"), F.col("first_run_id").alias("_run"))
    out = rows.withColumn("row_key", ids.row_key(key, "institution_name", "source_id", "canonical_item_url", "normalized_title", "summary_id")).join(old, key, "left")
    first = lambda c, v: F.when(clean(c) != "", F.col(c)).otherwise(F.lit(v))
    out = out.select("*", first("_seen", now).alias("first_seen_at"), first("_run", run_id).alias("first_run_id"), F.lit(now).alias("last_seen_at"), F.lit(run_id).alias("last_run_id"))
    return pick(out.drop("_seen", "_run"), ["row_key"], [F.asc("current_status")])


def publish(feed: DataFrame, approved: DataFrame, section: str, now: str, keys: Sequence[str] = ("development_id", "summary_id", "recent_item_id")) -> DataFrame:
    """The feed with approved rows that it does not have by any of its keys."""
    new = approved.withColumns({"development_id": F.concat(F.lit("DEV-"), F.substring(F.sha1(F.concat_ws(":", *[text(k) for k in keys[1:]])), 1, 12)), "section": F.lit(section), "published_at": F.lit(now)})
    return insert_if_absent(feed, new, list(keys))


def publish_clusters(feed: DataFrame, clusters: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(feed with approved clusters, items with their members flagged)."""
    from sparkvane.functions.arrays import id_list

    out = publish(feed, clusters, "Küme", now, ("development_id", "cluster_id"))
    members = clusters.select("cluster_id", F.explode(id_list("item_ids")).alias("recent_item_id")).dropDuplicates(["recent_item_id"])
    flagged = items.drop("cluster_id").join(members, "recent_item_id", "left").withColumn("cluster_published", F.col("cluster_id").isNotNull())
    return out, flagged


def decide(queue: DataFrame, decisions: DataFrame, now: str, reviewer: str) -> DataFrame:
    """Apply decisions (review_id, decision): status, reviewer and times of the rows that are named."""
    # fixed values: words for the decisions
    words = {"approve": "Onaylandı", "approved": "Onaylandı", "onayla": "Onaylandı", "reject": "Reddedildi", "rejected": "Reddedildi", "reddet": "Reddedildi", "archive": "Arşivlendi", "arşivle": "Arşivlendi"}
    out = queue
    for status in sorted(set(words.values())):
        named = [w for w, s in words.items() if s == status]
        hit = decisions.where(F.lower(clean("decision")).isin(*named))
        out = translate_status(out, hit, "review_id", {"review_status": status, "reviewer": reviewer, "reviewed_at": now})
    return out


def restore(archive: DataFrame, queue: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive without, queue with) the chosen items."""
    back = archive.join(chosen.select("recent_item_id"), "recent_item_id", "left_semi")
    rows = back.withColumns({"review_id": ids.identifier("review_item", "recent_item_id", "summary_id"), "review_status": F.lit("Beklemede")})
    return archive.join(chosen.select("recent_item_id"), "recent_item_id", "left_anti"), insert_if_absent(queue, rows, ["review_id"])


def really_published(feed: DataFrame) -> DataFrame:
    return feed.where((clean("recent_item_id") != "") | (clean("summary_id") != "") | (clean("cluster_id") != ""))


def open_rows() -> Column:
    s = clean("review_status")
    return s.isin(*OPEN) | ~s.isin(*CLOSED)


def display_date(*columns: str) -> Column:
    return F.coalesce(*[dates.any_format(c) for c in columns])


def display_url(*columns: str) -> Column:
    return urls.first_http(*columns)


def sections(feed: DataFrame, names: Sequence[str]) -> DataFrame:
    return feed.agg(*[F.count_if(F.col("section") == n).alias(n) for n in names])


def ordinal(c: Column | str) -> Column:
    """Kritik, Yüksek, Orta, Düşük (and their English names) as 4 to 1; 0 for anything else."""
    t = F.lower(clean(c))
    return F.when(t.isin("kritik", "critical"), 4).when(t.isin("yüksek", "high"), 3).when(t.isin("orta", "medium"), 2).when(t.isin("düşük", "low"), 1).otherwise(0)


def watchlist(feed: DataFrame, k: int = 3) -> DataFrame:
    return feed.orderBy(ordinal("impact_on_us").desc(), ordinal("importance_level").desc(), F.desc("date"), F.asc("development_id")).limit(k)


def weekly_figures(feed: DataFrame, day: str = "date") -> DataFrame:
    """One row: developments of the last week there is, of the week before, the change, the top three institutions."""
    w = feed.withColumn("_w", dates.week_start(F.col(day)))
    last = w.agg(F.max("_w")).scalar()
    now, before = F.count_if(F.col("_w") == last), F.count_if(F.col("_w") == F.date_sub(last, 7))
    counts = w.where(F.col("_w") == last).groupBy("institution_name").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "institution_name").limit(3).agg(F.array_join(F.collect_list("institution_name"), ", ")).scalar()
    return w.agg(now.alias("this_week"), before.alias("last_week"), (now - before).alias("delta")).withColumn("top_institutions", top)
