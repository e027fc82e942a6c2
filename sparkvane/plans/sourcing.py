"""Which sources and documents take part: eligibility, freshness, defaults, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import dates
from sparkvane.functions.text import clean, fold, matches, text, truthy
from sparkvane.operators.rows import latest, pick
from sparkvane.plans.cascade import first_match, first_reason
from sparkvane.plans.recency import evaluate
from sparkvane.sources.tables import staged

ACTIVE_WORDS = ("evet", "aktif")


def eligible(registry: DataFrame, institutions: Sequence[str], types: Sequence[str], forced: str = "") -> DataFrame:
    """Sources of the weekly run: active, static, in a weekly mode, of an allowed type and institution, not blocked.

    A forced source is there in any case, once.
    """
    names = [i.lower() for i in institutions]
    ok = (
        truthy("active", ACTIVE_WORDS)
        & truthy("mvp_active", ("evet",))
        & (fold(clean("collection_method")) == "static_scrape")
        & fold(clean("extraction_mode")).isin("weekly_development", "both")
        & text("source_type").isin(*types)
        & (fold("institution_name").isin(*names) | fold("institution_id").isin(*names))
        & ~blocked()
    )
    if forced:
        ok = ok | (text("source_id") == forced)
    return registry.where(ok).dropDuplicates(["source_id"])


def blocked() -> Column:
    """A source that is only watched, or whose weekly collection is off."""
    return (fold(clean("monitoring_mode")) == "blocked_source_watch") | (fold(clean("weekly_collection_enabled")) == "false")


def active_static(registry: DataFrame) -> DataFrame:
    return registry.where(truthy("active", ACTIVE_WORDS) & (fold(clean("collection_method")) == "static_scrape"))


def fresh_documents(metadata: DataFrame, registry: DataFrame, types: Sequence[str], force: bool = False, limit: int | None = None) -> DataFrame:
    """The latest changed document of each weekly source, newest first."""
    side = registry.select("source_id", "source_type", "extraction_mode", *[F.col(c).alias(f"_r_{c}") for c in ("institution_name", "institution_id", "source_name")])
    joined = metadata.join(side, "source_id", "left")
    for c in ("institution_name", "institution_id", "source_name"):
        own = F.col(c) if c in metadata.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(own, F.col(f"_r_{c}"))).drop(f"_r_{c}")
    fresh = (F.col("status") == "fetched") if force else F.col("change_status").isin("new_source", "changed")
    kept = joined.where(fresh & F.col("extraction_mode").isin("weekly_development", "both") & F.col("source_type").isin(*types))
    newest = pick(kept, ["source_id"], [F.desc("fetched_at")]).orderBy(F.desc("fetched_at"))
    return newest.limit(limit) if limit else newest


def fact_documents(metadata: DataFrame, registry: DataFrame) -> DataFrame:
    """The last changed document of each benchmark source."""
    modes = registry.where(F.col("extraction_mode").isin("benchmark_fact", "both")).select("source_id")
    changed = metadata.where((F.col("status") == "fetched") & F.col("change_status").isin("new_source", "changed"))
    return latest(changed.join(modes, "source_id", "left_semi"), ["source_id"], "fetched_at")


def summary_gate(start: str, allow_low: bool = False, allow_undated: bool = False, allow_end: bool = False, allow_source: bool = False) -> Column:
    """The first reason why an item is not summarised; empty if it may be."""
    item, source = clean("item_url"), F.when(clean("source_url") != "", clean("source_url")).otherwise(clean("registry_source_url"))
    canonical = F.when(clean("canonical_item_url") != "", clean("canonical_item_url")).otherwise(item)
    role = F.when(clean("content_role") != "", clean("content_role")).otherwise(clean("development_candidate_type"))
    flag = clean("source_claude_eligible")
    r = evaluate(start, allow_undated, allow_low, allow_end)
    day = F.substring(clean("normalized_item_date"), 1, 10).try_cast("date")
    return first_reason(
        [
            (~truthy("source_active", ACTIVE_WORDS), "kaynak active=True değil"),
            (~truthy("source_mvp_active", ACTIVE_WORDS), "kaynak mvp_active=True değil"),
            ((flag != "") & ~truthy(flag, ACTIVE_WORDS) & F.lit(not allow_source), "kaynak özetlemeye uygun değil"),
            (~clean("item_quality").isin("Good", "Medium"), F.concat(F.lit("item_quality uygun değil: "), text("item_quality"))),
            (item == "", "item_url yok"),
            ((item == source) | (canonical == source), "item_url source_url ile aynı"),
            (clean("extraction_method") == "fallback_source_page", "fallback_source_page özetlenmez"),
            (role.isin("Bağlamsal Veri", "Benchmark Bilgisi", "Kapsam Dışı"), F.concat(F.lit("content_role uygun değil: "), role)),
            (~truthy("is_actual_development", ("evet",)), F.concat(F.lit("actual development değil: "), text("actual_development_reason"))),
            (~r["is_recent"], r["recency_reason"]),
            (~clean("date_confidence").isin("Yüksek", "Orta") & F.lit(not allow_low), F.concat(F.lit("tarih güveni düşük: "), clean("date_confidence"))),
            (day < F.lit(start).cast("date"), F.concat(F.lit("kesim tarihinden eski: "), clean("normalized_item_date"))),
            ((clean("normalized_item_date") == "") & F.lit(not allow_undated), "normalized_item_date yok"),
        ]
    )


def valid_item() -> Column:
    """Whether a stored item may stay: recent, good enough, a development, with a page of its own."""
    return truthy("is_recent", ("evet",)) & clean("item_quality").isin("Good", "Medium") & truthy("is_actual_development", ("evet",)) & (clean("item_url") != clean("source_url")) & (clean("extraction_method") != "fallback_source_page")


def placeholder(column: str, pattern: str = r"^(?:test|demo|placeholder|lorem ipsum|örnek)\b") -> Column:
    return matches(clean(column), pattern)


def problem_source(health: Column, validation: Column | str) -> Column:
    return truthy("active", ACTIVE_WORDS) & (~health.isin("Sağlıklı") | matches(validation, "needs|blocked|unknown|pending"))


def stale(last_fetched: Column, today: Column, days: int = 7) -> Column:
    return last_fetched.isNull() | (F.datediff(today, last_fetched) > days)


def search(registry: DataFrame, words: str) -> DataFrame:
    w = words.lower()
    return registry.where(fold("institution_name").contains(w) | fold("source_id").contains(w) | fold("source_name").contains(w))


def blocked_note(registry: DataFrame, inbox: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: the next retry, open inbox rows, verified rows."""
    r = registry.where(blocked()).agg(F.min(dates.any_format("next_retry_at")).alias("next_retry"), F.count("*").alias("blocked"))
    i = inbox.agg(F.count_if(~clean("status").isin("verified", "rejected")).alias("open_inbox"))
    return r.select("next_retry", "blocked", i.scalar().alias("open_inbox"), verified.agg(F.count("*")).scalar().alias("verified"))


def link_decision(links: Column, useful: Column, dated: Column, menu_share: Column, code: Column, walled: Column) -> Column:
    """struct(recommendation, reason) of a source that was tried."""
    say = lambda a, b: {"recommendation": a, "reason": b}
    return first_match(
        [
            (walled, say("blocked", "access_wall")),
            (~code.between(200, 399), say("needs_review", "http_status")),
            (links == 0, say("browser_required", "no_links")),
            ((useful >= 3) & (dated >= 1) & (menu_share < 0.8), say("activate", "useful_dated_links")),
            (useful >= 3, say("benchmark_only", "useful_undated_links")),
        ],
        say("needs_review", "few_useful_links"),
    )


def default_registry(name: Column | str, classes: Sequence[tuple[str, dict[str, object]]], otherwise: dict[str, object]) -> Column:
    """Registry defaults by ordered institution classes (pattern, values)."""
    return first_match([(matches(name, p), v) for p, v in classes], otherwise)


def next_ids(new: DataFrame, registry: DataFrame, prefix: str = "REG-", width: int = 3, order: str = "url") -> DataFrame:
    """New sources with ids after the largest one there is, in the order of ``order``.

    Rows are dealt by ranges of it and numbered within their range; the ranges' counts, one row for each, give the offsets.
    """
    from pyspark.sql import Window as W

    last = registry.agg(F.coalesce(F.max(F.regexp_extract("source_id", rf"{prefix}(\d+)", 1).try_cast("int")), F.lit(0))).scalar()
    dealt = staged(new.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ids")
    before = F.sum("_count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # as many rows as ranges
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_count")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = dealt.join(F.broadcast(offsets), "_range").withColumn("_n", F.row_number().over(W.partitionBy("_range").orderBy(order)) + F.col("_before"))
    return numbered.withColumn("source_id", F.concat(F.lit(prefix), F.lpad((last + F.col("_n")).cast("string"), width, "0"))).drop("_range", "_before", "_n")
