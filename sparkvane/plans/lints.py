"""Table lints: one row per rule that a row breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.text import clean, fold, truthy
from sparkvane.functions.urls import plain

Rule = tuple[Column, str, str]


def issues(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """keys, issue_type, severity of every broken rule; one pass, no self-union."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("issue_type"), F.lit(level).alias("severity"))) for c, name, level in rules])
    return df.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(*keys, "i.issue_type", "i.severity")


def registry_rules() -> list[Rule]:
    """Consistency of one registry row."""
    active, mvp, eligible = truthy("active", ("evet",)), truthy("mvp_active", ("evet",)), truthy("claude_eligible", ("evet",))
    method, mode = fold(clean("collection_method")), fold(clean("monitoring_mode"))
    weekly_off = fold(clean("weekly_collection_enabled")) == "false"
    return [
        ((clean("institution_id") == "") | (clean("institution_name") == ""), "invalid_institution_alias", "error"),
        (active & (clean("collector_capability") == "") & method.isin("", "static_scrape", "browser_required"), "active_missing_collector_capability", "warning"),
        (mvp & weekly_off, "mvp_active_weekly_disabled", "error"),
        (eligible & ~mvp, "eligible_without_mvp", "error"),
        (active & (method == "browser_required") & (mode != "production_weekly"), "browser_source_skipped_from_static_collection", "warning"),
        (active & (method == "manual"), "manual_source_skipped_from_automation", "warning"),
        ((mode == "blocked_source_watch") & ~weekly_off, "blocked_source_enters_weekly", "error"),
    ]


def registry(df: DataFrame) -> DataFrame:
    """All issues of a source registry: duplicate ids and urls, then the row rules."""
    keyed = df.withColumn("_url", plain("url"))
    ids = keyed.groupBy("source_id").count().where("count > 1").select("source_id").withColumn("_dup_id", F.lit(True))
    urls = keyed.where("_url <> ''").groupBy("_url").count().where("count > 1").select("_url").withColumn("_dup_url", F.lit(True))
    marked = keyed.join(ids, "source_id", "left").join(urls, "_url", "left")
    rules = [(F.col("_dup_id"), "duplicate_source_id", "error"), (F.col("_dup_url"), "duplicate_canonical_url", "warning"), *registry_rules()]
    return issues(marked, ["source_id", "institution_name"], rules)
