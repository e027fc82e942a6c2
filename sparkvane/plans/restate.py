"""Recompute of what follows from the texts of stored items: dates, recency, kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.text import clean
from sparkvane.operators.rows import once
from sparkvane.plans import classify, recency
from sparkvane.sources.bundles import rewrite_partitions

#: Columns that a recompute fills.
DATES = ("publication_date", "campaign_start_date", "campaign_end_date", "normalized_item_date", "recency_basis_date")
FIELDS = (*DATES, "event_date_type", "date_confidence", "date_source", "is_recent", "recency_reason", "is_active_campaign", "development_candidate_type", "is_actual_development")


def undated() -> Column:
    """Whether a stored item's dates are to be read anew: it has no basis, or one of metadata only."""
    return (clean("recency_basis_date") == "") | (clean("date_source") == "metadata_date")


def restated(items: DataFrame, since: str) -> DataFrame:
    """``items`` with their dates read anew where that is due, the recency of all, and the kind of those without one.

    Expects text columns: item_title, item_text, item_url, item_date, source_type, announcement_date and those of ``FIELDS``
    but for the two flags, which are true or false.
    """
    columns = items.columns
    hidden = F.concat_ws("\n", "item_title", F.substring("item_text", 1, 2000))
    d = items.withColumns({"_none": F.lit(""), "_inferred": hidden, "_due": undated(), "_visible": F.coalesce("item_date", F.lit(""))})
    d = once(recency.add_date_semantics(d, "_visible", "item_url", "_none", "_none", "_inferred", "source_type", "_dates"))
    shown = lambda c: F.coalesce(F.date_format(F.col(f"_dates.{c}"), "yyyy-MM-dd"), F.lit(""))
    fresh = {c: shown(c if c != "normalized_item_date" else "recency_basis_date") for c in DATES} | {c: F.coalesce(F.col(f"_dates.{c}"), F.lit("")) for c in ("event_date_type", "date_confidence", "date_source")}
    d = once(d.withColumns({c: F.when(F.col("_due"), v).otherwise(F.col(c)) for c, v in fresh.items()}))
    d = once(recency.add_recency(d, since, "_recency"))
    d = d.withColumn("_kind", classify.development("item_title", "item_text", "item_url", "source_type"))
    bare = clean("development_candidate_type") == ""
    d = once(d).withColumns(
        {
            "is_recent": F.col("_recency.is_recent"),
            "recency_reason": F.col("_recency.recency_reason"),
            "is_active_campaign": F.col("_recency.is_active_campaign"),
            "recency_basis_date": F.coalesce(F.date_format("_recency.recency_basis_date", "yyyy-MM-dd"), "recency_basis_date"),
            "is_actual_development": F.when(bare, F.col("_kind.is_actual_development")).otherwise(F.col("is_actual_development")),
            "development_candidate_type": F.when(bare, F.col("_kind.development_candidate_type")).otherwise(F.col("development_candidate_type")),
        }
    )
    return d.select(*columns)


def restate_table(spark: SparkSession, path: str, partition: str, since: str, affected: Column | None = None) -> DataFrame:
    """Recompute a stored table in place, only in the partitions that hold affected rows (by default, those whose dates are due)."""
    return rewrite_partitions(spark, path, partition, undated() if affected is None else affected, lambda d: restated(d, since))
