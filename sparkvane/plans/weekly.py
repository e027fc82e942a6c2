"""The weekly run as one plan: fetches to changes, candidates, items, summaries, lanes, clusters, index.

Every step is a function of tables; ``run`` wires them. Nothing is fetched and no model is
called: pages come from a stored table, and summaries from a pluggable function whose
default is the deterministic payload.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import ids, urls
from sparkvane.functions.text import clean, dedup_title, squeeze
from sparkvane.operators import changes
from sparkvane.operators.rows import insert_if_absent, pick
from sparkvane.operators.similar import greedy_dedup
from sparkvane.plans import boards, classify, recency, sourcing, triage
from sparkvane.sources import html
from sparkvane.sources.tables import staged


@dataclass(frozen=True)
class Settings:
    run_id: str
    now: str
    start: str = recency.DEFAULT_START
    institutions: Sequence[str] = ()
    types: Sequence[str] = ()
    candidates_per_page: int = 50
    groups: dict[str, str] = field(default_factory=dict)
    preserved: Sequence[str] = ("Onaylandı", "Reddedildi", "Yayınlandı")


def detect(fetches: DataFrame) -> DataFrame:
    """Fetches (document_id, source_id, fetched_at, status, content_hash) with their change status."""
    failed = F.col("status") == "error"
    return fetches.withColumn("change_status", changes.change_status(["source_id"], ["fetched_at", "document_id"], F.col("content_hash"), failed))


def extract(documents: DataFrame, pages: DataFrame, s: Settings) -> DataFrame:
    """Candidates of changed documents, each with the text of its own page where that is stored."""
    mine = pages.join(documents.select("document_id"), pages["page_id"] == documents["document_id"], "left_semi")
    found = html.candidates(html.links(mine), s.candidates_per_page)
    bodies = html.clean_pages(pages).join(pages.select(F.col("page_id"), urls.canonical("url").alias("url")), "page_id").select("url", "body", F.col("title").alias("page_title"))
    bodies = pick(bodies, ["url"], [F.desc(F.length("body"))])
    joined = found.join(bodies, "url", "left").join(documents, found["page_id"] == documents["document_id"])
    title = F.when(F.length("title") >= 12, F.col("title")).otherwise(F.coalesce("page_title", F.col("title")))
    return joined.select(
        "document_id", "source_id", "institution_name", "source_type", F.col("source_url"), squeeze(title).alias("item_title"), F.col("url").alias("item_url"),
        F.coalesce("body", F.lit("")).alias("item_text"), F.when(F.col("body").isNotNull(), "detail_page_fetch").otherwise("listing_only").alias("extraction_method"), "score",
    )


def judge(candidates: DataFrame, s: Settings) -> DataFrame:
    """Candidates with dates, recency, type, quality, identity, and the reason against them (empty if none)."""
    c = candidates.withColumns({"_none": F.lit(""), "_visible": F.substring("item_text", 1, 3000)})
    c = recency.add_date_semantics(c, "_visible", "item_url", "item_title", "_none", "_none", "source_type", "_dates")
    shown = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))
    c = c.select(
        "*",
        *[shown(F.col(f"_dates.{x}")).alias(x) for x in ("publication_date", "campaign_start_date", "campaign_end_date", "recency_basis_date")],
        shown(F.col("_dates.recency_basis_date")).alias("normalized_item_date"),
        F.lit("").alias("announcement_date"),
        F.col("_dates.event_date_type").alias("event_date_type"),
        F.col("_dates.date_confidence").alias("date_confidence"),
        F.col("_dates.date_source").alias("date_source"),
    )
    c = staged(recency.add_recency(staged(c, "dates"), s.start, "_recency"), "recency")
    c = c.withColumns({"_kind": classify.development("item_title", "item_text", "item_url", "source_type"), "_quality": classify.quality("item_title", "item_text", "item_url", "source_url", "extraction_method"), "normalized_title": dedup_title("item_title"), "canonical_item_url": urls.canonical("item_url")})
    c = staged(c, "kinds")
    c = c.withColumns(
        {
            "is_recent": F.col("_recency.is_recent"),
            "recency_reason": F.col("_recency.recency_reason"),
            "is_active_campaign": F.col("_recency.is_active_campaign"),
            "development_candidate_type": F.col("_kind.development_candidate_type"),
            "is_actual_development": F.col("_kind.is_actual_development"),
            "item_quality": F.col("_quality.item_quality"),
            "content_fingerprint": ids.content_fingerprint(ids.owner_key("institution_name", s.groups), "canonical_item_url", "normalized_title", "normalized_item_date"),
        }
    )
    reason = classify.rejection_reason(F.col("item_quality"), F.col("_quality.quality_reason"), F.col("is_recent"), F.col("recency_reason"), F.col("is_actual_development"), F.col("development_candidate_type"))
    out = c.withColumns({"rejected_reason": reason, "recent_item_id": ids.identifier("recent_item", "content_fingerprint"), "audit_id": ids.identifier("audit", F.lit(s.run_id), "source_id", "item_url")})
    return out.drop("_none", "_visible", "_dates", "_recency", "_kind", "_quality")


def without_duplicates(judged: DataFrame, existing: DataFrame, s: Settings) -> DataFrame:
    """Accepted candidates with ``duplicate_of`` and its reason: same url, same fingerprint, then like titles in 60 days."""
    owner = ids.owner_key("institution_name", s.groups)
    new = judged.where("rejected_reason = ''").withColumn("_owner", owner)
    order = [F.desc("score"), F.asc("item_url")]
    new = pick(pick(new, ["_owner", "canonical_item_url"], order), ["content_fingerprint"], order)
    old = existing.withColumn("_owner", owner)
    by_url = old.where(clean("canonical_item_url") != "").groupBy("_owner", "canonical_item_url").agg(F.min("recent_item_id").alias("_u"))
    by_print = old.where(clean("content_fingerprint") != "").groupBy("content_fingerprint").agg(F.min("recent_item_id").alias("_f"))
    exact = new.join(by_url, ["_owner", "canonical_item_url"], "left").join(by_print, "content_fingerprint", "left")
    hit = F.coalesce("_u", "_f")
    fresh = exact.where(hit.isNull())
    pool = old.select("_owner", "recent_item_id", "normalized_title", F.col("recency_basis_date").try_cast("date").alias("_d"), F.lit("0").alias("_o")).unionByName(
        fresh.select("_owner", "recent_item_id", "normalized_title", F.col("recency_basis_date").try_cast("date").alias("_d"), F.concat(F.lit("1"), F.lpad((1000 - F.col("score")).cast("string"), 5, "0"), F.col("item_url")).alias("_o"))
    )
    like = greedy_dedup(pool, "_owner", "recent_item_id", "normalized_title", "_o", "_d").where("duplicate_of IS NOT NULL").select(F.col("id").alias("recent_item_id"), F.col("duplicate_of").alias("_t"))
    out = exact.join(like, "recent_item_id", "left")
    reason = F.when(F.col("_u").isNotNull(), "duplicate_canonical_item_url").when(F.col("_f").isNotNull(), "duplicate_content_fingerprint").when(F.col("_t").isNotNull(), "duplicate_similar_title_60d").otherwise("")
    return out.withColumns({"duplicate_of": F.coalesce(hit, F.col("_t")), "duplicate_reason": reason}).drop("_owner", "_u", "_f", "_t")


def default_summary(items: DataFrame) -> DataFrame:
    """The deterministic payload of items that no model has summarised."""
    return items.select(
        "*",
        ids.identifier("summary", "recent_item_id").alias("summary_id"),
        F.substring(F.concat_ws(": ", clean("institution_name"), clean("item_title")), 1, 120).alias("headline"),
        F.lit("Model çağrılmadı; yer tutucu özet.").alias("summary"),
        F.lit("Analist kontrolü gerekli.").alias("core_assessment"),
        F.lit("Belirsiz").alias("relevance_status"),
        F.lit("").alias("strategic_theme"),
        F.lit("Diğer").alias("product_area"),
        F.col("development_candidate_type").alias("development_type"),
        F.lit("Düşük").alias("impact_on_us"),
        F.lit("Düşük").alias("importance_level"),
        F.lit("İzle").alias("recommended_action"),
        F.lit("Düşük").alias("confidence_level"),
        F.lit("").alias("content_role"),
        F.lit("").alias("review_status"),
    )


def lanes(summaries: DataFrame) -> dict[str, DataFrame]:
    """Queue, awareness and archive rows; every summary is in at most one."""
    t = summaries.withColumn("suppress", F.coalesce(F.col("suppress"), F.lit(False)) if "suppress" in summaries.columns else F.lit(False))
    t = t.withColumns({"lane": triage.route(), "triage_reason": triage.lane()["triage_reason"]})
    key = {"review": ("review_id", "review_item"), "awareness": ("awareness_id", "awareness"), "archive": ("archive_id", "archive")}
    return {lane: t.where(F.col("lane") == lane).withColumn(column, ids.identifier(kind, "recent_item_id")) for lane, (column, kind) in key.items()}


def run(tables: dict[str, DataFrame], s: Settings, summarise: Callable[[DataFrame], DataFrame] = default_summary) -> dict[str, DataFrame]:
    """All steps. tables: registry, fetches, pages, items (may be empty). Returns the new tables and the run's figures."""
    checked = staged(detect(tables["fetches"]), "changes")
    sources = sourcing.eligible(tables["registry"], s.institutions, s.types)
    registry = sources.select("source_id", "source_type", "extraction_mode", "institution_name", "institution_id", "source_name")
    documents = sourcing.fresh_documents(checked, registry, s.types)
    documents = documents.join(sources.select("source_id", F.col("url").alias("source_url")), "source_id")
    audit = staged(judge(staged(extract(documents, tables["pages"], s), "candidates"), s), "audit")
    deduped = staged(without_duplicates(audit, tables["items"], s), "deduped")
    items = deduped.where("duplicate_reason = ''")
    summaries = staged(summarise(items), "summaries")
    to = {k: staged(v, k) for k, v in lanes(summaries).items()}
    clusters = boards.clusters(summaries)
    count = lambda df: df.agg(F.count("*")).scalar()
    latest = pick(checked.join(sources.select("source_id"), "source_id", "left_semi"), ["source_id"], [F.desc("fetched_at")])
    figures = latest.agg(
        F.count("*").alias("sources_checked"),
        F.count_if(F.col("change_status") == "unchanged").alias("unchanged_sources"),
        F.count_if(F.col("change_status").isin("changed", "new_source")).alias("changed_sources"),
        F.count_if(F.col("change_status") == "error").alias("sources_failed"),
    ).withColumns({"run_id": F.lit(s.run_id), "candidates": count(audit), "new_items": count(items), "duplicates": count(deduped.where("duplicate_reason <> ''")), **{f"{k}_additions": count(v) for k, v in to.items()}})
    return {"changes": checked, "audit": audit, "items": insert_if_absent(tables["items"], items, ["recent_item_id"]), "new_items": items, "summaries": summaries, "clusters": clusters, "figures": figures, **to}
