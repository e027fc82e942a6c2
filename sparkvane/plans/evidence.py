"""Evidence that analysts hand in for sources which cannot be read: the gate, and the inbox.

An inbox row passes if it passes all checks and neither its url nor its title is known: from the
verified table, from recent items, or from a row that was accepted before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import urls
from sparkvane.functions.text import clean, fold, matches, squeeze, truthy
from sparkvane.operators import accept, changes
from sparkvane.plans import network
from sparkvane.plans.cascade import first_reason

# fixed values: ways of capture that are evidence by themselves, statuses that are looked at, characters that a
# screenshot's and a copied text need, columns of urls and titles in the tables of known items
SUPPLIED = ("analyst_copy_from_official_page", "official_pdf", "official_email_newsletter", "official_saved_html")
OPEN = ("", "New", "Validation Required", "Rejected", "Verified")
SCREENSHOT_CHARS = 900
BODY_CHARS = 500
URL_COLUMNS = ("official_url", "canonical_url", "item_url", "canonical_item_url", "source_url")
TITLE_COLUMNS = ("title", "item_title", "headline")


@dataclass(frozen=True)
class Owner:
    """Whose evidence it is, the domains that are official, and the cut-off day."""

    name: str
    domains: tuple[str, ...]
    since: str = "2026-05-01"


def title_key(c: Column | str) -> Column:
    """A title folded, with every character that is no letter, digit or underscore as white space."""
    return squeeze(F.regexp_replace(fold(clean(c)), r"(?U)[^\w\sçğıöşüİı]", " "))


def supplied(method: Column | str, body: Column | str, upload: Column | str) -> Column:
    """Whether a row holds evidence at all: by how it was captured, else by an upload or a copied text."""
    m = fold(clean(method))
    return (
        F.when(m == "unsupported", False)
        .when(m.isin(*SUPPLIED), True)
        .when(m == "official_screenshot", F.length(clean(body)) >= SCREENSHOT_CHARS)
        .when(m == "official_url", False)
        .otherwise((clean(upload) != "") | (clean(body) != ""))
    )


def known_keys(tables: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(urls, titles) that known items have, over whichever of their url and title columns there are; distinct."""
    found = []
    for names, key in ((URL_COLUMNS, urls.plain), (TITLE_COLUMNS, title_key)):
        parts = [t.where(clean(c) != "").select(key(c).alias("key")) for t in tables for c in names if c in t.columns]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        found.append(out)
    empty = tables[0].sparkSession.createDataFrame([], "key string")
    return tuple((x if x is not None else empty).where("key <> ''").distinct() for x in found)


def reasons(owner: Owner, market: network.Market, known: Column) -> Column:
    """Why an inbox row is refused, the first of the checks that fails; empty if it passes."""
    url, title, day, body = urls.plain("official_url"), clean("proposed_title"), clean("proposed_publication_date"), clean("copied_official_text")
    signal = network.classify(market, "proposed_title", "official_url", "copied_official_text", day, owner.since)
    proposed = clean("proposed_network_signal_type")
    return first_reason(
        [
            (clean("institution_name") != owner.name, "institution_not_owner"),
            ((url == "") | ~urls.within("official_url", owner.domains), "not_official_domain"),
            (~truthy("official_domain_verified"), "official_domain_not_analyst_verified"),
            (title == "", "missing_title"),
            (known, "duplicate_manual_or_recent_item"),
            (urls.kind("official_url").isin("search", "root", "listing"), "not_item_level_recent_url"),
            (day == "", "missing_publication_date"),
            (day < owner.since, "pre_cutoff"),
            (~truthy("analyst_date_verified"), "date_not_analyst_verified"),
            (~truthy("analyst_body_verified"), "body_not_analyst_verified"),
            (~supplied("evidence_capture_method", "copied_official_text", "uploaded_evidence_path"), "insufficient_official_evidence"),
            ((F.length(body) < BODY_CHARS) & (clean("uploaded_evidence_path") == ""), "body_too_short"),
            (matches(F.concat_ws(" ", title, F.substring(body, 1, 1000)), network.PATTERNS["lifestyle"]), "brand_lifestyle_or_corporate_noise"),
            (F.when(proposed != "", proposed).otherwise(signal["signal"]) == "Kapsam Dışı", "no_strategic_relevance_signal"),
        ]
    )


def validate_inbox(inbox: DataFrame, verified: DataFrame, recent: DataFrame, owner: Owner, market: network.Market, order: str = "position") -> DataFrame:
    """The open rows of the inbox with intake_status and validation_error.

    Rows are judged in the order of ``order``: each accepted one makes its url and its folded title known to
    those after it. What is asked of a title is its key, what is added is the folded title itself, so a title
    with punctuation is known to the next rows only by its url, as in a row-by-row run.
    """
    known_urls, known_titles = known_keys([verified, recent])
    rows = inbox.where(clean("intake_status").isin(*OPEN))
    rows = rows.withColumns({"_url": urls.plain("official_url"), "_title": title_key("proposed_title"), "_folded": fold(clean("proposed_title"))})
    rows = rows.join(known_urls.select(F.col("key").alias("_url"), F.lit(True).alias("_u")), "_url", "left")
    rows = rows.join(known_titles.select(F.col("key").alias("_title"), F.lit(True).alias("_t")), "_title", "left")
    before = F.coalesce("_u", "_t", F.lit(False))
    rows = accept.staged(rows.withColumn("_before", before).withColumn("_why", reasons(owner, market, before)).drop("_u", "_t"), "inbox")
    asks, gives = ["_url", "_title"], ["_url", "_folded"]
    taken = accept.accepted(rows.where("_why = ''"), order, asks, gives)
    marked = accept.standing(rows, taken, order, asks, gives, "_later")
    why = reasons(owner, market, F.col("_before") | F.col("_later"))
    judged = marked.withColumn("validation_error", F.when(F.col("_later"), why).otherwise(F.col("_why")))
    return judged.withColumn("intake_status", F.when(F.col("validation_error") == "", "Verified").otherwise("Rejected")).select(*[c for c in inbox.columns if c not in ("intake_status", "validation_error")], "intake_status", "validation_error")


def verified_rows(judged: DataFrame) -> DataFrame:
    """The rows that a run adds to the verified table."""
    return judged.where("intake_status = 'Verified'").select(
        "intake_id", urls.plain("official_url").alias("canonical_url"), clean("proposed_title").alias("title"), clean("proposed_publication_date").alias("publication_date"),
        F.length(clean("copied_official_text")).alias("body_chars"), clean("evidence_capture_method").alias("verification_method"), F.lit("canonical_unique").alias("duplicate_status"),
    )


def merge_verified(verified: DataFrame, new: DataFrame) -> DataFrame:
    """The verified table with the new rows, by intake_id: an existing row takes the new values, others are added."""
    return changes.fill_empty(verified, new, "intake_id", verified.columns, overwrite=True)
