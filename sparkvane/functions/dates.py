"""Dates in texts. Results are DateType, null where no valid date is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import text
from sparkvane.functions.urls import dated

# fixed values: Turkish month names in calendar order, each with its spelling without diacritics
MONTHS = (
    ("ocak", "ocak"),
    ("şubat", "subat"),
    ("mart", "mart"),
    ("nisan", "nisan"),
    ("mayıs", "mayis"),
    ("haziran", "haziran"),
    ("temmuz", "temmuz"),
    ("ağustos", "agustos"),
    ("eylül", "eylul"),
    ("ekim", "ekim"),
    ("kasım", "kasim"),
    ("aralık", "aralik"),
)
ENGLISH = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = "|".join(dict.fromkeys(n for pair in MONTHS for n in pair))
_ENGLISH = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in ENGLISH)
_SEP = r"\s*[-–]\s*"


def _number(names: dict[str, int], name: Column) -> Column:
    """The number of a month's name, null if it is none; the name, often a pattern over a long text, is computed once."""
    return F.element_at(F.create_map(*(F.lit(x) for n, i in names.items() for x in (n, str(i)))), name)


def _month(name: Column) -> Column:
    return _number({n: i for i, pair in enumerate(MONTHS, 1) for n in pair}, F.lower(name))


def _english_month(name: Column) -> Column:
    return _number({m[:3]: i for i, m in enumerate(ENGLISH, 1)}, F.substring(F.lower(name), 1, 3))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date of text parts; null unless it is on the calendar."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _grab(t: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(t, pattern, n)


def turkish(c: Column | str) -> Column:
    """The first date in words (12 Mayıs 2026), else d.m.yyyy or d/m/yyyy, else yyyy-mm-dd.

    The first form that is found decides, even where it is not on the calendar.
    """
    t = text(c)
    words = rf"(?iuU)\b(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})\b"
    dmy = r"(?U)\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b"
    iso = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    return (
        F.when(t.rlike(words), date_of(_grab(t, words, 3), _month(_grab(t, words, 2)), _grab(t, words, 1)))
        .when(t.rlike(dmy), date_of(_grab(t, dmy, 3), _grab(t, dmy, 2), _grab(t, dmy, 1)))
        .when(t.rlike(iso), date_of(_grab(t, iso, 1), _grab(t, iso, 2), _grab(t, iso, 3)))
    )


def english(c: Column | str) -> Column:
    """May 12, 2026, else 12 May 2026, else yyyy-mm-dd."""
    t = text(c)
    mdy = rf"(?i)\b({_ENGLISH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    dmy = rf"(?i)\b(\d{{1,2}})\s+({_ENGLISH})\.?,?\s+(\d{{4}})\b"
    iso = r"\b(\d{4})-(\d{2})-(\d{2})"
    return F.coalesce(
        date_of(_grab(t, mdy, 3), _english_month(_grab(t, mdy, 1)), _grab(t, mdy, 2)),
        date_of(_grab(t, dmy, 3), _english_month(_grab(t, dmy, 2)), _grab(t, dmy, 1)),
        date_of(_grab(t, iso, 1), _grab(t, iso, 2), _grab(t, iso, 3)),
    )


def dated_slug(url: Column | str) -> Column:
    """The date that begins a path part, as in /2026-05-12-title."""
    found = F.regexp_extract(text(url), r"^[^?#]*/(20\d{2}-\d{2}-\d{2})-", 1)
    return F.try_to_date(F.when(found != "", found), "yyyy-MM-dd")


def slashed(c: Column | str, month_first: Column | bool = False) -> Column:
    """a/b/yyyy, where a part over 12 is the day; else month first only where said so."""
    t = text(c)
    p = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    a, b, y = _grab(t, p, 1), _grab(t, p, 2), _grab(t, p, 3)
    us = month_first if isinstance(month_first, Column) else F.lit(month_first)
    first_is_month = F.when(b.try_cast("int") > 12, True).when(a.try_cast("int") > 12, False).otherwise(us)
    return F.when(first_is_month, date_of(y, a, b)).otherwise(date_of(y, b, a))


def any_format(c: Column | str) -> Column:
    """ISO first, then d.M.yyyy, then d/M/yyyy, then a date in Turkish words; never by the first row's format."""
    t = F.trim(text(c))
    return F.coalesce(F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"), F.try_to_date(t, "d.M.yyyy"), F.try_to_date(t, "d.M.yyyy"), turkish(t))


def ranges(c: Column | str) -> Column:
    """array<struct<start, end>> of date ranges: numeric, within a month, then across months; distinct."""
    t = text(c)
    num = r"(?U)\b\d{1,2}[./]\d{1,2}[./]\d{4}" + _SEP + r"\d{1,2}[./]\d{1,2}[./]\d{4}\b"
    same = rf"(?iuU)\b\d{{1,2}}{_SEP}\d{{1,2}}\s+(?:{_NAMES})\s+\d{{4}}\b"
    full = rf"(?iuU)\b\d{{1,2}}\s+(?:{_NAMES})(?:\s+\d{{4}})?{_SEP}\d{{1,2}}\s+(?:{_NAMES})\s+\d{{4}}\b"

    def numeric(x: Column) -> Column:
        p = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})" + _SEP + r"(\d{1,2})[./](\d{1,2})[./](\d{4})$"
        return F.struct(date_of(_grab(x, p, 3), _grab(x, p, 2), _grab(x, p, 1)).alias("start"), date_of(_grab(x, p, 6), _grab(x, p, 5), _grab(x, p, 4)).alias("end"))

    def within_month(x: Column) -> Column:
        p = rf"(?iuU)^(\d{{1,2}}){_SEP}(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})$"
        m = _month(_grab(x, p, 3))
        return F.struct(date_of(_grab(x, p, 4), m, _grab(x, p, 1)).alias("start"), date_of(_grab(x, p, 4), m, _grab(x, p, 2)).alias("end"))

    def across(x: Column) -> Column:
        p = rf"(?iuU)^(\d{{1,2}})\s+({_NAMES})(?:\s+(\d{{4}}))?{_SEP}(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})$"
        end_year = _grab(x, p, 6)
        year = F.when(_grab(x, p, 3) == "", end_year).otherwise(_grab(x, p, 3))
        return F.struct(date_of(year, _month(_grab(x, p, 2)), _grab(x, p, 1)).alias("start"), date_of(end_year, _month(_grab(x, p, 5)), _grab(x, p, 4)).alias("end"))

    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    found = F.concat(F.transform(every(num), numeric), F.transform(every(same), within_month), F.transform(every(full), across))
    return F.array_distinct(F.filter(found, lambda r: r["start"].isNotNull() & r["end"].isNotNull()))


def best(visible: Column | str, url: Column | str, listing: Column | str, metadata: Column | str, inferred: Column | str) -> Column:
    """struct(date, source, confidence) of the first place that gives a date."""
    # fixed values: the names of the places, and the confidence that each deserves
    places = (
        (turkish(visible), "detail_page_visible_date", "Yüksek"),
        (dated(url), "url_date", "Orta"),
        (turkish(listing), "listing_page_nearby_date", "Orta"),
        (turkish(metadata), "metadata_date", "Orta"),
        (turkish(inferred), "inferred_from_text", "Düşük"),
    )
    out = F.struct(F.lit(None).cast("date").alias("date"), F.lit("missing").alias("source"), F.lit("Yok").alias("confidence"))
    for d, source, confidence in reversed(places):
        out = F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def week_start(c: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", c))


def offer_status(status: Column, valid_until: Column, today: Column) -> Column:
    """Expired after its last day; an expired one with days left is active again; else as it was."""
    s = F.when(F.trim(F.coalesce(status, F.lit(""))) == "", "Belirsiz").otherwise(F.trim(status))
    return F.when(valid_until < today, "Süresi doldu").when(valid_until.isNotNull() & (s == "Süresi doldu"), "Aktif").otherwise(s)


def offer_active(status: Column, valid_until: Column, today: Column) -> Column:
    return (F.trim(status) == "Aktif") & (valid_until.isNull() | (valid_until >= today))


def due(next_check: Column, today: Column) -> Column:
    """Whether a check is due: no date, or a date that has come."""
    return next_check.isNull() | (next_check <= today)


