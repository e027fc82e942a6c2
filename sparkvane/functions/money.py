"""Amounts and shares that are written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import fold, text


def _number(c: Column) -> Column:
    return F.regexp_replace(F.when(c == "", None).otherwise(c), ",", ".").try_cast("double")


def amount(c: Column | str) -> Column:
    """The first number, dots as thousands and a comma as decimals; null for percentages and free items."""
    t = text(c)
    none = t.contains("%") | fold(t).contains("ücretsiz")
    return F.when(~none, _number(F.regexp_extract(F.replace(t, F.lit("."), F.lit("")), r"(\d+(?:,\d+)?)", 1)))


def percentage(c: Column | str) -> Column:
    """The number after the first percent sign."""
    return _number(F.regexp_extract(text(c), r"%\s*(\d+(?:[.,]\d+)?)", 1))


def is_free(c: Column | str) -> Column:
    """Free of charge: the word for it, or an amount of exactly zero (so 250 TL is not free)."""
    return fold(c).contains("ücretsiz") | F.coalesce(amount(c) == 0, F.lit(False))


def whole(c: Column | str) -> Column:
    """A whole number out of text such as 14 or 14.0; 0 for anything else."""
    return F.coalesce(F.trim(text(c)).try_cast("double").cast("long"), F.lit(0).cast("long"))
