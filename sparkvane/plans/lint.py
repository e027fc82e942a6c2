"""Language lint: weighted hits of phrases and patterns, with warnings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import contains_plain, fold, occurrences, plain, text
from sparkvane.plans.cascade import all_reasons, bound

# fixed values: endings and phrases of officialese, with their weights
FORMAL = (r"\b\w+(?:maktadır|mektedir|mıştır|miştir|acaktır|ecektir)\b", 2, "Resmi zaman/ek")
BUREAUCRATIC = (r"\b(?:gereklidir|gerekir|edilmelidir|değerlendirilmelidir|alınmalıdır|yapılmalıdır|olmalıdır|izlenmelidir|beklenmelidir)\b", 3, "Bürokratik zorunluluk dili")
PASSIVE = (r"\b(?:bulunmaktadır|sunulmaktadır|sağlanmaktadır|gösterilmektedir|yansıtılmaktadır|belirtilmektedir|ifade edilmektedir)\b", 3, "Pasif rapor dili")
BROKEN = (r"\b\w+tdilde\b", 3, "Olası bozuk birleşik kelime")
FILLERS = ("açısından", "kapsamında", "yönelik")
BANNED = (
    "teşkil ediyor",
    "teşkil etmektedir",
    "önem arz ediyor",
    "önem arz etmektedir",
    "stratejik açıdan önemlidir",
    "değer yaratma potansiyeli",
    "konumlanmasını güçlendiriyor",
    "konumlanmasını güçlendirmektedir",
    "rekabetçi avantaj sağlamaktadır",
    "doğrudan rakip bir hamle",
    "doğrudan rakip pozisyon",
    "portföyünü büyütmeyi hedefliyor",
    "müşteri deneyimi açısından değer yaratıyor",
)
PATTERNS = (FORMAL, BUREAUCRATIC, PASSIVE, BROKEN)
REVIEW_AT, REWRITE_AT = 3, 6


def score(c: Column | str | dict[str, Column], phrases: Sequence[tuple[str, int]] = tuple((p, 3) for p in BANNED), patterns: Sequence[tuple[str, int, str]] = (), fillers: Sequence[str] = ()) -> Column:
    """struct(score, warnings, needs_review, needs_rewrite) of a text or its ``readings``. Patterns may overlap: each counts its own hits."""
    scored = lambda t: _scored(t, phrases, patterns, fillers)
    return scored(c) if isinstance(c, dict) else bound(readings(c), scored)


def readings(c: Column | str) -> dict[str, Column]:
    """A text as it is, folded and plain: what rules read, each computed once."""
    return {"text": text(c), "folded": fold(c), "plain": plain(c)}


def found(t: dict[str, Column], pattern: str) -> Column:
    """How often a pattern is found; one that asks for one of several words runs only where such a word stands."""
    n = F.regexp_count(t["text"], F.lit("(?iuU)" + pattern))
    shape = re.fullmatch(r"(?:\\b)?(?:\\w\+)?(?:\(\?:([\w |]+)\)|([\w ]+))(?:\\b)?", pattern)
    return F.when(contains_plain(t["plain"], (shape[1] or shape[2]).split("|")), n).otherwise(0) if shape else n


def _scored(t: dict[str, Column], phrases: Sequence[tuple[str, int]], patterns: Sequence[tuple[str, int, str]], fillers: Sequence[str]) -> Column:
    hits = [(occurrences(t["folded"], p, folded=True), w, f"'{p}'") for p, w in phrases]
    hits += [(found(t, p), w, label) for p, w, label in patterns]
    hits += [(found(t, rf"\b{f}\b"), 1, f"Dolgu kelime: '{f}'") for f in fillers]
    return bound({f"h{i}": n for i, (n, _, _) in enumerate(hits)}, lambda h: _judged([(h[f"h{i}"], w, label) for i, (_, w, label) in enumerate(hits)]))


def _judged(hits: Sequence[tuple[Column, int, str]]) -> Column:
    total = sum((n * w for n, w, _ in hits), F.lit(0))
    warnings = all_reasons([(n > 0, F.concat(F.lit(label + " (+"), (n * w).cast("string"), F.lit(")"))) for n, w, label in hits])
    return F.struct(total.alias("score"), warnings.alias("warnings"), (total >= REVIEW_AT).alias("needs_review"), (total >= REWRITE_AT).alias("needs_rewrite"))


def full(c: Column | str | dict[str, Column]) -> Column:
    """All the rules at once."""
    return score(c, patterns=PATTERNS, fillers=FILLERS)
