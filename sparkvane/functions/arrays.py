"""Lists, maps and JSON in text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import clean, fold, text


def json_list(c: Column | str) -> Column:
    """A JSON list of strings; any other text that is not empty is a list of itself."""
    t = clean(c)
    parsed = F.from_json(t, "array<string>", {"mode": "PERMISSIVE"})
    is_list = t.startswith("[") & t.endswith("]")
    none = F.array().cast("array<string>")
    return F.when(t == "", none).when(is_list & parsed.isNotNull(), F.filter(parsed, lambda x: x.isNotNull())).otherwise(F.array(t))


def id_list(c: Column | str) -> Column:
    """A JSON list, else the parts between commas without brackets and quotes."""
    t = clean(c)
    parsed = F.from_json(t, "array<string>")
    plain = F.transform(F.split(F.regexp_replace(t, r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))
    return F.filter(F.when(t.startswith("[") & parsed.isNotNull(), parsed).otherwise(plain), lambda x: x.isNotNull() & (x != ""))


def to_json_list(c: Column) -> Column:
    return F.to_json(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))


def parts(c: Column | str, sep: str = ";") -> Column:
    """Trimmed parts of a separated list, without empty ones."""
    return F.filter(F.transform(F.split(text(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def tags(c: Column | str) -> Column:
    """``k:v;k:v`` as a map; the last of equal keys wins."""
    pairs = F.filter(F.transform(parts(c), lambda x: F.split(x, ":", 2)), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def object_text(c: Column | str) -> Column:
    """The JSON object in a reply: fences dropped, else from the first { to the last }."""
    t = F.trim(F.regexp_replace(text(c), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(text(c), r"(?s)(\{.*\})", 1)
    return F.when(t.startswith("{") & t.endswith("}"), t).when(inner != "", inner)


def coerce_value(c: Column | str, allowed: Sequence[str], fallback: str) -> Column:
    """The allowed value that the text is, else the first part that is one, else the one that occurs earliest."""
    t = clean(c)
    folded = fold(t)
    by_name = F.create_map(*[x for a in allowed for x in (F.lit(a.lower()), F.lit(a))])
    named = F.filter(F.transform(F.split(t, r"[,;|]"), lambda p: F.element_at(by_name, F.lower(F.trim(p)))), lambda p: p.isNotNull())
    places = [F.when(folded.contains(a.lower()), F.struct(F.instr(folded, a.lower()).alias("at"), F.lit(i).alias("i"), F.lit(a).alias("v"))) for i, a in enumerate(allowed)]
    earliest = F.array_min(F.filter(F.array(*places), lambda p: p.isNotNull()))["v"]
    return F.coalesce(F.element_at(by_name, folded), F.try_element_at(named, F.lit(1)), earliest, F.lit(fallback))
