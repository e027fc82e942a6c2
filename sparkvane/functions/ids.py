"""Stable identifiers. All depend on exact byte strings; tests hold them against literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import clean, fold, squeeze, text

#: Prefix, digest length and natural key parts of each identifier.
KINDS = {
    "recent_item": ("RI-", 12),
    "summary": ("SUM-", 12),
    "review_item": ("RIRQ-", 12),
    "awareness": ("MAQ-", 12),
    "archive": ("RIA-", 12),
    "audit": ("RIAUD-", 12),
    "fact": ("FACT-", 12),
    "extraction": ("EXT-", 12),
    "review": ("REV-", 10),
    "cluster": ("CL-", 12),
}


def identifier(kind: str, *parts: Column | str, sep: str = ":") -> Column:
    """The prefix of the kind and the start of the SHA-1 of its parts, joined by ``sep``."""
    prefix, n = KINDS[kind]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(sep, *[text(p) for p in parts])), 1, n))


def owner_key(name: Column | str, groups: dict[str, str] | None = None) -> Column:
    """The folded owner name, or the group that aliased names share."""
    key = fold(squeeze(name))
    for alias, group in (groups or {}).items():
        key = F.when(key == alias, F.lit(group)).otherwise(key)
    return key


def content_fingerprint(owner: Column | str, url: Column | str, title: Column | str, date: Column | str) -> Column:
    """SHA-256 of owner, url and title, or of owner, title and date where there is no url."""
    o, u, t, d = text(owner), text(url), text(title), text(date)
    return F.sha2(F.when(u != "", F.concat_ws("|", o, u, t)).otherwise(F.concat_ws("|", o, t, d)), 256)


def words_fingerprint(*parts: Column | str) -> Column:
    """SHA-1 of the parts that are not empty, joined by a space; empty if there are none."""
    joined = F.array_join(F.filter(F.array(*[clean(p) for p in parts]), lambda x: x != ""), " ")
    return F.when(joined == "", F.lit("")).otherwise(F.sha1(joined))


def content_hash(c: Column | str) -> Column:
    return F.sha2(text(c), 256)


def blob_hash(c: Column | str) -> Column:
    """The content hash of version-control blobs: SHA-1 over a length header and the bytes."""
    raw = F.encode(text(c), "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def row_key(item_id: Column | str, *parts: Column | str) -> Column:
    """``id:`` and the item id, or ``combo:`` and the other parts where it is empty."""
    i = clean(item_id)
    return F.when(i != "", F.concat(F.lit("id:"), i)).otherwise(F.concat(F.lit("combo:"), F.concat_ws("|", *[clean(p) for p in parts])))


def document_id(source: Column | str, at: Column) -> Column:
    return F.concat(F.lit("DOC-"), text(source), F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"))


def numbered(prefix: str, width: int, last: Column, n: Column) -> Column:
    """The n-th identifier after ``last``, zero-padded."""
    return F.concat(F.lit(prefix), F.lpad((last + n).cast("string"), width, "0"))
