"""Text functions, Column to Column. Null counts as the empty text unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters that keys fold to ASCII.
TURKISH = "ığüşöç"
ASCII = "igusoc"
#: White space of Unicode, and the separators that count as such.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
TRUE_WORDS = ("true", "1", "yes")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def clean(c: Column | str) -> Column:
    """Text without white space at both ends."""
    return F.btrim(text(c), F.lit(WHITE))


def squeeze(c: Column | str) -> Column:
    """Text with each run of white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def squeeze_lines(c: Column | str) -> Column:
    """No-break spaces as spaces, blanks collapsed, at most one empty line between lines."""
    t = F.regexp_replace(F.translate(text(c), " ", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def fold(c: Column | str) -> Column:
    """Lower case by Unicode. The dotted capital I gives i and a combining dot, as case folding does."""
    return F.lower(text(c))


def ascii_key(c: Column | str) -> Column:
    """Folded to lower-case ASCII words: Turkish letters mapped, everything else a space."""
    folded = F.translate(F.translate(fold(c), "̇", ""), TURKISH, ASCII)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def slug(c: Column | str) -> Column:
    return F.translate(ascii_key(c), " ", "_")


def truthy(c: Column | str, extra: Sequence[str] = ()) -> Column:
    """Whether the text is one of the true words, or of ``extra``; sources differ in theirs."""
    return F.lower(clean(c)).isin(*TRUE_WORDS, *extra)


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """Whether any of the words occurs, without case."""
    folded = fold(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | folded.contains(w.lower())
    return hit


def count_of(c: Column | str, words: Sequence[str]) -> Column:
    """How many of the words occur, without case."""
    folded = fold(c)
    return sum((folded.contains(w.lower()).cast("int") for w in words), F.lit(0))


def plain(c: Column | str) -> Column:
    """A text in which a letter that patterns take for another without case by Unicode is that other, in lower case:
    a pattern of letters alone is found where the plain text contains its plain letters, which is far cheaper."""
    out = text(c)
    for letter, other in zip("ıİſ\u212a", "iisk", strict=True):
        out = F.replace(out, F.lit(letter), F.lit(other))
    return F.lower(out)


def plain_words(words: str) -> str:
    return words.translate(str.maketrans("ıİſK", "iisk")).lower()


def plain_pattern(pattern: Column) -> Column:
    """A pattern for plain texts: it is found in ``plain`` of a text where the pattern is found in the text without
    case by Unicode, and far sooner. Null for one with classes or flags, of which plain letters change the sense."""
    return F.when(~pattern.rlike(r"\\[A-Z]|\[|\(\?(?!:)"), F.concat(F.lit("(?U)"), plain(pattern)))


def matches_plain(c: Column, pattern: str) -> Column:
    """``matches`` on a plain text; the pattern holds letters, groups and marks only."""
    return F.coalesce(c.rlike("(?U)" + plain_words(pattern)), F.lit(False))


def literal_words(pattern: str) -> list[str]:
    """The plain words of a pattern that asks for one of several, without those that hold another; none for any other pattern."""
    inner = re.fullmatch(r"\(?([\w -]+(?:\|[\w -]+)*)\)?", pattern)
    words = sorted({plain_words(w) for w in inner[1].split("|")}) if inner else []
    return [w for w in words if not any(o != w and o in w for o in words)]


def contains_plain(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in a plain text."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(plain_words(w))
    return hit


def occurrences(c: Column | str, word: str, folded: bool = False) -> Column:
    """Non-overlapping occurrences of a word in the folded text (``folded``: the column is that already)."""
    folded, w = col(c) if folded else fold(c), word.lower()
    return F.floor((F.length(folded) - F.length(F.replace(folded, F.lit(w), F.lit("")))) / len(w)).cast("int")


def matches(c: Column | str, pattern: str, unicode: bool = True) -> Column:
    """Whether the pattern is found; case is ignored, by Unicode unless said otherwise."""
    return F.coalesce(col(c).rlike(("(?iuU)" if unicode else "(?i)") + pattern), F.lit(False))


def normal_title(c: Column | str) -> Column:
    """A title as a key: folded, dotless i as i, urls dropped, only word characters kept."""
    t = F.translate(F.translate(F.lower(clean(c)), "ı", "i"), "İ", "i")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    return squeeze(F.regexp_replace(t, r"(?U)[^\wçğıöşü]+|̇", " "))


def dedup_title(c: Column | str, suffix: str = r"\s+\|\s+[^|]+$") -> Column:
    """A title for comparison: site suffix dropped, folded, white space and dashes made equal."""
    t = squeeze(fold(F.regexp_replace(text(c), "(?iuU)" + suffix, "")))
    return F.regexp_replace(t, r"\s+[-–]\s+", " - ")


def tokens(c: Column | str, shortest: int = 4, stop: Sequence[str] = ()) -> Column:
    """Distinct words of at least ``shortest`` letters or digits, sorted, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(fold(c), F.lit("([a-zçğıöşü0-9]+)"), F.lit(1)))
    kept = F.filter(words, lambda w: F.length(w) >= shortest)
    return F.array_sort(F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the size of the union of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(c: Column | str) -> Column:
    """Sentences of the squeezed text: cut at white space after a full stop, ! or ?."""
    return F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def first_sentences(c: Column | str, n: int) -> Column:
    return F.array_join(F.slice(sentences(c), 1, n), " ")


def compact(c: Column | str, width: int = 280, floor: int = 180) -> Column:
    """The first two sentences, cut at the last space beyond ``floor`` where they are too long."""
    t = first_sentences(c, 2)
    cut = F.rtrim(F.substring(t, 1, width - 3))
    space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    shorter = F.when(space > floor, F.rtrim(cut.substr(F.lit(1), space))).otherwise(cut)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(shorter, F.lit("...")))


def shorten(c: Column | str, width: int) -> Column:
    """Squeezed text cut to ``width``, at the last space if that keeps over 55 % of it."""
    t = squeeze(c)
    cut = F.rtrim(F.substring(t, 1, width - 1))
    space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    shorter = F.when(space > int(0.55 * width), cut.substr(F.lit(1), space)).otherwise(cut)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.rtrim(shorter), F.lit("…")))


def truncate(c: Column | str, width: int, marker: str = "\n\n[truncated]") -> Column:
    t = text(c)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.substring(t, 1, width), F.lit(marker)))


def repeats(candidate: Column, other: Column) -> Column:
    """Whether one text contains the other, or, at five words each, shares 72 % of the candidate's words."""
    norm = lambda c: squeeze(F.regexp_replace(fold(c), r"(?U)[^\wğüşöçı]+", " "))
    a, b = norm(candidate), norm(other)
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    share = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.lit(1))
    return (a == "") | ((b != "") & (b.contains(a) | a.contains(b) | ((F.size(wa) >= 5) & (F.size(wb) >= 5) & (share >= 0.72))))


def title_from_slug(url: Column | str) -> Column:
    """Words of a url's last path part, each with a capital."""
    part = F.regexp_extract(text(url), r"([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.initcap(squeeze(F.regexp_replace(F.regexp_replace(part, r"\.[A-Za-z0-9]{1,5}$", ""), r"[-_+]+", " ")))


def display_title(title: Column | str, owner: Column | str) -> Column:
    """The title without a leading owner name, unless the rest then starts in lower case or with an apostrophe."""
    t, o = squeeze(title), squeeze(owner)
    rest = F.ltrim(t.substr(F.length(o) + 1, F.length(t)))
    rest = F.regexp_replace(rest, r"^[:\-–|]\s*", "")
    first = F.substring(rest, 1, 1)
    ok = (o != "") & F.lower(t).startswith(F.lower(o)) & (rest != "") & ~first.isin("'", "’") & (first != F.lower(first))
    return F.when(ok, rest).otherwise(t)


def tag(c: Column | str, name: str) -> Column:
    """The value of ``name:value`` among tags separated by semicolons; null if there is none."""
    found = F.regexp_extract(text(c), rf"(?:^|;)\s*{name}:([^;]+)", 1)
    return F.when(found != "", F.trim(found))
