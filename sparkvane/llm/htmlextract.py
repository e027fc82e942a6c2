"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the log-odds of their block under
weights from labelled pages (``labelled_pages``), tags score negative by theirs; a linear scan
finds the contiguous part of the highest sum, the content region. Elements whose own marks
(tag, words of class, id and role) say menu, header, footer, sidebar, notice, advert, form or
comments are left out before and inside the region. A region that lies in an element which is
marked as main text is widened to the whole of that element but for blocks that are links, so
that short first and last paragraphs stay.

Weights are log-ratios of counts in the labelled pages: of elements by their marks, of blocks
by their shape (words, words in links, mark at the end, heading) and by the marks of the
elements around them, and of tags by their place. They are fitted on the driver from that
fixed small table and sent with the tasks.

Text: character references are decoded, white space within a block becomes one space, blocks
are trimmed and joined by a line feed in the order of the page; line breaks (``br``) are white
space; nothing else is dropped, and no text is cut.

Markup is read tolerantly: end tags may be missing, tags may be unclosed at the end of the
page, ``<`` before anything but a tag is text, comments and raw elements run to the end of
the page if they are not closed.

Scale: one pass over the pages, no shuffle; a worker holds one page's elements at a time.

Defined results: a null or empty page, or one without a region of positive score, has the
empty text; every row gives a row, repeated and null page_ids too; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm import common
from sparkvane.llm.labelled_pages import labelled

#: Tags that never show text.
UNSEEN = frozenset("head script style noscript template svg math iframe select datalist object canvas audio video title textarea xmp noembed noframes".split())
#: Tags whose content is no markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input button".split())
#: Tags that say nothing about their text.
NEUTRAL = INLINE - {"button", "label"} | frozenset("# html body div p ul ol li dl dt dd table thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 section center br hr".split())
#: A start tag of the key ends an open element of these, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
_SCOPES = frozenset("table td th".split())

#: Log-ratio from which on marks decide about an element, and the share of the page that is never left out for its marks.
DECIDED = 1.5
MAJORITY = 0.5
#: Scores of a word lie between -1 and 1, of a tag between -1 and this.
LEAST_TAG = -0.02
_SMOOTH = 0.5

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?>[^"'>=]++|=\s*+(?:"[^"]{0,65536}+"|'[^']{0,65536}+')?|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKING = ("class", "id", "role", "itemprop")
_NEGATED = frozenset("has with no without is not".split())


class Element(NamedTuple):
    name: str
    parent: int
    marks: tuple[str, ...]


class Text(NamedTuple):
    element: int
    text: str
    offset: int


class Tag(NamedTuple):
    element: int
    name: str
    offset: int


def marks_of(name: str, attributes: str, inside: bool) -> tuple[str, ...]:
    """What an element says of itself; a header or footer inside an article is another thing than that of a page."""
    marks = []
    if name not in NEUTRAL:
        marks.append(("article>" if inside and name in ("header", "footer") else "tag:") + name)
    if attributes and not attributes.isspace() and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if key in _MARKING:
                kind = "role:" if key == "role" else "name:"
                before = ""
                for word in _WORD.findall(unescape(value)):
                    word = word.lower()
                    if len(word) > 1 and before not in _NEGATED:
                        marks.append(kind + (word[:-1] if len(word) > 2 and word[-1] == "s" and word[-2] != "s" else word))
                    before = word
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                marks.append("hidden")
    return tuple(dict.fromkeys(marks))


def parse(html: str) -> tuple[list[Element], list[Text | Tag]]:
    """Elements in the order of their start tags (0: the page), and texts and start tags in the order of the page.
    End tags of blocks are tags without a name."""
    elements = [Element("#", -1, ())]
    items: list[Text | Tag] = []
    stack = [0]
    opened: Counter[str] = Counter()  # names on the stack, so that no stack is searched for what it doesn't hold
    inside = [False]
    at = 0
    n = len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        start = m.start() if m else n
        if start > at:
            items.append(Text(stack[-1], unescape(html[at:start]), at))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                _close(name, stack, elements, opened)
            if name not in INLINE:
                items.append(Tag(stack[-1], "", start))
            continue
        _imply(name, stack, elements, opened)
        within = inside[stack[-1]]
        elements.append(Element(name, stack[-1], marks_of(name, m[3], within)))
        inside.append(within or name in ("article", "main"))
        items.append(Tag(len(elements) - 1, name, start))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID:
            stack.append(len(elements) - 1)
            opened[name] += 1
    return elements, items


def _cut(k: int, stack: list[int], elements: list[Element], opened: Counter[str]) -> None:
    opened.subtract(elements[e].name for e in stack[k:])
    del stack[k:]


def _imply(name: str, stack: list[int], elements: list[Element], opened: Counter[str]) -> None:
    """The ends that a start tag implies."""
    if opened["p"] and (name not in INLINE and name not in VOID or name == "hr"):
        for k in range(len(stack) - 1, 0, -1):
            inner = elements[stack[k]].name
            if inner == "p":
                _cut(k, stack, elements, opened)
                break
            if inner not in INLINE:
                break
    if name in ENDS and any(opened[x] for x in ENDS[name][0]):
        ended, within = ENDS[name]
        for k in range(len(stack) - 1, 0, -1):
            inner = elements[stack[k]].name
            if inner in within:
                break
            if inner in ended:
                _cut(k, stack, elements, opened)


def _close(name: str, stack: list[int], elements: list[Element], opened: Counter[str]) -> None:
    """An end tag ends its element and those inside; that of an inline element doesn't reach out of its block."""
    for k in range(len(stack) - 1, 0, -1):
        inner = elements[stack[k]].name
        if inner == name:
            if name in INLINE:
                opened[name] -= 1
                del stack[k]
            else:
                _cut(k, stack, elements, opened)
            return
        if name in INLINE and inner not in INLINE or inner in _SCOPES and name not in ("table", "tr", "tbody", "thead", "tfoot"):
            return


class Block(NamedTuple):
    element: int
    text: str
    words: int
    shape: tuple[str, ...]
    offset: int


def blocks_of(elements: list[Element], items: list[Text | Tag]) -> Iterator[Block | Tag]:
    """Blocks of text and the start tags between them, in order; elements that show no text give none."""
    unseen = [False] * len(elements)
    link = [False] * len(elements)
    home = list(range(len(elements)))  # the innermost element that is no inline one
    for e, (name, parent, _) in enumerate(elements):
        if parent >= 0:
            unseen[e] = unseen[parent] or name in UNSEEN
            link[e] = name == "a" or (link[parent] and name in INLINE)
            if name in INLINE:
                home[e] = home[parent]
    parts: list[str] = []
    linked, where, offset, begun = 0, 0, 0, False
    waiting: list[Tag] = []

    def flush() -> Iterator[Block | Tag]:
        nonlocal parts, linked, waiting, begun
        words = "".join(parts).split()
        if words:
            yield Block(where, " ".join(words), len(words), _shape(elements[where].name, len(words), linked, words[-1]), offset)
        yield from waiting
        parts, linked, waiting, begun = [], 0, [], False

    for item in items:
        if isinstance(item, Text):
            if not unseen[item.element]:
                if not item.text.isspace():
                    if not begun:
                        where, offset, begun = home[item.element], item.offset, True
                    if link[item.element]:
                        linked += len(item.text.split())
                parts.append(item.text)
        elif item.name == "br" or item.name == "wbr":
            if item.name == "br":
                parts.append(" ")
            waiting.append(item)
        elif item.name in INLINE:
            waiting.append(item)
        else:
            yield from flush()
            if item.name:
                yield item
    yield from flush()


def _shape(name: str, words: int, linked: int, last: str) -> tuple[str, ...]:
    share = linked / words
    return (
        f"words:{min(5, words.bit_length())}",
        f"links:{0 if not linked else 1 if share < 0.34 else 2 if share < 0.8 else 3}",
        "ends" if last[-1] in ".!?:;…。！？\"”»)" else "open",
        f"in:{name if name in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li', 'td', 'th', 'pre', 'blockquote') else 'other'}",
    )


#: The shape of a block of links.
_LINKS = "links:3"


class Weights(NamedTuple):
    """Log-ratios: positive for main text."""

    marks: dict[str, float]
    around: dict[str, float]
    shape: dict[str, float]
    tags: dict[str, float]
    prior: float


def fit(pages: Iterable[tuple[str, list[tuple[int, int]]]]) -> Weights:
    """Weights from labelled pages, given as (html, ranges that are main text)."""
    marks, around, shape, tags, both = ({True: Counter(), False: Counter()} for _ in range(5))
    for html, ranges in pages:
        starts = [a for a, _ in ranges]
        main = lambda at: (k := bisect_right(starts, at) - 1) >= 0 and at < ranges[k][1]  # noqa: B023, E731
        elements, items = parse(html)
        parts = list(blocks_of(elements, items))
        held = [[0, 0] for _ in elements]
        for x in parts:
            if isinstance(x, Block):
                e = x.element
                while e >= 0:
                    held[e][main(x.offset)] += x.words
                    e = elements[e].parent
        # what lies in a marked element without main text is left out with it: its own marks decide nothing
        inner = [False] * len(elements)
        for e, (_, parent, said) in enumerate(elements):
            inner[e] = parent >= 0 and (inner[parent] or bool(elements[parent].marks) and not held[parent][True])
            if not inner[e] and any(held[e]):
                marks[held[e][True] > 0].update(said)
        for x in parts:
            good = main(x.offset)
            if isinstance(x, Tag):
                tags[good][x.name] += 1
                continue
            both[good][""] += 1
            shape[good].update(x.shape)
            seen: set[str] = set()
            e = x.element
            while e >= 0:
                if not inner[e]:
                    seen.update(elements[e].marks)
                e = elements[e].parent
            around[good].update(seen)

    def ratio(counts: dict[bool, Counter], even: bool = False) -> dict[str, float]:
        shift = math.log((sum(counts[False].values()) + 1) / (sum(counts[True].values()) + 1)) if even else 0.0
        return {k: round(math.log((counts[True][k] + _SMOOTH) / (counts[False][k] + _SMOOTH)) + shift, 4) for k in sorted(counts[True] | counts[False])}

    return Weights(ratio(marks), ratio(around), ratio(shape, True), ratio(tags), ratio(both)[""])


@functools.lru_cache(maxsize=1 << 14)
def _known(mark: str, names: frozenset[str]) -> str:
    """The mark itself, or the longest known one that it begins or ends with (commentlist: comment)."""
    kind, _, word = mark.partition(":")
    if mark in names or not word:
        return mark
    close = [x for x in names if x.startswith(kind + ":") and len(w := x[len(kind) + 1 :]) >= 4 and (word.startswith(w) or word.endswith(w))]
    return max(close, key=lambda x: (len(x), x), default=mark)


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first and the last place (exclusive) of the contiguous part of the highest sum; (0, 0) if none is positive. Linear."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(html: str, weights: Weights) -> str:
    """The main text of a page."""
    elements, items = parse(html)
    parts = list(blocks_of(elements, items))
    names = frozenset(weights.marks)
    held = [0] * len(elements)
    headed = [x.name in ("h1", "main") for x in elements]
    for x in parts:
        if isinstance(x, Block):
            held[x.element] += x.words
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e].parent] += held[e]
        headed[elements[e].parent] |= headed[e]
    gone = [False] * len(elements)
    own = [0.0] * len(elements)
    bad, good = [0.0] * len(elements), [0.0] * len(elements)
    for e, (_, parent, marks) in enumerate(elements):
        if parent >= 0:
            bad[e], good[e], gone[e] = bad[parent], good[parent], gone[parent]
        if marks:
            known = [_known(m, names) for m in marks]
            said = [weights.marks.get(m, 0.0) for m in known]
            # the worst mark decides: the comments of a post are comments
            worst, most = min(0.0, *said), max(0.0, *said)
            own[e] = worst if worst <= -DECIDED else worst + most
            whole = headed[e] and held[e] > MAJORITY * held[0]
            gone[e] |= own[e] <= -DECIDED and not whole
            near = [weights.around.get(m, 0.0) for m in known]
            bad[e], good[e] = min(bad[e], *near), max(good[e], *near)
    scores = []
    for x in parts:
        inside = good[x.element] + bad[x.element] >= DECIDED
        if isinstance(x, Tag):
            # the elements left out are tags too, and all of their tags count outside an element of main text
            parent = elements[x.element].parent
            inside = good[parent] + bad[parent] >= DECIDED if parent >= 0 else inside
            scores.append(LEAST_TAG if inside else max(-1.0, min(LEAST_TAG, weights.tags.get(x.name, 0.0))))
        elif gone[x.element]:
            scores.append(0.0)
        else:
            odds = weights.prior + sum(weights.shape.get(s, 0.0) for s in x.shape) + good[x.element] + bad[x.element]
            scores.append(x.words * max(-1.0, min(1.0, odds)))
    start, stop = best_run(scores)
    if stop <= start:
        return ""
    chosen = [x for x in parts[start:stop] if isinstance(x, Block) and not gone[x.element]]
    e = _common(elements, [x.element for x in chosen])
    home = 0
    while e > 0:
        home = e if own[e] >= DECIDED else home
        e = elements[e].parent
    if home:
        within = [False] * len(elements)
        for e in range(home, len(elements)):
            within[e] = e == home or within[elements[e].parent]
        chosen = [x for k, x in enumerate(parts) if isinstance(x, Block) and not gone[x.element] and (start <= k < stop or within[x.element] and _LINKS not in x.shape)]
    return "\n".join(x.text for x in chosen)


def _common(elements: list[Element], used: list[int]) -> int:
    """The innermost element that holds all of ``used``."""
    home = used[0]
    for e in dict.fromkeys(used):
        while e != home:
            if e > home:
                e = elements[e].parent
            else:
                home = elements[home].parent
    return home


@functools.cache
def weights() -> Weights:
    """Weights from all labelled pages."""
    return fit(labelled())


def main_texts(pages: DataFrame, model: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``."""
    model = model or weights()
    pages = pages.select("page_id", "url", "html")
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch, "html"):
                texts = [extract(x, model) if x else "" for x in common.texts_of(part, "html")]
                columns = [part.column(0).cast(id_type), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(common.tidy(run), "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))
