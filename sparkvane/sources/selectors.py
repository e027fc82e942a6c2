"""Anchors of stored pages with what stands around them, by selector programs.

A program is a selector: compounds of tag, class, id and attribute, each below the one before
(``.content-reports li``). All programs are laid out as one automaton, a bit for each compound:
an element's state is that of its parent and the bits that it reaches itself, so a page is parsed
once, whatever the number of programs.

A row for each anchor with an address: its text, its title attribute, the first heading in it, the
text of its parent, its images, the programs that hold for an element around it (``scopes``), and
for each of those the nearest such element: whether the anchor is the first in it and, where asked for,
its text and its first strong text. What a row holds of an element's text ends after ``CONTEXT_CHARS`` characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.sources.html import parts

CONTEXT_CHARS = 20_000
#: The id of a script that holds a page's data, and the scope of the links found in it.
DATA_SCRIPT = "__NEXT_DATA__"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(["script", "style", "template"])
_PART = re.compile(r"([.#]?)([A-Za-z0-9_-]+)|\[([A-Za-z-]+)\]")


class Programs:
    """Selectors as one automaton."""

    def __init__(self, selectors: Mapping[str, str]) -> None:
        self.steps: list[tuple[str, frozenset[str], str, frozenset[str]]] = []
        self.first = 0
        self.names: dict[int, list[str]] = {}
        for name, selector in selectors.items():
            compounds = selector.split()
            self.first |= 1 << len(self.steps)
            for compound in compounds:
                found = _PART.findall(compound)
                tag = next((x for kind, x, _ in found if x and not kind), "")
                ident = next((x for kind, x, _ in found if kind == "#"), "")
                self.steps.append((tag.lower(), frozenset(x for kind, x, _ in found if kind == "."), ident, frozenset(a for _, _, a in found if a)))
            self.names.setdefault(len(self.steps) - 1, []).append(name)
        self.by_tag: dict[str, int] = {}
        self.any_tag = 0
        for i, (tag, *_) in enumerate(self.steps):
            if tag:
                self.by_tag[tag] = self.by_tag.get(tag, 0) | 1 << i
            else:
                self.any_tag |= 1 << i
        self.by_class = sum(1 << i for i, (_, classes, *_) in enumerate(self.steps) if classes)
        self.by_id = sum(1 << i for i, (_, _, ident, _) in enumerate(self.steps) if ident)

    def step(self, state: int, tag: str, attributes: Mapping[str, str]) -> tuple[int, list[str]]:
        """The state below an element in a parent of ``state``, and the programs that the element completes."""
        able = (self.by_tag.get(tag, 0) | self.any_tag) & (state << 1 | self.first)
        if "class" not in attributes:
            able &= ~self.by_class
        if "id" not in attributes:
            able &= ~self.by_id
        reached, names = 0, []
        classes = None
        while able:
            bit = able & -able
            able ^= bit
            i = bit.bit_length() - 1
            _, wanted, ident, present = self.steps[i]
            if wanted:
                classes = classes if classes is not None else frozenset(attributes.get("class", "").split())
            if (not wanted or wanted <= classes) and (not ident or attributes.get("id") == ident) and all(a in attributes for a in present):
                reached |= bit
                names += self.names.get(i, ())
        return state | reached, names


class _Element:
    __slots__ = ("tag", "state", "start", "end", "parent", "completes", "anchors", "strong", "heading", "lead", "images")

    def __init__(self, tag: str, state: int, start: int, parent: _Element | None, completes: list[str]) -> None:
        self.tag, self.state, self.start, self.end, self.parent, self.completes = tag, state, start, start, parent, completes
        self.anchors = 0
        self.strong: _Element | None = None
        self.heading: _Element | None = None
        self.lead: _Element | None = None
        self.images: list[str] = []


class _Page(HTMLParser):
    def __init__(self, programs: Programs) -> None:
        super().__init__(convert_charrefs=True)
        self.programs = programs
        self.words: list[str] = []
        self.root = _Element("", 0, 0, None, [])
        self.open = [self.root]
        self.watched: list[_Element] = []  # open anchors and completed elements
        self.found: list[tuple] = []
        self.completed: set[str] = set()
        self.silent = 0
        self.data: list[str] | None = None

    def updatepos(self, i, j):
        """Lines are not counted: no position is asked for."""
        return j

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        parent = self.open[-1]
        state, names = self.programs.step(parent.state, tag, a)
        e = _Element(tag, state, len(self.words), parent, names)
        self.completed.update(names)
        for w in self.watched:
            if tag == "strong":
                w.strong = w.strong or e
            if tag in ("h1", "h2", "h3", "h4"):
                w.heading = w.heading or e
            if tag in ("strong", "h2", "h3"):
                w.lead = w.lead or e
            if tag == "img" and a.get("src"):
                w.images.append(a["src"])
        if tag in _VOID:
            return
        self.open.append(e)
        if tag in _SILENT:
            self.silent += 1
            if tag == "script" and a.get("id") == DATA_SCRIPT:
                self.data = []
        if tag == "a" and a.get("href", "").strip():
            around, firsts, at = {}, {}, e
            while at is not None:
                for name in at.completes:
                    around.setdefault(name, at)
                at = at.parent
            for name, card in around.items():
                firsts[name] = card.anchors == 0
            for card in set(around.values()):
                card.anchors += 1
            self.found.append((a["href"].strip(), a.get("title", ""), e, around, firsts))
        if names or tag == "a":
            self.watched.append(e)

    def handle_endtag(self, tag):
        if self.open[-1].tag != tag and not any(e.tag == tag for e in self.open):
            return
        while True:
            e = self.open.pop()
            self._close(e)
            if e.tag == tag:
                return

    def _close(self, e: _Element) -> None:
        e.end = len(self.words)
        if e.tag in _SILENT:
            self.silent -= 1
        if self.watched and self.watched[-1] is e:
            self.watched.pop()

    def handle_data(self, data):
        if self.silent:
            if self.data is not None and self.open[-1].tag == "script":
                self.data.append(data)
        elif data.strip():
            self.words.append(" ".join(data.split()))

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close(self.open.pop())

    def text(self, e: _Element | None) -> str:
        return " ".join(self.words[e.start : e.end])[:CONTEXT_CHARS] if e is not None else ""


_CARD = pa.struct([("name", pa.string()), ("first", pa.bool_()), ("text", pa.string()), ("strong", pa.string())])
_FIELDS = [
    ("position", pa.int32()), ("href", pa.string()), ("attribute", pa.string()), ("anchor", pa.string()), ("heading", pa.string()),
    ("lead", pa.string()), ("parent", pa.string()), ("images", pa.list_(pa.string())), ("cards", pa.list_(_CARD)), ("on_page", pa.list_(pa.string())),
]
_SCHEMA = "position int, href string, attribute string, anchor string, heading string, lead string, parent string, images array<string>, cards array<struct<name string, first boolean, text string, strong string>>, on_page array<string>"


def _listed(data: str) -> list[tuple[str, str]]:
    """(title, url) of the announcements in a page's data."""
    try:
        listed = json.loads(data)["props"]["pageProps"]["fallback"][0]["announcementList"]
        return [(" ".join(str(x.get("title") or "").split()), str(x.get("url") or "").strip()) for x in listed]
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return []


def page_rows(html: str | None, programs: Programs, told: frozenset[str] | None = None) -> list[tuple]:
    """The rows of one page without its own columns: href, attribute, anchor, heading, lead, parent, images, cards, on_page.
    Elements of the programs in ``told`` (all) come with their texts."""
    page = _Page(programs)
    page.feed(html or "")
    page.finish()
    on_page = sorted(page.completed)
    rows = []
    for href, attribute, e, around, firsts in page.found:
        cards = [{"name": n, "first": firsts[n], **({"text": page.text(c), "strong": page.text(c.strong)} if told is None or n in told else {})} for n, c in around.items()]
        rows.append((href, " ".join(attribute.split()), page.text(e), page.text(e.heading), page.text(e.lead), page.text(e.parent), e.images, cards, on_page))
    for title, url in _listed("".join(page.data or [])):
        url = url if not url or re.match(r"https?://|/", url) else "/" + url
        if title and url:
            card = {"name": DATA_SCRIPT, "first": True, "text": title, "strong": ""}
            rows.append((url, "", title, "", "", title, [], [card], [*on_page, DATA_SCRIPT]))
    return rows


def anchors(pages: DataFrame, selectors: Mapping[str, str], told: frozenset[str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """The anchors of pages (page_id, url, html, source_id); only elements of the programs in ``told`` come with texts.
    The columns ``also`` of a page go along."""
    selectors = dict(selectors)
    page = [F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("base"), F.col("source_id").cast("string").alias("source_id"), *also]
    read = pages.select(*page, "html")
    schema = T.StructType([*read.schema.fields[:-1], *T.StructType.fromDDL(_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programs = Programs(selectors)
        for part in parts(batches):
            found, rows = [], []
            for i, html in enumerate(part.column(part.num_columns - 1).to_pylist()):
                own = page_rows(html, programs, told)
                found += [i] * len(own)
                rows += [(j, *r) for j, r in enumerate(own)]
            if rows:
                of_page = [c.take(pa.array(found)) for c in part.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*of_page, *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True))], names=schema.names)

    return read.mapInArrow(run, schema)
