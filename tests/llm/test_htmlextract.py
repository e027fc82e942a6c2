import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from sparkvane.llm import htmlextract, labelled_pages


def text_of(html):
    return htmlextract.extract(html, htmlextract.weights())


@pytest.mark.parametrize("seed", range(20))
def test_best_run_is_the_best_of_all_runs(seed):
    r = random.Random(seed)
    scores = [r.choice([-2, -1, -0.5, 0, 1, 1.5, 3]) for _ in range(r.randint(0, 25))]
    a, b = htmlextract.best_run(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert sum(scores[a:b]) == pytest.approx(best) and (b > a) == (best > 0)


ONE, TWO = "The first paragraph of the report, which is long enough to read.", "A second one follows it; it has a few words more than the first."
LINKS = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8))

PLANTED = {
    "article": f'<html><body><nav><ul>{LINKS}</ul></nav><article><h1>Head</h1><p>{ONE}</p><p>End.</p></article><footer>&copy; x</footer></body></html>',
    "unclosed": f'<body><nav><ul><li><a href="/a">A<li><a href="/b">B</ul></nav><article><h1>Head<p><b>{ONE}<br><p>End.',
    "divs": f'<body><div class="header"><a href="/">Site</a></div><div class="menu">{LINKS}</div><div class="article-content"><h1>Head</h1><p>{ONE}</p><div class="advert"><p>Buy this. It is the best of all there is.</p></div><p>End.</p></div><div class="sidebar"><p>{TWO}</p></div><div class="comments"><p>{TWO}</p></div><div class="footer"><p>{TWO}</p></div>',
    "semantic": f'<body><header><h1>Site</h1></header><main><article><h1>Head</h1><p>{ONE}</p><aside><p>{TWO}</p></aside><p>End.</p></article><section class="comments"><h2>3 comments</h2><article><p>{TWO}</p></article></section></main><form><p>Write to us, we read it all.</p><input></form>',
    "notice": f'<body><div id="cookie-notice"><p>{TWO}</p></div><div role="dialog" class="popup"><p>{TWO}</p></div><article><h1>Head</h1><p>{ONE}</p><p>End.</p></article><script>if (a < b) document.write("<p>no</p>")</script><style>p {{}}</style>',
    "unmarked": f'<body><div>{LINKS}</div><div><h1>A head of some words</h1><p>{ONE}</p><p>{TWO}</p></div><div>{LINKS}</div>',
}


@pytest.mark.parametrize("name", PLANTED)
def test_planted_pages(name):
    want = ["A head of some words", ONE, TWO] if name == "unmarked" else ["Head", ONE, "End."]
    assert text_of(PLANTED[name]) == "\n".join(want)


def test_blocks_references_and_white_space():
    page = "<article><h1>A &amp; B&nbsp;&lt;c&gt;</h1>\n<p> x\n\t y<br>z <b>b</b>old <i>&#x41;&eacute;</i> a < b &unknown; </p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><p></p><pre>k\n  l</pre><!-- no > yes --><p title='a > b'>end &am</p></article>"
    assert text_of(page) == "A & B <c>\nx y z bold Aé a < b &unknown;\none\ntwo\nc1\nc2\nk l\nend &am"


def test_pages_without_text():
    for page in ("", " \n", "<html><head><title>x</title></head><body></body></html>", "<nav><a href='/'>a</a></nav>", "<script>var x = 1;", "<!-- open", "<p", "<", "<a href=\"", "&"):
        assert text_of(page) == ""


def test_long_and_hostile_pages_take_linear_time():
    for page in ("<" * 300_000, "<p>" * 100_000, '<a href="x' * 20_000, "<p title='" * 20_000, "<b>" * 30_000 + "x", "</div>" * 100_000, "&" * 300_000, "<script>" * 50_000, "<!--" * 100_000, "<article>" + f"<p>{ONE}</p>" * 20_000):
        start = time.perf_counter()
        text_of(page)
        assert time.perf_counter() - start < 15, page[:12]


def words(text):
    return Counter(text.split())


def likeness(a, b):
    both = sum((words(a) & words(b)).values())
    return 2 * both / max(1, sum(words(a).values()) + sum(words(b).values()))


def main_text(html, ranges):
    """The labelled text, block by block."""
    parts = htmlextract.blocks_of(*htmlextract.parse(html))
    return "\n".join(x.text for x in parts if isinstance(x, htmlextract.Block) and any(a <= x.offset < b for a, b in ranges))


def test_kinds_of_pages_that_were_not_learned_from():
    """Each kind is held out in turn: the words found are mostly those of the labelled text."""
    found = []
    for kind in labelled_pages.PAGES:
        model = htmlextract.fit(labelled_pages.labelled(tuple(k for k in labelled_pages.PAGES if k != kind)))
        found += [likeness(main_text(*page), htmlextract.extract(page[0], model)) for page in labelled_pages.labelled((kind,))]
    assert sum(found) / len(found) > 0.85 and min(found) > 0.5


class Article(HTMLParser):
    """Blocks of the article element, read by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self._part(tag)

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self._part(tag)

    def _part(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_equals_another_parser_on_every_page(spark, sf):
    got = htmlextract.op11_html_extraction(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        reader = Article()
        reader.feed(pages[r.page_id].html)
        reader.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    page = PLANTED["article"]
    rows = [(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, None, None, None), (2, None, "", "", 0), (None, "v", page, "", 1)]
    got = htmlextract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    text = "\n".join(["Head", ONE, "End."])
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, None, "", 0), (None, "v", text, len(text))], key=repr)
    assert htmlextract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
