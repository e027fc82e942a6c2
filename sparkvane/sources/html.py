"""Stored pages: text and links out of HTML, and candidates out of links.

Parsing needs a parser, so it runs as Arrow-batched Python over whole pages; everything that
is decided about the result afterwards is built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import dates, urls
from sparkvane.functions.text import matches, squeeze, text, title_from_slug
from sparkvane.operators.rows import once, pick
from sparkvane.plans.cascade import all_reasons, first_row, holds

_SKIP = {"script", "style", "noscript", "svg", "template"}
_FURNITURE = {"nav", "header", "footer", "aside", "form"}
_BREAK = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "main", "title"}
#: So many pages are parsed before their rows are handed on.
PAGES_AT_ONCE = 64
_VOID = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Page(HTMLParser):
    """One pass over a page: title, text lines outside furniture, anchors with their text, and dates in markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.lines: list[list[str]] = [[]]
        self.links: list[list] = []
        self.meta: dict[str, str] = {}
        self.jsonld: list[str] = []
        self.heading = ""
        self._open: list[str] = []
        self._skip = self._furniture = 0
        self._anchor: list | None = None
        self._json: list[str] | None = None

    def updatepos(self, i, j):
        """Lines are not counted: no position is asked for."""
        return j

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name") or a.get("itemprop")
            if name and a.get("content"):
                self.meta.setdefault(name.lower(), a["content"])
        if tag == "link" and a.get("rel", "").lower() == "canonical":
            self.meta.setdefault("canonical", a.get("href", ""))
        if tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        if tag in _VOID:
            if tag == "br":
                self.lines.append([])
            return
        self._open.append(tag)
        if tag in _SKIP:
            self._skip += 1
            if tag == "script" and "ld+json" in a.get("type", ""):
                self._json = []
        if tag in _FURNITURE:
            self._furniture += 1
        if tag in _BREAK:
            self.lines.append([])
        if tag == "a" and a.get("href"):
            self._anchor = [a["href"], [], a.get("title", ""), self.heading, bool(self._furniture)]

    def handle_endtag(self, tag):
        if tag not in self._open:
            return
        while self._open:
            top = self._open.pop()
            if top in _SKIP:
                self._skip -= 1
                if self._json is not None:
                    self.jsonld.append("".join(self._json))
                    self._json = None
            if top in _FURNITURE:
                self._furniture -= 1
            if top == "a" and self._anchor:
                self.links.append(self._anchor)
                self._anchor = None
            if top in _BREAK:
                self.lines.append([])
            if top == tag:
                break

    def handle_data(self, data):
        if self._json is not None:
            self._json.append(data)
        if self._skip:
            return
        if self._open and self._open[-1] == "title":
            self.title.append(data)
            return
        if self._open and self._open[-1] in ("h1", "h2", "h3") and data.strip():
            self.heading = " ".join(data.split())
        if self._anchor is not None:
            self._anchor[1].append(data)
        if not self._furniture:
            self.lines[-1].append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    if page._anchor:
        page.links.append(page._anchor)
    return page


def _flat(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def clean_text(html: str | None, shortest: int = 1) -> tuple[str, str]:
    """(title, text): distinct lines of at least ``shortest`` characters outside menus and the like."""
    page = parse(html)
    seen: dict[str, None] = {}
    for line in page.lines:
        flat = _flat(line)
        if len(flat) >= shortest:
            seen.setdefault(flat)
    return _flat(page.title), "\n".join(seen)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of ``PAGES_AT_ONCE`` pages: of a batch, which may hold 10,000 pages, so many at once become Python texts and rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            yield batch.slice(at, PAGES_AT_ONCE)


def clean_pages(pages: DataFrame, shortest: int = 1) -> DataFrame:
    """page_id, title, body of stored pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            done = [clean_text(h, shortest) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([b for _, b in done], pa.string())], names=["page_id", "title", "body"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, title string, body string")


LINK_COLUMNS = "page_id long, base string, position int, href string, anchor string, heading string, in_furniture boolean"


def links(pages: DataFrame) -> DataFrame:
    """Anchors of stored pages (page_id, url, html) with text, the heading above them and whether they stand in a menu."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[tuple] = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, (href, words, title, heading, furniture) in enumerate(parse(html).links):
                    out.append((page_id, url, i, href.strip(), _flat(words) or " ".join(title.split()), heading, furniture))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "base", "position", "href", "anchor", "heading", "in_furniture"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, LINK_COLUMNS)


_DATE_PUBLISHED = re.compile(r'"(?:datePublished|dateCreated)"\s*:\s*"([^"]+)"')


def markup_date(html: str | None) -> str:
    """The date that markup states: JSON-LD published or created, then meta tags, then a time tag; never the modification date."""
    page = parse(html)
    for block in page.jsonld:
        if m := _DATE_PUBLISHED.search(block):
            return m[1]
    for name in ("article:published_time", "datepublished", "date", "publish-date", "dc.date"):
        if page.meta.get(name):
            return page.meta[name]
    return page.meta.get("time", "")


# fixed values: words and paths that weigh in a link's score, and those that make it nothing
POSITIVE = (
    r"(haber|duyuru|basin|basın|bulten|bülten|kampanya|yenilik|is-birligi|iş-birliği|"
    r"kobi|kobİ|esnaf|ticari|pos|uye-isyeri|üye-işyeri|odeme|ödeme|garanti-bbva-dan|"
    r"garanti-bbvadan|qnb-kobi|qnb-kobİ|üye işyeri|uye isyeri|sanal-pos|sanal pos|"
    r"link-pos|link pos|ceppos|cep-pos|yazar-kasa|yazar kasa|kobi-rahat|kobi rahat|"
    r"isim-icin|işim-için|parapuan|taksit|aidat|dijital-kanal|dijital kanal|"
    r"e-fatura|efatura|e-arşiv|e-arsiv|e-dönüşüm|e-donusum|tahsilat|"
    r"press|release|newsroom|announcement|campaign|partnership)"
)
NEGATIVE = (
    r"(login|giris|giriş|arama|search|menu|footer|social|facebook|instagram|linkedin|"
    r"twitter|x\.com|youtube|gizlilik|cerez|çerez|yasal|kvkk|iletisim|iletişim|"
    r"sube|şube|atm|hesaplama|hesapla|musteri-ol|müşteri-ol|parola|site-haritasi|"
    r"site haritası|sozlesmeler|sözleşmeler|guvenlik|güvenlik|sona ermiştir|"
    r"qnb-first|qnb first|qnb-private|qnb private|bireysel|ihtiyac-kredisi|ihtiyaç kredisi|"
    r"konut|tasit|taşıt|miles|doktor|emekli|ogrenci|öğrenci|tatil|restoran|giyim|"
    r"market|akaryakit|akaryakıt|kozmetik|sinema|konser|cekilis|çekiliş|"
    r"kisisel-kredi-karti|kişisel kredi kartı)"
)
COMMERCE = (
    r"(kobi|kobiler|ticari|işletme|isletme|esnaf|pos|üye işyeri|uye isyeri|sanal pos|"
    r"ödeme|odeme|tahsilat|kredi|kart|nakit|api|kampanya|masraf|finansman|girişimci|girisimci|"
    r"merchant|commercial|business|sme)"
)
GENERIC_TITLE = r"^(detaylı bilgi|detayli bilgi|bülteni indir|bulteni indir|indir|download|pdf|oku|devamı|devami)$"
LOW_VALUE = (
    r"(üst düzey atama|ust duzey atama|atama gerçekleşti|atama gerceklesti|finansal sonuç|finansal sonuc|"
    r"aktif büyüklüğü|aktif buyuklugu|anaokulu|kampüs|kampus|yetenek programı|yetenek programi|"
    r"çalışanlarına yönelik|calisanlarina yonelik|kadınlar günü|kadinlar gunu|ödül|odul|"
    r"kültür|kultur|sanat|sosyal sorumluluk|global summit|liderlerini)"
)
LOW_VALUE_RESEARCH = r"(tasarruf araştırması|tasarruf arastirmasi)"
PRODUCT_PATH = (
    r"^/(?:(?:kobi|bireysel|ticari)/)?(?:kartlar|mevduat|krediler|dijital-bankacilik|"
    r"odemeler-ve-hizmetler|yatirim|sigorta-ve-emeklilik|hesaplama-araclari|"
    r"urun-ve-hizmet-ucretleri|sube-ve-atm)(?:/|$)"
)
PRESS_PATH = "/content/public-website/kurumsal-iletisim/"
DETAIL_PATH = r"(/content/public-website/kurumsal-iletisim/|/kurumsal-iletisim/.+|/kampanyalar/.+|/basin|/haber|/duyuru|/press|/newsroom|/campaign)"
LISTING_PATH = r"(/kurumsal-iletisim/garanti-bbvadan-haberler/?$|/kampanyalar/?$)"
#: Points: signals that must be there, points, name.
POINTS = (
    ("good_length", 2, "title_length"),
    ("positive", 2, "positive_keyword"),
    ("detail", 4, "detail_path"),
    ("listing", 10, "listing_path"),
    ("press", 12, "garanti_press_detail"),
    ("call detail", 1, "generic_detail_link"),
)


def link_score(title: Column, url: Column) -> Column:
    """struct(score, reason): points by ``POINTS``; low-value and product links, and length alone, are none."""
    p = urls.path(url)
    blob = F.concat_ws(" ", title, p)
    signals = {k: matches(blob, v) for k, v in {"positive": POSITIVE, "commerce": COMMERCE}.items()}
    signals["low"] = matches(blob, LOW_VALUE) | matches(blob, LOW_VALUE_RESEARCH)
    signals |= {k: matches(p, v) for k, v in {"detail": DETAIL_PATH, "listing": LISTING_PATH, "product": PRODUCT_PATH}.items()}
    signals |= {"press": p.contains(PRESS_PATH), "good_length": F.length(title).between(20, 180), "call": F.lower(title).isin("detaylı bilgi", "detayli bilgi")}
    met = [(holds(signals, wanted), points, name) for wanted, points, name in POINTS]
    reasons = F.array_join(all_reasons([(c, name) for c, _, name in met]), ",")
    total = sum((F.when(c, points).otherwise(0) for c, points, _ in met), F.lit(0))
    signals["length_only"] = reasons == "title_length"
    return first_row(
        signals,
        [("low -commerce", 0, "low_value_pr_noise"), ("product -listing -press", 0, "product_nav"), ("length_only", 0, "title_only"), ("", total, reasons)],
        "score reason",
    )


def negative_link(title: Column, url: Column) -> Column:
    """Whether a link leads to what is never news, by its title, host, path and fragment; listings and press
    pages, which score highest, never do."""
    p = urls.path(url)
    exempt = matches(p, LISTING_PATH) | p.contains(PRESS_PATH)
    blob = F.concat_ws(" ", title, urls.netloc(url), p, urls.part(url, 5))
    return ~exempt & (matches(blob, NEGATIVE) | matches(p, PRODUCT_PATH))


def link_title(anchor: Column | str, url: Column | str) -> Column:
    """The anchor's text; where it says nothing, the name of the file or the last part of a detail path."""
    a, p = squeeze(anchor), urls.path(url)
    vague = (a == "") | matches(a, GENERIC_TITLE)
    return F.when(vague & matches(p, r"\.pdf$"), urls.file_title(url)).when(vague & matches(p, DETAIL_PATH), title_from_slug(url)).otherwise(a)


def candidates(found: DataFrame, k: int = 50) -> DataFrame:
    """The k best distinct links of each page: on the page's host or below it, not negative, with a positive
    score, and a title of 20 to 180 characters unless the path is that of a detail page.

    Of equal urls the better scored, then the longer, then the earlier anchor stays.
    """
    raw = urls.absolute("href", "base")
    rows = once(found.where(~text("href").startswith("#")).select("page_id", "base", "position", "anchor", raw.alias("raw")))
    rows = once(rows.select("page_id", "base", "position", link_title("anchor", "raw").alias("title"), "raw", urls.canonical("raw").alias("url")))
    rows = rows.where(urls.scheme("url").isin("http", "https") & urls.below("base", "url") & ~negative_link(F.col("title"), F.col("raw")))
    rows = once(rows.withColumn("s", link_score(F.col("title"), F.col("url"))).withColumn("date", F.coalesce(dates.turkish("title"), dates.dated("url"))))
    rows = rows.where((F.col("s.score") > 0) & (F.length("title").between(20, 180) | matches(urls.path("url"), DETAIL_PATH)))
    best = pick(rows, ["page_id", "url"], [F.desc("s.score"), F.desc(F.length("title")), F.asc("position")])
    return pick(best, ["page_id"], [F.desc("s.score"), F.asc("url")], k).select("page_id", "url", "title", F.col("s.score").alias("score"), F.col("s.reason").alias("reason"), "date")


def adapt(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Site adapters as rows of a rule table, joined on the site instead of written as code.

    rules: site, path_pattern, positive, negative, score, dated_bonus, shortest, k. A link
    is kept if its path matches and its text has the positive pattern (or a date) and not the
    negative one; the score is the rule's, plus the bonus where a date is found.
    """
    rows = found.select("page_id", "base", "position", squeeze("anchor").alias("title"), urls.canonical(urls.absolute("href", "base")).alias("url"))
    joined = rows.withColumn("site", urls.domain("base")).join(F.broadcast(rules), "site")
    day = F.coalesce(dates.turkish("title"), dates.dated("url"))
    hit = F.expr("url rlike path_pattern") & (F.length("title") >= F.col("shortest"))
    positive = (F.col("positive") == "") | F.expr("concat_ws(' ', title, url) rlike positive")
    negative = (F.col("negative") != "") & F.expr("concat_ws(' ', title, url) rlike negative")
    kept = joined.withColumn("date", day).where(hit & (positive | F.col("date").isNotNull()) & ~negative)
    scored = kept.withColumn("points", F.col("score") + F.when(F.col("date").isNotNull(), F.col("dated_bonus")).otherwise(0))
    best = pick(scored, ["page_id", "url"], [F.desc("points"), F.desc(F.length("title")), F.asc("position")])
    ranked = best.withColumn("_r", F.expr("row_number() over (partition by page_id order by points desc, url)"))
    return ranked.where("_r <= k").select("page_id", "url", "title", F.col("points").alias("score"), "date")


def link_metrics(found: DataFrame) -> DataFrame:
    """Per page: links, useful ones, dated ones, the latest date, and the share of menu links."""
    title = squeeze("anchor")
    day = F.coalesce(dates.turkish(title), dates.dated("href"))
    useful = (F.length(title) >= 12) & ~matches(F.concat_ws(" ", title, F.col("href")), NEGATIVE) & ~F.col("in_furniture")
    return found.groupBy("page_id").agg(
        F.count("*").alias("links"),
        F.count_if(useful).alias("useful"),
        F.count_if(day.isNotNull()).alias("dated"),
        F.max(day).alias("latest"),
        (F.count_if(F.col("in_furniture")) / F.greatest(F.lit(1), F.count("*"))).alias("menu_share"),
    )


def expand_listings(candidates_: DataFrame, pages: DataFrame, hops: int = 1) -> DataFrame:
    """Candidates of stored pages that candidates point at, up to ``hops`` joins away; best per url."""
    by_url = links(pages.withColumn("url", urls.canonical("url")))
    known = candidates_
    frontier = candidates_
    for _ in range(hops):
        reached = frontier.select(F.col("page_id").alias("root"), F.col("url").alias("base")).distinct()
        further = candidates(by_url.join(reached, "base").drop("page_id").withColumnRenamed("root", "page_id"))
        frontier = further.join(known.select("page_id", "url"), ["page_id", "url"], "left_anti")
        known = known.unionByName(frontier)
    return pick(known, ["page_id", "url"], [F.desc("score"), F.desc(F.length("title"))])
