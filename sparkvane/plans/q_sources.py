"""Queries on inboxes, site adapters, discovery, stored responses and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvane.functions import institutions
from sparkvane.operators import accept, frontier
from sparkvane.plans.registry import query, table
from sparkvane.sources import bundles, html, responses, sites


@query(
    "inbox_acceptance",
    """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, source || '/' || n_chars % 200 AS u, lower(text[1:12]) AS t FROM documents),
       s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, false AS ok, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS ts
         UNION ALL SELECT i, doc_id, NOT met, CASE WHEN met THEN us ELSE list_append(us, u) END, CASE WHEN met THEN ts ELSE list_append(ts, t) END
         FROM (SELECT d.*, us, ts, coalesce(list_contains(us, u), false) OR coalesce(list_contains(ts, t), false) AS met FROM s JOIN d ON d.i = s.i + 1))
       SELECT doc_id FROM s WHERE ok""",
)
def inbox_acceptance(spark, sf):
    """Documents as submissions: one is taken unless an earlier taken one has its address or its beginning."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), (F.col("n_chars") % 200).cast("string")).alias("u"), F.lower(F.substring("text", 1, 12)).alias("t"))
    return accept.accepted(d, "doc_id", ["u", "t"]).select("doc_id")


_TITLE = "'KOBİ haberi ' || page_id || ' için yeni bir başlık'"


@query(
    "press_and_listing_candidates",
    rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*') AS site, {_TITLE} AS title FROM pages)
       SELECT page_id, site || '/content/public-website/kurumsal-iletisim/' || page_id AS url, title, 20 AS score, 'title_length,positive_keyword,detail_path,garanti_press_detail' AS reason FROM p
       UNION ALL SELECT page_id, site || '/kampanyalar', title, 14, 'title_length,positive_keyword,listing_path' FROM p
       UNION ALL SELECT page_id, site || '/haber/' || page_id || '?id=login', title, 8, 'title_length,positive_keyword,detail_path' FROM p""",
)
def press_and_listing_candidates(spark, sf):
    """Every page with four links more: press, listing, news, and one that is negative by its path."""
    k, title = F.col("page_id").cast("string"), F.concat(F.lit("KOBİ haberi "), F.col("page_id").cast("string"), F.lit(" için yeni bir başlık"))
    link = lambda *path: F.concat(F.lit('<a href="'), *path, F.lit('">'), title, F.lit("</a>"))
    more = [link(F.lit("/content/public-website/kurumsal-iletisim/"), k), link(F.lit("/kampanyalar/")), link(F.lit("/haber/"), k, F.lit("?id=login")), link(F.lit("/haber/login/"), k)]
    pages = table(spark, sf, "pages").select("page_id", "url", F.concat("html", *more).alias("html"))
    return html.candidates(html.links(pages)).where(F.col("title").startswith("KOBİ haberi")).select("page_id", "url", "title", "score", "reason")


#: Listings as they stand on four kinds of sites: source id, address, what is added to a page.
_LISTINGS = (
    ("REG-052", "https://www.bddk.org.tr/Duyuru/Liste", '<a href="/Duyuru/Detay/{}">04.05.2026 Sermaye yeterliliği duyurusu</a>'),
    ("REG-098", "https://www.burgan.com.tr/basin", '<p><a href="/f/ticari-{}.pdf">Ticari finansman 2026-05-06</a></p>'),
    ("REG-148", "https://www.fibabanka.com.tr/kampanyalar", '<div class="new-campaign-card">Bitiş 01.06.2026 <a href="/kampanyalar/pos-{}">POS kampanyası</a></div>'),
    ("REG-238", "https://www.checkout.com/newsroom", '<a href="/newsroom/merchants-{}"><div>Jun 3, 2026</div><h3>Stablecoin settlement for US merchants</h3></a>'),
)


@query("site_items")
def site_items(spark, sf):
    """Pages as listings of sites with rules of their own: their articles, menus and the site's items."""
    n = (F.col("page_id") % len(_LISTINGS)).cast("int") + 1
    of = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _LISTINGS]), n)
    pages = table(spark, sf, "pages").select("page_id", of(1).alias("url"), F.concat("html", F.replace(of(2), F.lit("{}"), F.col("page_id").cast("string"))).alias("html"), of(0).alias("source_id"))
    return sites.items(pages)


@query("discovery_frontier")
def discovery_frontier(spark, sf):
    """Each nation starts from two of its customers; a customer links to those whose numbers its orders give."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = c.count()
    roots = c.groupBy("c_nationkey").agg(F.slice(F.array_sort(F.collect_set("c_custkey")), 1, 2).alias("first")).select(F.col("c_nationkey").alias("root"), F.posexplode("first").alias("position", "url"))
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("url"), (F.col("o_orderkey") * 31 % n).alias("link"), F.col("o_orderkey").alias("position"))
    return frontier.explore(roots, links).select("root", "url", "place", "depth")


_RESPONSE = r"""{"content": [{"type": "text", "text": "https://invented.example.com"}, {"type": "server_tool_use", "name": "web_search", "input": {"query": "q%s"}},
 {"type": "web_search_tool_result", "content": [{"type": "web_search_result", "url": "%s#part"}, {"type": "web_search_result", "url": "https://www.example.com.evil.test/%s"}, {"type": "web_search_result", "url": "%s"},
 {"type": "web_search_result", "url": "https://docs.example.com/%s"}]}, {"type": "web_search_tool_result", "content": {"error_code": "max_uses_exceeded"}}]}"""


@query(
    "search_responses",
    """SELECT page_id, [u FOR u IN [regexp_replace(url, '#.*$', ''), 'https://docs.example.com/' || page_id] IF regexp_matches(u, '^https://([a-z0-9.-]+[.])?example[.](com|org)(/|[?]|$)')] AS urls,
         ['q' || page_id] AS queries, ['max_uses_exceeded'] AS errors FROM pages""",
)
def search_responses(spark, sf):
    """A response for each page: its address twice, once with a fragment, a foreign one, and one more."""
    k, u = F.col("page_id").cast("string"), F.regexp_replace("url", "#.*$", "")
    body = F.format_string(_RESPONSE, k, u, k, u, k)
    return responses.search_results(table(spark, sf, "pages").select("page_id", body.alias("body")), ["example.com", "example.org"], "page_id")


@query("file_digests")
def file_digests(spark, sf):
    return bundles.file_digests(spark, f"{sf}/orders.parquet")


#: Names as they are written, for the rows of a table to choose from.
_NAMES = ("Garanti BBVA", "GARANTİ", "İş Bankası", "Türkiye İş Bankası", "Enpara.com", "Turkland Bank A.Ş.", "Deniz  Bank", "Visa", "BKM", "Webrazzi", "The Paypers", "T-Bank", "Yapı-Kredi")


@query(
    "institution_aliases",
    """WITH n(i, id, name, grp, scope) AS (VALUES (0, 'garanti_bbva', 'Garanti BBVA', 'Büyük Ölçekli Bankalar', 'Türkiye Bankacılığı'), (1, 'garanti_bbva', 'Garanti BBVA', 'Büyük Ölçekli Bankalar', 'Türkiye Bankacılığı'),
         (2, 'is_bankasi', 'İş Bankası', 'Büyük Ölçekli Bankalar', 'Türkiye Bankacılığı'), (3, 'is_bankasi', 'İş Bankası', 'Büyük Ölçekli Bankalar', 'Türkiye Bankacılığı'),
         (4, 'enpara', 'Enpara', 'Dijital/Gelişen Oyuncular', 'Türkiye Bankacılığı'), (5, 't_bank', 'T-Bank', 'Orta/Küçük Ölçekli Özel Bankalar', 'Türkiye Bankacılığı'), (6, 'denizbank', 'DenizBank', 'Büyük Ölçekli Bankalar', 'Türkiye Bankacılığı'),
         (7, 'visa', 'Visa', 'Global Ödeme Ağları', 'Global Gelişmeler'), (8, 'bkm', 'BKM', 'Sektör / Altyapı', 'Türkiye Bankacılığı'), (9, 'webrazzi', 'Webrazzi', 'Diğer', 'Türkiye Bankacılığı'),
         (10, 'the_paypers', 'The Paypers', 'Diğer', 'Global Gelişmeler'), (11, 't_bank', 'T-Bank', 'Orta/Küçük Ölçekli Özel Bankalar', 'Türkiye Bankacılığı'), (12, 'yapi_kredi', 'Yapı Kredi', 'Büyük Ölçekli Bankalar', 'Türkiye Bankacılığı'))
       SELECT c_custkey, id AS institution_id, name AS institution_name, grp AS institution_group, scope AS market_scope FROM customer JOIN n ON i = c_custkey % 13""",
)
def institution_aliases(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES)).cast("int") + 1)
    c = table(spark, sf, "customer").select("c_custkey", name.alias("n"))
    return c.select("c_custkey", institutions.institution_id("n").alias("institution_id"), institutions.institution_name("n").alias("institution_name"), institutions.group("n").alias("institution_group"), institutions.market_scope("n").alias("market_scope"))


@query(
    "institution_alias_join",
    """WITH k(i, id) AS (VALUES (0, 'garanti_bbva'), (1, 'garanti_bbva'), (2, 'is_bankasi'), (3, 'is_bankasi'), (4, 'enpara'), (5, 't_bank'), (6, 'denizbank'), (7, 'visa'), (8, 'bkm'), (9, 'webrazzi'), (10, 'the_paypers'), (11, 't_bank'), (12, 'yapi_kredi')),
         s AS (SELECT k.id, count(*) AS n FROM supplier JOIN k ON i = s_suppkey % 13 GROUP BY k.id)
       SELECT c_custkey, n FROM customer JOIN k ON i = c_custkey % 13 LEFT JOIN s USING (id)""",
)
def institution_alias_join(spark, sf):
    """Customers and the number of suppliers of one institution, whatever both sides call it."""
    name = lambda k: F.element_at(F.array(*map(F.lit, _NAMES)), (F.col(k) % len(_NAMES)).cast("int") + 1)
    s = table(spark, sf, "supplier").groupBy(institutions.institution_id(name("s_suppkey")).alias("id")).agg(F.count("*").alias("n"))
    # an identifier is a name too: underscores count as spaces
    return institutions.alias_join(table(spark, sf, "customer").select("c_custkey", name("c_custkey").alias("who")), s, "who", "id").select("c_custkey", "n")
