"""Queries on texts, urls, dates, identifiers, pages and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvane.functions import arrays, dates, ids, money, text, translate, urls
from sparkvane.operators import similar
from sparkvane.plans import classify, lint
from sparkvane.plans.registry import query, table
from sparkvane.sources import html


@query(
    "canonical_url",
    r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h,
           regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
        k AS (SELECT *, list_sort([x FOR x IN string_split(q, '&') IF x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','fbclid','gclid','msclkid','mc_cid','mc_eid')]) AS ps FROM p)
        SELECT page_id, s || '://' || h || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/+$', '') END
          || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical FROM k""",
)
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical("url").alias("canonical"))


@query(
    "url_parts",
    r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
          regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS domain, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""",
)
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.scheme("url").alias("scheme"), urls.host("url").alias("host"), urls.domain("url").alias("domain"), urls.path("url").alias("path"), urls.query("url").alias("query"))


@query(
    "same_site",
    r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS d FROM pages)
        SELECT page_id, d = 'example.com' OR ends_with(d, '.example.com') AS within_site, d = 'example.org' OR ends_with(d, '.example.org') OR d = 'example.net' OR ends_with(d, '.example.net') AS other FROM p""",
)
def same_site(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.same_site("url", F.lit("https://example.com/x")).alias("within_site"), urls.within("url", ["example.org", "example.net"]).alias("other"))


@query(
    "registry_url_key",
    r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '')
          || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) = '' OR regexp_matches(regexp_extract(url, '\?([^#]*)', 1), '^utm_[^&]*$') THEN '' ELSE '?' || regexp_extract(url, '\?([^#]*)', 1) END AS k FROM pages""",
)
def registry_url_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.plain("url").alias("k"))


@query("allowed_targets", r"SELECT page_id, starts_with(url, 'https://') AND regexp_matches(url, '^https://([^/?#]*\.)?example\.(com|org)([/?#]|$)') AS allowed FROM pages")
def allowed_targets(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.allowed("url", ["example.com", "example.org"]).alias("allowed"))


_HREFS = r"""SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages"""


@query("link_candidates", f"SELECT page_id, count(*) AS n, count(DISTINCT href) AS distinct_n, count(*) FILTER (starts_with(href, '/')) AS site_links FROM ({_HREFS}) GROUP BY page_id")
def link_candidates(spark, sf):
    # built-in extraction for plain anchors; sources.html.links parses full markup
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("href").alias("distinct_n"), F.count_if(F.col("href").startswith("/")).alias("site_links"))


@query("parsed_links")
def parsed_links(spark, sf):
    return html.links(table(spark, sf, "pages"))


@query("scored_candidates")
def scored_candidates(spark, sf):
    return html.candidates(html.links(table(spark, sf, "pages")))


@query("clean_html_text")
def clean_html_text(spark, sf):
    return html.clean_pages(table(spark, sf, "pages"))


@query("link_metrics")
def link_metrics(spark, sf):
    return html.link_metrics(html.links(table(spark, sf, "pages")))


@query(
    "content_ids",
    """SELECT doc_id, sha256(text) AS content_hash, 'RI-' || sha1(sha256(source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)))[1:12] AS recent_item_id,
         'SUM-' || sha1('RI:' || CAST(doc_id AS VARCHAR))[1:12] AS summary_id, 'REV-' || sha1(CAST(doc_id AS VARCHAR))[1:10] AS review_id, sha1(source || ' ' || lang) AS words_fingerprint FROM documents""",
)
def content_ids(spark, sf):
    print_ = ids.content_fingerprint("source", F.col("lang"), "doc_id", F.lit(""))
    return table(spark, sf, "documents").select(
        "doc_id",
        ids.content_hash("text").alias("content_hash"),
        ids.identifier("recent_item", print_).alias("recent_item_id"),
        ids.identifier("summary", F.lit("RI"), "doc_id").alias("summary_id"),
        ids.identifier("review", "doc_id").alias("review_id"),
        ids.words_fingerprint("source", F.lit(""), "lang").alias("words_fingerprint"),
    )


@query(
    "date_extract",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS turkish, CAST(o_orderdate AS DATE) AS numeric, CAST(o_orderdate AS DATE) AS english, CAST(o_orderdate AS DATE) AS from_url FROM orders""",
)
def date_extract(spark, sf):
    d = F.to_date("o_orderdate")
    names = F.array(*[F.lit(m.capitalize()) for m, _ in dates.MONTHS])
    words = F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.element_at(names, F.month(d)), F.lit(" "), F.year(d).cast("string"), F.lit(" tarihinde"))
    english = F.concat(F.element_at(F.array(*[F.lit(m.capitalize()) for m in dates.ENGLISH]), F.month(d)), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"))
    o = table(spark, sf, "orders").select("o_orderkey", words.alias("w"), F.date_format(d, "d.M.yyyy").alias("n"), english.alias("e"), F.concat(F.lit("https://x.example/news/20"), F.date_format(d, "yy/MM/dd"), F.lit("/a")).alias("u"), d.alias("d"))
    return o.select("o_orderkey", dates.turkish("w").alias("turkish"), dates.turkish("n").alias("numeric"), dates.english("e").alias("english"), F.when(F.year("d") < 2000, F.col("d")).otherwise(dates.dated("u")).alias("from_url"))


@query(
    "money_percent_parse",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS amount,
         CAST(CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 3 = 0 THEN round(p_size + 0.25, 2) END AS DOUBLE) AS share, p_partkey % 10 = 0 AS free FROM part""",
)
def money_percent_parse(spark, sf):
    shown = F.format_number("p_retailprice", 2)  # 1,234.50
    turkish = F.translate(F.translate(F.translate(shown, ",", "_"), ".", ","), "_", ".")  # 1.234,50
    written = F.when(F.col("p_partkey") % 10 == 0, "Ücretsiz").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("%"), F.col("p_size").cast("string"), F.lit(",25"))).otherwise(F.concat(turkish, F.lit(" TL")))
    p = table(spark, sf, "part").select("p_partkey", written.alias("w"))
    return p.select("p_partkey", F.round(money.amount("w"), 2).alias("amount"), F.round(money.percentage("w"), 2).alias("share"), money.is_free("w").alias("free"))


@query(
    "pricing_bucket_sort",
    """SELECT bucket, p_partkey, place FROM (SELECT p_partkey, bucket, row_number() OVER (PARTITION BY bucket ORDER BY p_retailprice, p_partkey) AS place FROM (
         SELECT *, CASE WHEN contains(t, 'pos') THEN 'POS' WHEN contains(t, 'promo') THEN 'Paket / Kredi' WHEN contains(t, 'eft') OR contains(t, 'ach') THEN 'Yurt içi transfer' ELSE 'Kartlar' END AS bucket
         FROM (SELECT *, replace(lower(p_type), 'promo', 'paket promo') AS t FROM part))) WHERE place <= 5""",
)
def pricing_bucket_sort(spark, sf):
    from sparkvane.operators.rows import numbered

    words = F.replace(F.lower("p_type"), F.lit("promo"), F.lit("paket promo"))
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", classify.fee_bucket(F.lit(""), words).alias("bucket"))
    return numbered(p, ["bucket"], [F.asc("p_retailprice"), F.asc("p_partkey")], "place").where("place <= 5").select("bucket", "p_partkey", F.col("place").cast("long").alias("place"))


@query("json_array_membership", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, list_sort(list(event_id))[1:3] AS first_ids FROM events GROUP BY 1")
def json_array_membership(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    g = e.groupBy("k").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("all"))
    return g.select("k", "n", F.slice("all", 1, 3).alias("first_ids"))


@query("cluster_membership", "SELECT d.doc_id, c.lang AS cluster_id FROM documents d JOIN (SELECT lang, min(doc_id) AS m FROM documents GROUP BY lang) c ON d.doc_id % 50 = c.m")
def cluster_membership(spark, sf):
    d = table(spark, sf, "documents")
    clusters = d.groupBy("lang").agg(F.min("doc_id").alias("m")).select("lang", F.to_json(F.array(F.col("m").cast("string"))).alias("item_ids"))
    members = clusters.select(F.col("lang").alias("cluster_id"), F.explode(arrays.id_list("item_ids")).alias("item"))
    return d.select("doc_id", (F.col("doc_id") % 50).cast("string").alias("item")).join(F.broadcast(members), "item").select("doc_id", "cluster_id")


@query(
    "parse_model_json",
    """SELECT conv_id, turn, turn AS value FROM conversations""",
)
def parse_model_json(spark, sf):
    reply = F.concat(F.lit("```json\n{\"turn\": "), F.col("turn").cast("string"), F.lit(", \"findings\": []}\n```"))
    prose = F.concat(F.lit("Here it is: {\"turn\": "), F.col("turn").cast("string"), F.lit("} done"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, reply).otherwise(prose).alias("reply"))
    return c.select("conv_id", "turn", F.get_json_object(arrays.object_text("reply"), "$.turn").cast("long").alias("value"))


@query("tags_map", "SELECT doc_id, source AS source_tag, lang AS lang_tag FROM documents")
def tags_map(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("source:"), F.col("source"), F.lit("; lang:"), F.col("lang"), F.lit(";;x")).alias("tags"))
    return d.select("doc_id", F.element_at(arrays.tags("tags"), "source").alias("source_tag"), text.tag("tags", "lang").alias("lang_tag"))


@query(
    "sentence_limit",
    r"""SELECT conv_id, turn, array_to_string([s FOR s IN string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) IF s <> ''][1:2], ' ') AS two FROM conversations""",
)
def sentence_limit(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.first_sentences("text", 2).alias("two"))


@query(
    "compact_text",
    r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations), d AS (SELECT *, rtrim(t[1:79]) AS cut FROM c),
        e AS (SELECT *, length(regexp_extract(cut, '^(.*) [^ ]*$', 1)) AS sp, contains(cut, ' ') AS has FROM d)
        SELECT conv_id, turn, CASE WHEN length(t) <= 80 THEN t WHEN has AND sp > 44 THEN rtrim(cut[1:sp]) || '…' ELSE rtrim(cut) || '…' END AS short FROM e""",
)
def compact_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.shorten("text", 80).alias("short"))


def stem_sql(w: str) -> str:
    """A word's stem by the tables of ``translate``, as SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    name = lambda c: f"coalesce(map_extract(MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in translate.CONCEPTS.items())}}}, {c})[1], {c})"
    bare = f"regexp_replace(regexp_replace({w}, '{translate.GENITIVE}', ''), '{translate.COPULA}', '')"
    cut = " ".join(f"WHEN length(c) > {len(e) + 3} AND ends_with(c, '{e}') THEN left(c, length(c) - {len(e)})" for e in translate.ENDINGS)
    return f"(SELECT {name('e')} FROM (SELECT CASE {cut} ELSE c END AS e FROM (SELECT {name('b')} AS c FROM (SELECT {bare} AS b))))"


_PHRASED = "regexp_replace(regexp_replace(lower(text), '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g')"
for _phrase, _word in translate.PHRASES.items():
    _PHRASED = f"replace({_PHRASED}, '{_phrase}', '{_word}')"
_SHOWN = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in translate.DISPLAY.items()) + " ELSE word END"


@query(
    "word_frequency",
    f"""WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace({_PHRASED}, '[^a-zçğıöşü\\s]', ' ', 'g'), '\\s+')) AS w FROM documents WHERE text IS NOT NULL),
        d AS (SELECT w, count(*) AS n FROM w GROUP BY w),
        k AS (SELECT {stem_sql('w')} AS word, n FROM d)
        SELECT {_SHOWN} AS word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 3 GROUP BY 1""",
)
def word_frequency(spark, sf):
    """All words of all texts, by stem."""
    return translate.word_frequencies(table(spark, sf, "documents"), "text", stop=())


@query(
    "word_frequency_stop",
    f"""WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace({_PHRASED}, '[^a-zçğıöşü\\s]', ' ', 'g'), '\\s+')) AS w FROM documents WHERE text IS NOT NULL),
        d AS (SELECT w, count(*) AS n FROM w GROUP BY w),
        k AS (SELECT {stem_sql('w')} AS word, n FROM d)
        SELECT {_SHOWN} AS word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 3 AND word NOT IN ({', '.join(repr(w) for w in translate.STOP_WORDS)}) GROUP BY 1""",
)
def word_frequency_stop(spark, sf):
    """The same without the words that are not counted."""
    return translate.word_frequencies(table(spark, sf, "documents"), "text")


@query(
    "lint_score",
    """WITH t AS (SELECT doc_id, lower(text) AS x FROM documents),
       s AS (SELECT doc_id, 3 * CAST((length(x) - length(replace(x, 'all rights reserved', ''))) / 19 AS BIGINT) + CAST((length(x) - length(replace(x, 'license', ''))) / 7 AS BIGINT) AS score FROM t)
       SELECT doc_id, score, score >= 3 AS needs_review, score >= 6 AS needs_rewrite FROM s""",
)
def lint_score(spark, sf):
    weights = (("all rights reserved", 3), ("license", 1))
    out = lint.score("text", phrases=weights)
    return table(spark, sf, "documents").select("doc_id", out["score"].cast("long").alias("score"), out["needs_review"].alias("needs_review"), out["needs_rewrite"].alias("needs_rewrite"))


@query(
    "token_jaccard_pairs",
    r"""WITH t AS (SELECT p_partkey, p_brand, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-zçğıöşü0-9]+'))) AS raw FROM part),
        k AS (SELECT p_partkey, p_brand, [w FOR w IN raw IF length(w) >= 4] AS w FROM t)
        SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w)) AS shared FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
        WHERE len(list_intersect(a.w, b.w)) >= 3 AND len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.22""",
)
def token_jaccard_pairs(spark, sf):
    """Whole titles, as the operator is meant for: names and types of parts within a brand."""
    d = table(spark, sf, "part").select("p_partkey", "p_brand", text.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    return similar.token_pairs(d, ["p_brand"], "p_partkey", "t").select("p_brand", "a", "b", "shared")


@query("fuzzy_title_join")
def fuzzy_title_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", text.squeeze(F.substring_index("text", "\n", 1)).alias("title"))
    return similar.fuzzy_pairs(d, "source", "doc_id", "title")


@query("greedy_clusters")
def greedy_clusters(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", text.tokens("text").alias("t"), F.col("n_chars").alias("o"))
    return similar.greedy_clusters(d, "source", "doc_id", "t", "o")


@query("greedy_dedup")
def greedy_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", text.dedup_title(F.substring_index("text", "\n", 1)).alias("title"), F.lit(None).cast("date").alias("d"), F.col("n_chars").alias("o"))
    return similar.greedy_dedup(d, "source", "doc_id", "title", "o", "d")


@query("evidence_containment", r"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 15""")
def evidence_containment(spark, sf):
    return similar.containment(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")))


@query("alias_join", "SELECT s_suppkey, lower(n_name) AS institution_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT contains(n_name, ' ')")
def alias_join(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", text.slug("n_name").alias("institution_id"), "n_name").where(~F.col("n_name").contains(" "))
    return table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "institution_id")


@query("coerced_values", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'OTHER' END AS segment FROM customer")
def coerced_values(spark, sf):
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x; "), F.lower("c_mktsegment"))).otherwise(F.concat(F.lit("is "), F.col("c_mktsegment")))
    return table(spark, sf, "customer").select("c_custkey", arrays.coerce_value(written, ["BUILDING", "MACHINERY"], "OTHER").alias("segment"))


@query(
    "source_term_ranking",
    """SELECT doc_id, score FROM (SELECT doc_id, CAST((length(x) - length(replace(x, 'the ', ''))) / 4 + (length(x) - length(replace(x, 'tion', ''))) / 4 AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS x FROM documents)) ORDER BY score DESC, doc_id LIMIT 25""",
)
def source_term_ranking(spark, sf):
    score = text.occurrences("text", "the ") + text.occurrences("text", "tion")
    return table(spark, sf, "documents").select("doc_id", score.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)
