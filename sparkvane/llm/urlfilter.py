"""URL filters: rules, and logistic regression on hashed character n-grams.

Every step is DataFrame or SQL expressions; no Python runs on the executors.

Features: character n-grams of host and path (each with its own prefix and with borders),
hashed into ``BUCKETS`` buckets; a url's vector is its bucket counts over the square root of
the number of its n-grams. The regression is trained from a small labelled table by full
gradient descent with a ridge. As the weights start from zero they stay combinations of the
labelled rows, so the descent runs over one coefficient a row (``ROWS`` at most) with the
rows' inner products, and the bucket weights follow from the coefficients at the end.

Rules: a rule (host, path) fits its host and all subdomains where the url's path starts with
the rule's path; of the rules that fit, the longest (host and path together) decides.

Scale: pages are mapped, never shuffled; what they meet is one array of ``BUCKETS`` weights,
whose size is fixed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged by its (empty) features, which give the intercept; repeated rows are judged
each; extra columns are ignored. Labelled rows with a null url or label are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

BUCKETS = 4096
SIZES = (3, 4, 5)
STEPS = 1500
RATE = 5.0
RIDGE = 0.00005
#: Labelled urls used to fit (those with the smallest hash, if there are more).
ROWS = 400

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: A small labelled url table: urls of unwanted (1) and wanted (0) sites, each class in the same settings and with
#: the same additions, so that these tell nothing. The words are subjects: of unwanted sites what public block lists
#: are sorted by (gambling, adult, drugs, advertising and tracking, spam and fraud), of wanted ones plain nouns of
#: public life; both in alphabetical order. Each word is there alone and with one of the additions.
UNWANTED = (
    "ads adult bets betting bingo blackjack bonus cams casino cheap clicks counterfeit dating escorts fraud free gambling jackpot keygen loans "
    "lottery phishing pills poker porn prize replica roulette sex slots spam steroids tracker viagra warez win xxx"
).split()
WANTED = (
    "academy airport archive astronomy bakery bridge camera castle children clinic college cookery council ecology encyclopedia forest gallery garden harbour history "
    "hospital journal language library mountain museum newspaper orchestra physics pottery railway recipes school theatre translation university weather"
).split()
ADDITIONS = ("my-{}", "{}-online", "{}24", "the-{}", "{}-world", "best-{}", "{}-info")
SETTINGS = (
    ("http://", "com", "/en/12"), ("https://www.", "net", "/de/734"), ("https://", "org", "/es/4410/"), ("http://m.", "net", "/en/9056?page=2"), ("https://blog.", "com", "/fr/871.html"),
    ("https://", "net", "/"), ("http://www.", "org", "/en/32198#top"), ("http://blog.", "org", "/de/5"), ("https://m.", "com", "/es/60?ref=x"), ("http://", "org", "/index.html"),
)
#: (url, label): the words alone, then the words with an addition.
LABELLED = tuple(
    (f"{s}{form.format(word)}.{tld}{path}", label)
    for turn in (0, 1)
    for label, words in ((1, UNWANTED), (0, WANTED))
    for i, word in enumerate(words)
    for form in [ADDITIONS[i % len(ADDITIONS)] if turn else "{}"]
    for s, tld, path in [SETTINGS[(i + 3 * turn) % len(SETTINGS)]]
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """The buckets of all n-grams; a part shorter than n has none of that size."""

    def of_size(framed: Column, prefix: str, n: int) -> Column:
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.conv(F.substring(F.md5(F.concat(F.lit(prefix), framed.substr(i, F.lit(n)))), 1, 7), 16, 10).cast("int") % BUCKETS).cast("int"))

    def of(text: Column, prefix: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        return F.concat(*[of_size(framed, prefix, n) for n in SIZES])

    return F.concat(of(host, "h"), of(path, "p"))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    chain = None if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def train(labelled: DataFrame) -> DataFrame:
    """One row: ``weights`` (array of BUCKETS doubles) and ``intercept``; labelled has url and label."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("y"))
    rows = rows.withColumn("h", F.xxhash64("url")).orderBy("h", "url", "y").limit(ROWS)
    host, path = host_and_path(F.col("url"))
    listed = rows.select(F.struct("h", "url", "y", grams(host, path).alias("g")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))  # at most ROWS rows
    found = listed.select(F.posexplode("rs").alias("i", "r")).select("i", "r.y", F.size("r.g").alias("n"), F.explode("r.g").alias("bucket"))
    x = common.materialise(found.groupBy("i", "y", "n", "bucket").agg((F.count("*") / F.sqrt(F.col("n"))).alias("x")), "url-features")
    pairs = x.select("bucket", F.col("i"), F.col("x")).join(x.select("bucket", F.col("i").alias("j"), F.col("x").alias("z")), "bucket")
    inner = pairs.groupBy("i", "j").agg((F.sum(F.col("x") * F.col("z"))).alias("k"))
    ids = x.select("i", "y").distinct()
    entries = inner.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("m"))
    one = _kernel(ids, entries)
    n = F.size("ys")
    step = lambda alpha, _: F.transform(
        F.col("ks"),
        lambda row, i: F.element_at(alpha, i + 1) * (1 - RATE * RIDGE)
        + (F.element_at(F.col("ys"), i + 1) - 1 / (1 + F.exp(-F.aggregate(F.zip_with(row, alpha, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))) * RATE / n,
    )
    fitted = common.materialise(one.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("ys", lambda _: F.lit(0.0)), step).alias("alpha")), "url-alpha")
    alpha = fitted.select(F.posexplode("alpha").alias("i", "a"))
    weight = x.join(alpha, "i").groupBy("bucket").agg(F.sum(F.col("x") * F.col("a")).alias("w"))
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(weight, "bucket", "left")
    dense = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda s: s["w"]).alias("weights"))
    intercept = fitted.select(F.aggregate("alpha", F.lit(0.0), lambda s, v: s + v).alias("intercept"))
    return common.materialise(dense.select("weights", intercept.scalar().alias("intercept")), "url-model")


def _kernel(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: labels ``ys`` and the matrix ``ks`` of inner products (plus 1 for the intercept)."""
    listed = ids.join(entries, "i").select(F.struct("i", "y", F.map_entries("m").alias("m")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    at = lambda r, s: F.coalesce(F.element_at(F.map_from_entries(r["m"]), s["i"]), F.lit(0.0)) + 1.0
    return listed.select(F.transform("rs", lambda r: r["y"]).alias("ys"), F.transform("rs", lambda r: F.transform(F.col("rs"), lambda s: at(r, s))).alias("ks"))


def judge(pages: DataFrame, model: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of an unwanted page."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    fitted = model.first()  # BUCKETS doubles, whatever the input; folded into the plan as one constant
    weights = F.split(F.lit(",".join(map(repr, fitted["weights"]))), ",").cast("array<double>")
    intercept = F.lit(fitted["intercept"])
    with_grams = split.select("*", grams(F.col("host"), F.col("path")).alias("g"), rule_column(F.col("host"), F.col("path"), rules).alias("r"))
    total = F.aggregate("g", F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 1))
    p = 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size("g"), F.lit(1))) + intercept)))
    return with_grams.select("page_id", "host", "path", F.col("r.rule").alias("rule"), p.alias("p_block"), F.col("r.verdict").alias("by_rule")).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block"
    )


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table as SQL values."""
    values = ", ".join(f"('{u}', {y})" for u, y in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = common.read(spark, sf_dir, "pages", "page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")


def op2_sql() -> str:
    """The same rules, features, descent and verdicts as DuckDB SQL."""
    values = ", ".join(f"({i}, '{u}', {y})" for i, (u, y) in enumerate(LABELLED))

    def split(source: str) -> str:
        rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
        return f"""SELECT *, translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT * REPLACE (coalesce(url, '') AS url) FROM {source})"""

    def gram_list(column: str, prefix: str) -> str:
        parts = [f"[substr('^' || {column} || '$', CAST(i AS BIGINT), {n}) FOR i IN range(1, length({column}) + {4 - n})]" for n in SIZES]
        return f"[CAST(CAST('0x' || substr(md5('{prefix}' || g), 1, 7) AS BIGINT) % {BUCKETS} AS INT) FOR g IN list_concat({', '.join(parts[:2])}{''.join(', ' + p for p in parts[2:])})]"

    def rule(value) -> str:
        cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((h, p, v))}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
        return f"CASE {cases} END"

    return f"""
WITH RECURSIVE labelled(i, url, y) AS (VALUES {values}),
lg AS (SELECT i, y, list_concat({gram_list('host', 'h')}, {gram_list('path', 'p')}) AS g FROM ({split('labelled')})),
x AS (SELECT i, y, bucket, count(*) / sqrt(n) AS x FROM (SELECT i, y, len(g) AS n, unnest(g) AS bucket FROM lg) GROUP BY i, y, n, bucket),
inner_products AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS k FROM x a JOIN x b USING (bucket) GROUP BY ALL),
kernel AS (SELECT l.i, list(CAST(coalesce(p.k, 0) + 1 AS DOUBLE) ORDER BY m.i) AS k FROM lg l CROSS JOIN lg m LEFT JOIN inner_products p ON p.i = l.i AND p.j = m.i GROUP BY l.i),
ks AS (SELECT list(k ORDER BY i) AS ks FROM kernel),
ys AS (SELECT list(CAST(y AS DOUBLE) ORDER BY i) AS ys, count(*) AS n FROM lg),
fit(t, alpha) AS (
  SELECT 0, [CAST(0 AS DOUBLE) FOR y IN ys] FROM ys
  UNION ALL
  SELECT t + 1, [alpha[i] * {1 - RATE * RIDGE!r} + (ys[i] - 1 / (1 + exp(-list_dot_product(ks[i], alpha)))) * {RATE!r} / n FOR i IN range(1, n + 1)]
  FROM fit, ks, ys WHERE t < {STEPS}),
alphas AS (SELECT unnest(alpha) AS a, unnest(range(len(alpha))) AS i FROM fit WHERE t = {STEPS}),
weights AS (SELECT bucket, sum(x * a) AS w FROM x JOIN alphas USING (i) GROUP BY bucket),
intercept AS (SELECT sum(a) AS b FROM alphas),
p AS (SELECT page_id, host, path, list_concat({gram_list('host', 'h')}, {gram_list('path', 'p')}) AS g FROM ({split('pages')})),
s AS (SELECT page_id, sum(w) AS total FROM (SELECT page_id, unnest(g) AS bucket FROM p) JOIN weights USING (bucket) GROUP BY page_id)
SELECT p.page_id, host, path, {rule(lambda r: r[0] + r[1])} AS rule,
  coalesce({rule(lambda r: r[2])}, CASE WHEN coalesce(total, 0) / sqrt(greatest(len(g), 1)) + b >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s USING (page_id), intercept
"""
