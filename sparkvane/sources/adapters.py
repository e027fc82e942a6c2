"""Site adapters as rows of one rule table, for ``html.adapt``.

Each row says which links of a site are items: a path pattern, words that must or must not
occur, the score, the bonus for a date, the shortest title, and how many a page gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions import dates
from sparkvane.functions.text import squeeze

SCHEMA = "site string, path_pattern string, positive string, negative string, score int, dated_bonus int, shortest int, k int"

_SMALL = r"(?iu)(kobi|esnaf|ticari|işletme|üye işyeri|pos\b|kurumsal)"
# fixed values: what the adapters of each kind of site look for
KINDS = {
    "publisher": (r"/(?:news|newsroom|press|blog|stories|article)s?/.+", r"(?i)(payment|merchant|card|sme|small business|fintech|bank|stablecoin|checkout)", r"(?i)(career|webinar|podcast|cookie)", 30, 8, 12, 25),
    "regulator": (r"/duyuru/detay/\d+", "", "", 28, 0, 12, 50),
    "announcement": (r"/(?:duyuru|haber)[^/]*/.+", _SMALL, r"(?iu)(kvkk|çerez|gizlilik)", 18, 8, 12, 50),
    "press_pdf": (r"\.pdf(?:$|\?)", r"(?iu)(kredi|ticari|kobi|iş birliği|ödül|finans)", r"(?iu)(tarife|sözleşme|form)", 22, 8, 12, 50),
    "campaign": (r"/kampanya(?:lar)?/.+", r"(?iu)(kampanya|taksit|puan|indirim|fırsat|avantaj|pos|kart)", "", 24, 6, 8, 50),
    "campaign_number": (r"/kampanyalar/detay/\d+", "", "", 16, 4, 8, 50),
    "small_business_card": (r"/.+", _SMALL, "", 24, 6, 12, 50),
    "export_news": (r"/icerik/.+", r"(?iu)(ihracat|dış ticaret|eximbank|ige)", r"(?iu)(kariyer|ihale)", 24, 10, 12, 50),
}


def rules(spark: SparkSession, sites: dict[str, str]) -> DataFrame:
    """The rule rows of sites, given as site -> kind."""
    return spark.createDataFrame([(site, *KINDS[kind]) for site, kind in sites.items()], SCHEMA)


def embedded(pages: DataFrame, array_name: str, fields: str) -> DataFrame:
    """Items out of a JSON array that a page embeds under ``array_name``; fields is a DDL struct."""
    body = F.regexp_extract("html", rf'(?s)"{array_name}"\s*:\s*(\[.*?\])\s*[,}}]', 1)
    parsed = F.from_json(body, f"array<struct<{fields}>>")
    return pages.select("page_id", F.explode(parsed).alias("item")).select("page_id", "item.*")


def grouped_press(links: DataFrame) -> DataFrame:
    """Anchors of one url together: the text that is a date gives the date, the longest other one the title."""
    rows = links.select("page_id", "href", squeeze("anchor").alias("a")).withColumn("d", dates.turkish("a"))
    only_date = F.col("d").isNotNull() & (F.length("a") <= 20)
    return rows.groupBy("page_id", "href").agg(F.max_by(F.col("a"), F.when(~only_date, F.length("a"))).alias("title"), F.max("d").alias("date")).where("title IS NOT NULL")


def asset_date(image_url: str):
    """The date in an asset's name: ddmmyy, or /yyyy/mm/ as the first of the month."""
    c = F.col(image_url)
    six = F.regexp_extract(c, r"(?:^|[^0-9])(\d{6})(?:[^0-9]|$)", 1)
    month = r"/(20\d{2})/(\d{2})/"
    return F.coalesce(F.try_to_date(F.when(six != "", six), "ddMMyy"), dates.date_of(F.regexp_extract(c, month, 1), F.regexp_extract(c, month, 2), F.lit("1")))
