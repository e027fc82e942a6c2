"""Discovery from starting pages over links, first come first visited, with a budget for each root.

A queue per root gives the order: its starting pages, then the links of each visited page in the order of
their places on it; a page is queued once, and the first ``budget`` of the queue are visited. All roots
advance together by a level at a time: what a level adds is known before the next begins, so the places
in the queue are those of the one-by-one run. A level that could not be visited any more is not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.sources.tables import staged


def explore(roots: DataFrame, links: DataFrame, budget: int = 8) -> DataFrame:
    """(root, url, place, depth): the pages that each root visits, places from 1 to ``budget``.

    roots: root, url, position; links: url, link, position. Null urls are no pages; a page without links
    takes its place all the same. Rows of equal position come in the order of the url.
    """
    by_root = W.partitionBy("root").orderBy("at", "url")
    start = roots.where("url IS NOT NULL AND root IS NOT NULL").groupBy("root", "url").agg(F.min(F.struct(F.lit(0).alias("place"), F.col("position").cast("long").alias("position"))).alias("at"))
    start = start.withColumn("place", F.row_number().over(by_root)).where(F.col("place") <= budget)
    frontier = staged(start.select("root", "url", "place", F.lit(0).alias("depth")), "frontier")
    seen = frontier
    edges = links.where("url IS NOT NULL AND link IS NOT NULL").groupBy("url", "link").agg(F.min("position").cast("long").alias("position"))
    for depth in range(1, budget):
        full = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") < budget)
        reached = frontier.join(edges, "url").groupBy("root", F.col("link").alias("url")).agg(F.min(F.struct("place", "position")).alias("at"))
        fresh = reached.join(seen.select("root", "url"), ["root", "url"], "left_anti").join(full, "root")
        placed = fresh.withColumn("place", F.row_number().over(by_root)).where(F.col("place") <= F.lit(budget) - F.col("n"))
        frontier = staged(placed.select("root", "url", (F.col("place") + F.col("n")).cast("int").alias("place"), F.lit(depth).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def page_links(found: DataFrame, label: str) -> DataFrame:
    """url, link, position of anchors (as of ``html.links``) that stay on the page's host and whose text has ``label``."""
    from sparkvane.functions import urls
    from sparkvane.functions.text import matches

    link = urls.absolute("href", "base")
    rows = found.select(F.col("base").alias("url"), F.regexp_replace(link, "#.*$", "").alias("link"), "position", "anchor")
    return rows.where((urls.host("url") == urls.host("link")) & (urls.host("url") != "") & matches("anchor", label)).select("url", "link", "position")
