"""Connected components by alternating large and small stars, on edges alone.

Each round has two aggregations with map-side combining and two joins on a node; Spark's
adaptive execution splits the joins at nodes of high degree. Rounds are cut with written
tables in the shared folder, and the loop ends when a round changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.llm import common


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a > b)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    lower = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lower, "a").select(F.col("b").alias("u"), "m", "a")
    pairs = small.select(F.col("u").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is its smallest node."""
    now = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = common.materialise(_stars(now), "stars")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge set that does not depend on its order."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
