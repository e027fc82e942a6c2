"""Acceptance in order: a row is taken unless an earlier taken row has one of its keys.

Row by row this is a loop with growing sets of keys. Here it runs in rounds: of the rows that
are still open, those that no earlier open row could stand in the way of are taken at once, and
open rows that meet a key of a taken row are refused. Each round decides at least the first open
row, and in unordered data nearly all; rows that form one long chain, each in the way of the next,
take as many rounds as the chain has links.

Each round is a combined minimum per key and a join on it; no key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.sources.tables import staged


def _earliest(rows: DataFrame, gives: str, i: int) -> DataFrame:
    """The least rank that gives each key."""
    return rows.where(F.col(gives).isNotNull()).groupBy(F.col(gives).alias(f"_key{i}")).agg(F.min("_rank").alias(f"_first{i}"))


def _met(rows: DataFrame, by: DataFrame, asks: Sequence[str], gives: Sequence[str]) -> DataFrame:
    """``rows`` with ``_behind``: whether a row of ``by`` of lesser rank gives a key that the row asks for."""
    out, behind = rows, F.lit(False)
    for i, (ask, give) in enumerate(zip(asks, gives, strict=True)):
        out = out.join(_earliest(by, give, i), F.col(ask) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
        behind = behind | F.coalesce(F.col(f"_first{i}") < F.col("_rank"), F.lit(False))
    return out.withColumn("_behind", behind).drop(*(f"_first{i}" for i in range(len(asks))))


def accepted(rows: DataFrame, rank: str, asks: Sequence[str], gives: Sequence[str] | None = None) -> DataFrame:
    """The rows that are taken, in the order of ``rank`` (distinct and not null).

    A row is refused if for some i an earlier taken row's ``gives[i]`` equals its ``asks[i]`` (by default
    they are the same columns). Null keys meet nothing.
    """
    gives = list(gives or asks)
    wide = rows.select(F.struct(*rows.columns).alias("_row"), F.col(rank).alias("_rank"), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(asks)), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(gives)))
    ask, give = [f"_a{i}" for i in range(len(asks))], [f"_g{i}" for i in range(len(gives))]
    still = staged(wide, "open")
    taken: DataFrame | None = None
    while not still.isEmpty():
        judged = staged(_met(still, still, ask, give), "judged")
        now = judged.where("NOT _behind").drop("_behind")
        taken = now if taken is None else taken.unionByName(now)
        still = staged(_met(judged.where("_behind").drop("_behind"), now, ask, give).where("NOT _behind").drop("_behind"), "open")
    return (wide if taken is None else taken).select("_row.*")


def standing(rows: DataFrame, taken: DataFrame, rank: str, asks: Sequence[str], gives: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``: whether an earlier row of ``taken`` stands in their way."""
    by = taken.select(F.col(rank).alias("_rank"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(gives)))
    marked = _met(rows.withColumn("_rank", F.col(rank)), by, list(asks), [f"_g{i}" for i in range(len(gives))])
    return marked.withColumnRenamed("_behind", name).drop("_rank")
