"""Scans in a sorted order over groups of any size.

A window over a group sorts the whole group in one task. Here rows are dealt by ranges of
(group, order), so that a group that holds a third of all rows lies in many parts; a window
runs within each part of a group, and what the earlier parts add is carried over. Only the
groups that straddle a boundary between two parts are carried, at most one for each boundary,
so that table has no more rows than there are parts and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.llm import common

PART = "_part"


def dealt(df: DataFrame, name: str, group: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of ``group`` and ``order``, written once, with the number of each row's range in ``_part``."""
    return common.materialise(df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()), name)


def _carried(df: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    return df.join(F.broadcast(carry), [PART, *group], "left")


def counted(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: the number of the row in its group, from 1, over a table of ``dealt``."""
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(PART, *group).orderBy(*order)))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(PART, *group).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL").drop("_n")
    return _carried(local, carry, group).withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def xored(df: DataFrame, group: list[str], order: list[str], *columns: str) -> DataFrame:
    """Each of ``columns`` (longs) becomes the exclusive or of its values up to the row, in its group."""
    window = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({c: F.bit_xor(c).over(window) for c in columns})
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(PART, *group).agg(*(F.bit_xor(c).alias(f"_of_{c}") for c in columns))
    carry = totals.withColumns({f"_of_{c}": F.bit_xor(f"_of_{c}").over(before) for c in columns}).where(F.col(f"_of_{columns[0]}").isNotNull())
    out = _carried(local, carry, group)
    return out.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"_of_{c}", F.lit(0))) for c in columns}).drop(*(f"_of_{c}" for c in columns))


def followed(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``name``: ``value`` of the next row of the group in the order of the column ``order``; null for the last."""
    local = df.withColumn(name, F.lead(value).over(Window.partitionBy(PART, *group).orderBy(order)))
    after = Window.partitionBy(*group).orderBy(PART)
    heads = df.groupBy(PART, *group).agg(F.min_by(value, F.col(order)).alias("_head"))
    carry = heads.withColumn("_after", F.lead("_head").over(after)).where("_after IS NOT NULL").drop("_head")
    return _carried(local, carry, group).withColumn(name, F.coalesce(name, "_after")).drop("_after")
