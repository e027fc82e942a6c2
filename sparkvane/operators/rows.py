"""Row operators: latest and first per key, lookups, top-k, dedup, conform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.functions.text import clean


def once(df: DataFrame) -> DataFrame:
    """``df`` whose columns are computed once, whatever is built on them.

    The optimiser puts the expressions of columns into every filter and column that names them, which
    multiplies those of columns that rest on each other. A column that is not deterministic, and that
    is asked for, ends that: filters stay above it.
    """
    return df.withColumn("_once", F.monotonically_increasing_id()).where("_once >= 0").drop("_once")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt evenly, or ``by`` columns, to four tasks a core: a small file of many rows is read by few tasks, which dear rules on its rows would keep to."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def conform(df: DataFrame, schema: T.StructType | Sequence[str]) -> DataFrame:
    """The columns of the schema in its order: missing ones null, extra ones dropped."""
    fields = schema.fields if isinstance(schema, T.StructType) else [T.StructField(c, T.StringType()) for c in schema]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key; row_number <= k lets Spark cut groups before the shuffle."""
    return numbered(df, keys, order).where(F.col("_n") <= k).drop("_n")


def latest(df: DataFrame, keys: Sequence[str], *by: str) -> DataFrame:
    """The last row of each key by the given columns, by map-side combining instead of a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def first_value(df: DataFrame, key: str, value: str, order: Sequence[Column], last: bool = False) -> DataFrame:
    """(key, value) of the first row of each key that is not empty (or of the last row)."""
    kept = df.where(clean(key) != "")
    order = [c.desc() for c in order] if last else list(order)
    return pick(kept, [key], order).select(key, value)


def repeated_keys(df: DataFrame, *keys: str | Column) -> DataFrame:
    """All rows of keys that occur more than once."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("_n", n).where("_n > 1").drop("_n")


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, n) by falling count, then value; the top k if given."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return out.limit(k) if k else out


def mode(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals; by counts, so hot keys combine map-side."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return pick(counts, keys, [F.desc("n"), F.asc_nulls_last(column)]).select(*keys, F.col(column).alias("mode"), "n")


def coalesce_join(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join in which empty values of ``columns`` are filled from the right side."""
    side = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = left.join(side, list(on), "left")
    filled = {c: F.when(clean(c) != "", F.col(c)).otherwise(F.col(f"_r_{c}")) if c in left.columns else F.col(f"_r_{c}") for c in columns}
    kept = [F.col(c) for c in left.columns if c not in filled]
    return joined.select(*kept, *[v.alias(c) for c, v in filled.items()])


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on a composite key in which null equals null; the right key columns are dropped."""
    side = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on])
    condition = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        condition = term if condition is None else condition & term
    return left.join(side, condition, how).drop(*[f"_k_{c}" for c in on])


def suffix_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_summary", how: str = "left") -> DataFrame:
    """Join in which right columns that clash get a suffix."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    return left.join(right.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns]), list(on), how)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The existing rows and those new rows whose keys are all absent (empty keys never match)."""
    fresh = new
    for k in keys:
        have = existing.where(clean(k) != "").select(F.col(k).alias(f"_{k}")).distinct()
        fresh = fresh.join(have, F.col(k) == F.col(f"_{k}"), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def facet(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values that are not empty."""
    return df.select(column).where(clean(column) != "").distinct().orderBy(column)


def facets_filter(df: DataFrame, chosen: dict[str, Sequence], date_column: str | None = None, start=None, end=None) -> DataFrame:
    """AND of memberships (empty choices are no filter) and an inclusive range of dates."""
    out = df
    for column, values in chosen.items():
        if values:
            out = out.where(F.col(column).isin(*values))
    if date_column and start is not None:
        out = out.where(F.col(date_column) >= F.lit(start))
    if date_column and end is not None:
        out = out.where(F.col(date_column) <= F.lit(end))
    return out


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(kept, removed) rows of each linked table for a set of ids."""
    kept = {n: t.join(ids.select(key), key, "left_anti") for n, t in tables.items()}
    removed = {n: t.join(ids.select(key), key, "left_semi") for n, t in tables.items()}
    return kept, removed


def collapse_origins(df: DataFrame, keys: Sequence[str], better: Sequence[str], origin: str) -> DataFrame:
    """One row per key, the best by ``better``, with all distinct origins joined by '; '."""
    rest = [c for c in df.columns if c not in keys and c != origin]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*better)).alias("_r"),
        F.array_join(F.array_sort(F.collect_set(origin)), "; ").alias(origin),
    ).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], origin)
