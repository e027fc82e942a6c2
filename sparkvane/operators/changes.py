"""Change detection, failure streaks, snapshots, table differences and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.functions.text import clean, text


def change_status(key: Sequence[str], order: Sequence[str | Column], content_hash: Column, failed: Column) -> Column:
    """error, new_source, unchanged or changed, against the last good fetch of the key.

    A failed row or an empty hash is an error and leaves the last good hash as it was.
    """
    good = ~F.coalesce(failed, F.lit(False)) & (clean(content_hash) != "")
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    last_good = F.last(F.when(good, content_hash), ignorenulls=True).over(before)
    return F.when(~good, "error").when(last_good.isNull(), "new_source").when(last_good == content_hash, "unchanged").otherwise("changed")


def failure_streak(df: DataFrame, key: Sequence[str], order: Sequence[str], failed: Column, name: str = "failures") -> DataFrame:
    """Failures in a row up to each row: islands between successes, counted."""
    upto = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    flag = F.coalesce(failed, F.lit(False)).cast("int")
    marked = df.withColumn("_island", F.sum(1 - flag).over(upto)).withColumn("_flag", flag)
    within = W.partitionBy(*key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn(name, F.sum("_flag").over(within)).drop("_island", "_flag")


def row_digest(columns: Sequence[str]) -> Column:
    """A digest of the columns' texts in which null equals empty, as in files."""
    return F.sha2(F.concat_ws("\x1f", *[text(c) for c in columns]), 256)


def diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change) with change in new, removed, changed; rows that are equal are left out."""
    b = before.select(F.col(key).alias("_b"), row_digest(columns).alias("_db"))
    a = after.select(F.col(key).alias("_a"), row_digest(columns).alias("_da"))
    joined = b.join(a, F.col("_b") == F.col("_a"), "full")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when(F.col("_db") != F.col("_da"), "changed")
    return joined.select(F.coalesce("_b", "_a").alias(key), change.alias("change")).where("change IS NOT NULL")


def table_digest(df: DataFrame, columns: Sequence[str]) -> tuple:
    """Rows, and two order-free sums of row hashes: equal for equal bags of rows."""
    h = F.xxhash64(*[text(c) for c in columns])
    other = F.xxhash64(F.lit(1), *[text(c) for c in columns])
    low = lambda c: F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF)))
    return tuple(df.agg(F.count("*"), F.bit_xor(h), low(h), low(other)).first())


# fixed values: the columns that people fill in, which a merge never overwrites
PROTECTED = ("review_status", "reviewer", "review_notes", "approved_at", "analyst_note", "reviewed_at", "created_at")


def merge_preserving(existing: DataFrame, new: DataFrame, key: str, columns: Sequence[str], preserved: Sequence[str], protected: Sequence[str] = PROTECTED) -> DataFrame:
    """Merge regenerated rows into a queue without touching decisions.

    Rows of both sides take the new values but for the protected columns; old rows that are
    not regenerated stay only if their review_status is one of ``preserved``; new rows are
    added. ``_action`` tells updated, kept and inserted rows apart.
    """
    o = existing.select(F.struct(*[F.col(c) if c in existing.columns else F.lit(None).cast("string").alias(c) for c in columns]).alias("o"), F.col(key).alias("_ko"))
    n = new.select(F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in columns]).alias("n"), F.col(key).alias("_kn"))
    joined = o.join(n, F.col("_ko") == F.col("_kn"), "full")
    action = F.when(F.col("_ko").isNull(), "inserted").when(F.col("_kn").isNotNull(), "updated").when(F.col("o.review_status").isin(*preserved), "kept")
    given = set(new.columns)
    value = lambda c: F.when(F.col("_ko").isNull(), F.col(f"n.{c}")).when(F.col("_kn").isNull() | F.lit(c in protected or c not in given), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*[value(c).alias(c) for c in columns], action.alias("_action")).where("_action IS NOT NULL")


def merge_archive(existing: DataFrame, new: DataFrame, key: str, columns: Sequence[str], sticky: Sequence[str] = ("archive_id", "archived_at")) -> DataFrame:
    """Archive upsert: every old row stays, sticky columns keep their old values, and only real changes count as updated."""
    o = existing.select(F.struct(*columns).alias("o"), F.col(key).alias("_ko"))
    n = new.select(F.struct(*columns).alias("n"), F.col(key).alias("_kn"))
    joined = o.join(n, F.col("_ko") == F.col("_kn"), "full")
    value = lambda c: F.when(F.col("_kn").isNull() | (F.col("_ko").isNotNull() & F.lit(c in sticky)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    differs = F.lit(False)
    for c in columns:
        if c not in sticky:
            differs = differs | ~text(F.col(f"o.{c}")).eqNullSafe(text(F.col(f"n.{c}")))
    action = F.when(F.col("_ko").isNull(), "inserted").when(F.col("_kn").isNull(), "kept").when(differs, "updated").otherwise("same")
    return joined.select(*[value(c).alias(c) for c in columns], action.alias("_action"))


def fill_empty(existing: DataFrame, new: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Registry upsert by key: only empty values are filled, or all are overwritten; unknown keys are added."""
    o = existing.select(F.struct(*columns).alias("o"), F.col(key).alias("_ko"))
    n = new.select(F.struct(*columns).alias("n"), F.col(key).alias("_kn"))
    joined = o.join(n, F.col("_ko") == F.col("_kn"), "full")

    def value(c: str) -> Column:
        old, fresh = F.col(f"o.{c}"), F.col(f"n.{c}")
        both = F.when(text(fresh) != "", fresh).otherwise(old) if overwrite else F.when(text(old) != "", old).otherwise(fresh)
        return F.when(F.col("_ko").isNull(), fresh).when(F.col("_kn").isNull(), old).otherwise(both)

    return joined.select(*[value(c).alias(c) for c in columns])


def fold_state(previous: DataFrame, batch: DataFrame, key: str, counters: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Running state per source: counters add up; carried values stay unless the batch has new ones."""
    p = previous.select(key, *[F.col(c).alias(f"_p_{c}") for c in (*counters, *carried)])
    b = batch.select(key, *[F.col(c).alias(f"_b_{c}") for c in (*counters, *carried)])
    joined = p.join(b, key, "full")
    add = [(F.coalesce(F.col(f"_p_{c}"), F.lit(0)) + F.coalesce(F.col(f"_b_{c}"), F.lit(0))).alias(c) for c in counters]
    keep = [F.coalesce(F.col(f"_b_{c}"), F.col(f"_p_{c}")).alias(c) for c in carried]
    return joined.select(key, *add, *keep)


def translate_status(df: DataFrame, ids: DataFrame, key: str, values: dict[str, Column | str]) -> DataFrame:
    """Update by join: rows whose key is among ``ids`` take the values."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    put = lambda c: F.when(F.col("_hit"), values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c) if c in df.columns else F.lit(None)).alias(c)
    return marked.select(*[put(c) if c in values else F.col(c) for c in df.columns], *[put(c) for c in values if c not in df.columns])
