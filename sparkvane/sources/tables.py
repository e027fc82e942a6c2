"""Table sources and sinks: tolerant CSV, suppressed no-op writes, atomic swaps, snapshots, JDBC."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.operators.changes import table_digest
from sparkvane.operators.rows import conform


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], skip_bad_lines: bool = False) -> DataFrame:
    """A CSV file with header as text columns in the given order.

    A missing or empty file gives an empty table; missing columns are null, extra ones are
    dropped; a byte-order mark before the first column is dropped.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], text_schema(columns))
    mode = "DROPMALFORMED" if skip_bad_lines else "PERMISSIVE"
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', mode=mode)
    if not df.columns:
        return spark.createDataFrame([], text_schema(columns))
    return conform(df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns]), columns)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    conform(df, columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_if_changed(df: DataFrame, path: str, columns: Sequence[str]) -> bool:
    """Write a Parquet table unless the same bag of rows is there; returns whether it wrote.

    Both sides are reduced to a count and order-free hash sums, so nothing is collected or sorted.
    """
    spark = df.sparkSession
    new = conform(df, columns)
    if exists(spark, path) and table_digest(spark.read.parquet(path), columns) == table_digest(new, columns):
        return False
    swap(new, path)
    return True


def swap(df: DataFrame, path: str) -> None:
    """Write beside the table, then put the new folder in its place by two renames: readers see the old table, for a
    moment none, or the new one, never half a table. Where the second rename fails, the old one is put back."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        fs.rename(old, target)
        raise OSError(f"{staging} could not take the place of {path}")
    fs.delete(old, True)


def counted_swap(existing: DataFrame, new: DataFrame, path: str) -> dict[str, int]:
    """Put the existing rows and the new ones in the place of a table: counts before and after, and what was added.

    Both counts are taken in the pass that writes, without a job of their own. The delta is never negative.
    """
    before, after = Observation(), Observation()
    rows = existing.observe(before, F.count(F.lit(1)).alias("n")).unionByName(new, allowMissingColumns=True)
    swap(rows.observe(after, F.count(F.lit(1)).alias("n")), path)
    return counts_delta({"before": before.get["n"], "after": after.get["n"]})


def counts_delta(counts: dict[str, int]) -> dict[str, int]:
    return {**counts, "delta": max(0, counts["after"] - counts["before"])}


def append(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append-only log or audit table."""
    conform(df, columns).write.mode("append").parquet(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON document, written aside and renamed into place."""
    fs, target = _fs(spark, path)
    staging = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.staging-{uuid.uuid4().hex}")
    out = fs.create(staging, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(staging, target)


def snapshot(tables: dict[str, tuple[DataFrame, str]], path: str) -> DataFrame:
    """Copy tables under ``path`` with a manifest (table, rows, digest, copy, key); tables: name -> (df, id column).

    The ids stay in the copies, which the manifest names, so no row holds those of a whole table.
    """
    manifest = None
    for name, (df, key) in tables.items():
        at = f"{path}/{name}"
        df.write.mode("overwrite").parquet(at)
        copy = df.sparkSession.read.parquet(at)
        h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in copy.columns])
        row = copy.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.hex(F.bit_xor(h)).alias("digest"), F.lit(at).alias("copy"), F.lit(key).alias("key"))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return manifest.sparkSession.read.parquet(f"{path}/_manifest")


def since_snapshot(manifest: DataFrame, current: DataFrame, table: str, key: str) -> DataFrame:
    """Ids of the current table that its copy of the snapshot does not have; all of them if there is no copy."""
    ids = current.select(F.col(key).cast("string").alias(key)).distinct()
    entry = manifest.where(F.col("table") == table).select("copy", "key").first()
    if entry is None:
        return ids
    old = manifest.sparkSession.read.parquet(entry["copy"]).select(F.col(entry["key"]).cast("string").alias(key))
    return ids.join(old, key, "left_anti")


def rows_since(df: DataFrame, column: str, at: str) -> DataFrame:
    """Rows at or after a moment; rows without one are left out."""
    return df.where(F.col(column).try_cast("timestamp") >= F.lit(at).cast("timestamp"))


def copy_absent(source: DataFrame, target: DataFrame, key: str, in_flight: Sequence[str], to: str) -> DataFrame:
    """Rows to append to the target: those it lacks; statuses of work in flight become ``to``."""
    fresh = source.join(target.select(key), key, "left_anti")
    return fresh.withColumn("status", F.when(F.col("status").isin(*in_flight), to).otherwise(F.col("status")))


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where none is named, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="sparkvane-steps-")
    return _own_folder[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back.

    The step is computed once, and the plan of what follows starts from a table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkvane-step-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
