"""Digests of files, bundles to roll back to, and the rewrite of single partitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.sources.tables import exists, staged, swap


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files below a folder, or of one file; names relative to it, hidden ones left out.

    A file is read by one task, which holds its bytes once (2 GB at most, as a value of a row).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    tail = F.regexp_replace(F.split(F.col("path"), ":", 2)[1], "^/+", "")
    name = F.when(tail == root, F.regexp_extract(tail, "[^/]+$", 0)).otherwise(F.substring(tail, len(root) + 2, 1 << 20))
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def make_bundle(spark: SparkSession, tables: Mapping[str, str], to: str) -> DataFrame:
    """Copies of Parquet tables (name -> path) under ``to``, and a manifest (table, target, file, bytes, sha256) of every file of a copy."""
    manifest = None
    for name, path in tables.items():
        spark.read.parquet(path).write.mode("overwrite").parquet(f"{to}/{name}")
        part = file_digests(spark, f"{to}/{name}", "*.parquet").select(F.lit(name).alias("table"), F.lit(path).alias("target"), "file", "bytes", "sha256")
        manifest = part if manifest is None else manifest.unionByName(part)
    if manifest is None:
        raise ValueError("a bundle needs a table")
    manifest.write.mode("overwrite").parquet(f"{to}/_manifest")
    return spark.read.parquet(f"{to}/_manifest")


def damaged(spark: SparkSession, bundle: str) -> DataFrame:
    """(table, file, problem) of files that are missing, changed or not in the manifest."""
    manifest = spark.read.parquet(f"{bundle}/_manifest")
    found = None
    for (name,) in manifest.select("table").distinct().collect():  # the tables of a bundle are named by hand
        there = file_digests(spark, f"{bundle}/{name}", "*.parquet") if exists(spark, f"{bundle}/{name}") else manifest.limit(0).select("file", "bytes", "sha256")
        part = there.select(F.lit(name).alias("table"), "file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
        found = part if found is None else found.unionByName(part)
    both = manifest.join(found, ["table", "file"], "full")
    problem = F.when(F.col("_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when((F.col("sha256") != F.col("_sha256")) | (F.col("bytes") != F.col("_bytes")), "changed")
    return both.select("table", "file", problem.alias("problem")).where("problem IS NOT NULL")


def restore_bundle(spark: SparkSession, bundle: str) -> list[str]:
    """Put the tables of a bundle back in their places, after all of its files are verified; nothing is touched otherwise."""
    bad = damaged(spark, bundle).orderBy("table", "file").take(5)
    if bad:
        raise ValueError("the bundle is damaged: " + ", ".join(f"{b['table']}/{b['file']} {b['problem']}" for b in bad))
    targets = spark.read.parquet(f"{bundle}/_manifest").select("table", "target").distinct().orderBy("table").collect()
    for t in targets:
        swap(spark.read.parquet(f"{bundle}/{t['table']}"), t["target"])
    return [t["table"] for t in targets]


def rewrite_partitions(spark: SparkSession, path: str, partition: str, affected: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``change`` to the rows of those partitions that hold affected rows; all others keep their files.

    ``change`` gives rows of the same columns and partitions. The new rows are written beside the table first,
    so the table is not read while it is written. Returns the partitions that were rewritten.
    """
    table = spark.read.parquet(path)
    touched = staged(table.where(affected).select(partition).distinct(), "touched")
    mine = table.join(F.broadcast(touched) if touched.count() <= 10_000 else touched, table[partition].eqNullSafe(touched[partition]), "left_semi")
    new = staged(change(mine).select(*table.columns), "rewritten")
    if not touched.isEmpty():
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched
