"""Markdown reports of small result tables, temp views, and resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvane.sources.tables import exists, swap

#: Rows that a report shows; it says how many there are beyond them.
SHOWN = 200


def markdown(df: DataFrame, title: str, shown: int = SHOWN) -> str:
    """A table of at most ``shown`` rows; a report is for reading, so this bound is its purpose."""
    rows = df.limit(shown + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:shown]]
    if len(rows) > shown:
        lines.append(f"\n{df.count() - shown} more rows")
    return "\n".join(lines) + "\n"


def load_all(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder as temp views; those that are missing are left out."""
    out = {}
    for n in names:
        if exists(spark, f"{folder}/{n}.parquet"):
            out[n] = spark.read.parquet(f"{folder}/{n}.parquet")
            out[n].createOrReplaceTempView(n)
    return out


def reset(spark: SparkSession, path: str, archive: str) -> None:
    """Copy a table to the archive, then put an empty one in its place."""
    df = spark.read.parquet(path)
    df.write.mode("overwrite").parquet(archive)
    swap(spark.createDataFrame([], df.schema), path)
