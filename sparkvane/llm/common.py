"""Helpers that the operators of this subpackage share.

* ``shared_dir`` / ``materialise``: cut lineage with a Parquet table in the folder that
  the cluster names in ``spark.checkpoint.dir``. Unlike a local checkpoint such a table
  survives the loss of any executor.
* ``text_blocks``: walk an Arrow batch in blocks of bounded bytes, so that the memory of a
  Python worker depends on the block (or on one document), never on the batch.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds decoded at once (one longer document is held alone).
BLOCK_BYTES = 2 << 20

#: A key with more than one in so many rows is joined apart; there can be no more such keys than this.
HOT_SHARE = 1000

_fallback: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="sparkvane-")
    return _fallback[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, so that it works in any store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _cleanup() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_cleanup)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this driver ends."""
    path = f"{shared_dir(spark)}/sparkvane-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, never lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the data folder, pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, often: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each ``key`` and the number of its rows in ``often``.

    A key of more than one in ``share`` of all ``total`` rows would send them to one task. There can be no more
    than ``share`` such keys, whatever the input, so these are broadcast; the rest meet by a shuffle. ``rows`` is
    read twice: let it be a written table.
    """
    hot = F.col(often) * share > total
    sent, dealt = keyed.where(hot).drop(often), keyed.where(~hot).drop(often)
    rest = rows.join(F.broadcast(sent.select(key)), key, "left_anti").join(dealt, key)
    return rows.join(F.broadcast(sent), key).unionByName(rest)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds at most ``limit`` bytes (or one row)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def unused(columns: list[str], base: str) -> str:
    """A column name that clashes with none of ``columns`` (compared without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker gives freed memory back: idle workers of a task that
    held much would else keep it while the next stage's tasks need theirs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty; no decoding."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def count_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a column: the size check before a broadcast."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
