"""CSV with a byte-order mark, and counts that a write takes itself."""

import os

import pytest
from pyspark.sql import functions as F

from sparkvane.sources import bomcsv, tables


def test_csv_with_byte_order_mark(spark, tmp_path):
    bomcsv.register(spark)
    out = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None), (3, "ğ\nü")], "id int, v string").repartition(2)
    df.write.format("bomcsv").mode("overwrite").save(out)
    files = sorted(os.listdir(out))
    assert files and all(f.startswith("part-") and open(f"{out}/{f}", "rb").read(8) == b"\xef\xbb\xbfid,v\n" for f in files)
    back = tables.read_csv(spark, out, ["id", "v"])
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("1", 'a,"b"'), ("2", None), ("3", "ğ\nü")], key=repr)
    df.where("id = 1").coalesce(1).write.format("bomcsv").mode("overwrite").save(out)
    assert len(os.listdir(out)) == 1 and tables.read_csv(spark, out, ["id", "v"]).count() == 1
    df.where("id = 2").coalesce(1).write.format("bomcsv").mode("append").save(out)
    assert len(os.listdir(out)) == 2


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    bomcsv.register(spark)
    out = f"{tmp_path}/t"
    spark.range(3).write.format("bomcsv").mode("overwrite").save(out)
    before = sorted(os.listdir(out))
    bad = spark.range(100).repartition(2).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("bomcsv").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == before


def test_counts_of_a_write(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert tables.counted_swap(spark.range(0), spark.range(5), path) == {"before": 0, "after": 5, "delta": 5}
    assert tables.counted_swap(spark.read.parquet(path), spark.range(3), path) == {"before": 5, "after": 8, "delta": 3}
    assert spark.read.parquet(path).count() == 8
    assert tables.counts_delta({"before": 9, "after": 4})["delta"] == 0
