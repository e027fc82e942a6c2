"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from sparkvane.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in catalog.SQL:
        assert len(set(columns)) == len(columns)
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_streams_equal_their_batch_forms(spark, sf):
    q = catalog.QUERIES
    batch, stream = (sorted(map(tuple, q[n](spark, sf).select("event_id", "source_id", "change_status").collect())) for n in ("change_detection", "stream_change_detection"))
    assert batch == stream
    assert q["stream_dedup"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_entry_and_registry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["event_id", "source_id", "change_status"]
