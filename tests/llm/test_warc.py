import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import common, warc

PAGES = [(1, "http://a/1", "x"), (2, "http://a/2", "y"), (3, None, "x"), (4, "http://a/\n4", None), (5, "http://é/", ""), (7, "u", "x"), (8, "v", "é" * 5000)]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"sha1": F.lit("clash"), "header": F.lit(1)})


def expected(min_bytes):
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = i
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        revisit = len(b) >= min_bytes and last[h or ""] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    return out


@pytest.mark.parametrize("min_bytes", [0, 1, 2])
def test_round_trip(spark, pages, min_bytes):
    path = common.fresh_path(spark, "t")
    warc.write_archive(pages, path, min_bytes)
    got = warc.read_archive(spark, path).select("page_id", "size", "sha1", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == expected(min_bytes)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    whole = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, path).collect()}
    for (i, url, h), (_, size, _, kind, _) in zip(PAGES, expected(min_bytes), strict=True):
        head, _, rest = whole[i].partition(b"\r\n\r\n")
        fields = warc.parse_header(head)
        assert fields["version"] == "WARC/1.1" and fields["WARC-Type"] == kind
        assert fields.get("WARC-Target-URI") == (url and url.replace("\n", "%0A"))
        block = (h or "").encode() if kind == "response" else b""
        assert rest == block + warc.END and int(fields["Content-Length"]) == len(block)


def test_damage_is_noticed(spark, pages):
    path = common.fresh_path(spark, "t")
    warc.write_archive(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.octet_length("payload") == 10000, F.encode(F.lit("z"), "UTF-8")).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(bad, "sha256 binary, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, path).collect()


def test_rows_without_an_id(spark, pages):
    path = common.fresh_path(spark, "t")
    rows = [(None, "n", "only here"), (None, "n", "only here"), (None, "n", "x")]
    warc.write_archive(pages.select("page_id", "url", "html").union(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    got = warc.read_archive(spark, path).where("page_id IS NULL").select("record_type", "refers_to", "size").collect()
    assert sorted(map(tuple, got), key=repr) == [("response", None, 9), ("response", None, 9), ("revisit", 7, 1)]


def test_repeated_rows_and_nothing(spark, pages):
    path = common.fresh_path(spark, "t")
    warc.write_archive(pages.union(pages.where("page_id = 7")), path)
    got = warc.read_archive(spark, path).where("page_id = 7").select("record_type", "refers_to").collect()
    assert [tuple(r) for r in got] == [("response", None)] * 2
    path = common.fresh_path(spark, "t")
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_rows_of_one_id_with_different_payloads(spark):
    path = common.fresh_path(spark, "t")
    rows = [(1, "u", "first " * 300), (1, "u", "second " * 300), (1, "u", None), (2, "v", "third")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    want = sorted((h or "").encode() for _, _, h in rows)
    assert sorted(bytes(r["payload"]) for r in warc.read_payloads(spark, path).collect()) == want
    assert sorted(r["size"] for r in warc.read_archive(spark, path).collect()) == sorted(map(len, want))
