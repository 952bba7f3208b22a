import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from larmor.llm import warc
from larmor.llm.common import scratch_path

PAGE = "page_id long, url string, html string"


def round_trip(spark, pages, **more):
    path = scratch_path(spark, "warc")
    warc.write(pages, path, **more)
    return path, warc.captures(warc.read(spark, path))


def test_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id < 20").withColumn("page_id", F.col("page_id") + 100000))
    _, found = round_trip(spark, pages, file_bytes=1 << 16)
    got = {r["page_id"]: r for r in warc.page_rows(found).collect()}
    given = pages.collect()
    first = {}
    for r in sorted(given, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    assert len(got) == len(given)
    for r in given:
        data, g = (r["html"] or "").encode(), got[r["page_id"]]
        again = first[r["html"] or ""] != r["page_id"]
        assert g["payload_bytes"] == len(data) and g["complete"] and g["digest_ok"]
        assert g["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert g["record_type"] == ("revisit" if again else "response")
        assert g["refers_to"] == (first[r["html"] or ""] if again else None)
    texts = {r["page_id"]: r["p"] for r in found.where("response.type = 'response'").select(warc.page_of(F.col("capture_id")).alias("page_id"), F.col("response.payload").alias("p")).collect()}
    assert all(bytes(texts[r["page_id"]]).decode() == (r["html"] or "") for r in given if r["page_id"] in texts)


def test_edges(spark):
    rows = [(1, "http://a b\r\nX: y", "x\r\n\r\nWARC/1.1\r\n\r\n"), (2, None, None), (3, "u", ""), (None, "u", "é" * 100000), (None, "u", "é" * 100000), (5, "u", "é" * 100000), (6, "u", "q"), (6, "u", "q")]
    pages = spark.createDataFrame(rows, PAGE).withColumn("digest", F.lit(1)).withColumn("ordinal", F.lit(1))
    _, found = round_trip(spark, pages)
    got = warc.page_rows(found)
    assert got.count() == len(rows) and got.where("not complete or not digest_ok").count() == 0
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got.collect())
    assert kinds == [(0, "revisit", 5), (0, "revisit", 5), (1, "response", 0), (2, "response", 0), (3, "revisit", 2), (5, "response", 0), (6, "response", 0), (6, "revisit", 6)]
    _, large = round_trip(spark, pages, min_bytes=1000)
    assert warc.page_rows(large).where("record_type = 'revisit'").count() == 2


def test_empty_and_broken(spark):
    _, found = round_trip(spark, spark.createDataFrame([], PAGE))
    assert found.collect() == []
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"nonsense"))
    good = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert next(warc.parse(good))["record_id"] == "<a>"
    with pytest.raises(ValueError, match="length"):
        list(warc.parse(good.replace(b": 2", b": 1")))
