"""Archives, the index and the round trip."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from casework.llm import queries, warc
from tests.compare import connect, difference


def test_sql(spark, sf):
    name = "op4_warc_archive"
    assert difference(spark, connect(sf), queries.QUERIES[name], queries.SQL[name], sf) is None


def test_record_round_trip():
    payload = "é\r\n\r\nWARC/1.1".encode() * 50
    digest = hashlib.sha1(payload).hexdigest()
    member = warc.record(7, "http://a.b/\nx", payload, digest, None)
    assert warc.parse(member) == {"page": 7, "type": "response", "refers": None, "bytes": len(payload), "digest": digest, "payload": payload}
    again = warc.parse(warc.record(8, "", payload, digest, 7))
    assert (again["type"], again["refers"], again["bytes"], again["payload"]) == ("revisit", 7, len(payload), None)
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(member).replace(b"\xc3\xa9", b"ee", 1)))


def test_keys():
    assert warc.reversed_host("https://M.Example.org:8080/A?q=1#top") == "org,example,m)/a?q=1"
    assert warc.reversed_host(None) == "" and warc.reversed_host("http://[bad") == "http://[bad"


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big = "x" * 2000
    rows = [(i, f"http://h{i % 3}.example.com/p", big if i % 2 else f"small{i % 4}") for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (None, "http://n.example.com/", "null id"), (7, "http://h1.example.com/p", big), (50, "http://long.example.com/", "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    got = sorted(map(str, map(tuple, warc.archive_round_trip(pages).collect())))
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 39
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 39 if revisit else None))
    assert got == sorted(map(str, expected))
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
