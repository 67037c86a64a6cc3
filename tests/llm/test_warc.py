"""Round trips of the archive, against hashlib and with damaged records."""

import hashlib

import pytest

from recspark.llm import warc
from recspark.llm.queries import op3_warc
from recspark.session import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, payload string"


def _expected(rows):
    top = {}
    for page_id, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page_id is not None:
            top[raw] = max(top.get(raw, page_id), page_id)
    out = []
    for page_id, html in rows:
        raw = (html or "").encode()
        ref = top.get(raw)
        revisit = ref is not None and ref != page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                    ref if revisit else None))
    return sorted(out, key=str)


def _got(df):
    rows = df.collect()
    assert all(r["problem"] is None for r in rows)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_query(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert _got(op3_warc(spark, SF)) == _expected(pages)


def test_odd_pages(spark):
    long = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n日本語é\r\n0\r\n\r\n" * 5000
    rows = [(1, None), (2, ""), (3, "x" * 999), (4, "x" * 999), (5, "y" * 1000), (6, "y" * 1000), (6, "y" * 1000),
            (None, "y" * 1000), (7, long), (8, long), (9, long + "a"), (None, "z"), (10, "é" * 500), (2**60 + 1, "é" * 500),
            (11, "\r\n\r\n"), (12, "\x00\x1f")]
    df = spark.createDataFrame([(i, "http://a/\r\n" if i == 1 else None, h, "clash") for i, h in rows], SCHEMA)
    assert _got(warc.round_trip(df)) == _expected(rows)


def test_more_digests_than_a_broadcast(spark, monkeypatch):
    """The same rows by row number, with a hot payload, equal ids and null ids."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    rows = [(i, "hot" * 400) for i in range(60)] + [(i, f"{i % 7}" * 1200) for i in range(100, 130)]
    rows += [(5, "hot" * 400), (None, "hot" * 400), (None, None), (200, ""), (201, "short"), (202, "short"), (203, "one" * 500)]
    df = spark.createDataFrame([(i, None, h, "clash") for i, h in rows], SCHEMA).repartition(5)
    assert _got(warc.round_trip(df)) == _expected(rows)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payload_comes_back_and_files_are_warc(spark):
    text = "héllo\n" * 20000
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "http://a/", text, "")], SCHEMA), path, segment=1000)
    assert [r["payload"] for r in warc.read(spark, path).collect()] == [text]
    raw = spark.read.format("binaryFile").load(path).select("content").collect()
    assert all(bytes(r[0]).startswith(b"WARC/1.1\r\n") for r in raw if r[0])
    kinds = [f["WARC-Type"] for r in raw for f, _ in warc.parse(bytes(r[0]))]
    assert kinds.count("response") == 1 and kinds.count("continuation") > 100


@pytest.mark.parametrize("drop, problem", [(1, "missing segments"), (-1, "missing segments")])
def test_lost_segment_is_reported(spark, drop, problem):
    records = warc.records_of("a", 5, None, "x" * 5000, hashlib.sha1(b"x" * 5000).hexdigest(), None, segment=1000)
    del records[drop]
    path = scratch_path(spark, "warc-test")
    spark.createDataFrame([(r,) for r in records], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    rows = warc.read(spark, path).collect()
    assert [(r["page_id"], r["payload"], r["problem"]) for r in rows] == [(5, None, problem)]


def test_wrong_digest_is_reported(spark):
    path = scratch_path(spark, "warc-test")
    records = warc.records_of("a", 5, None, "abc", "0" * 40, None)
    spark.createDataFrame([(r,) for r in records], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    assert [r["problem"] for r in warc.read(spark, path).collect()] == ["digest differs"]
