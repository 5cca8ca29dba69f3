"""Operator 2: archives against a plain reading of the rows, and damaged ones."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc

LONG = "é<p>" * 30_000
ROWS = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://a/\r\nb", None), (4, "u", ""), (5, "u", LONG), (6, "u", LONG), (7, "u", LONG), (7, "u", LONG), (8, "u", "solo\r\n0\r\n\r\n"), (9, "u", LONG + "!"), (9, "u", LONG + "!")]


def brute(rows):
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        top = best[t or ""]
        out.append((i, len(data), warc.digest_of(data), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")


def test_archives(spark, pages):
    manifest = warc.write(pages)
    got = warc.read(manifest)
    assert sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert all(payloads[i] == (t or "").encode() for i, _, t in ROWS if i in payloads)
    assert manifest.agg(F.sum("records")).first()[0] > len(ROWS) + 3  # some are segmented
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_null_page_id(spark):
    rows = spark.createDataFrame([(None, "u", "a"), (2, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, bytes(r.payload or b"")) for r in warc.read(warc.write(rows)).collect()}
    assert got == {(None, "revisit", 2, b""), (2, "response", None, b"a"), (None, "response", None, b"b")}


def test_segments_in_any_order(spark):
    data = b"".join(warc.records_of(5, "u", LONG.encode(), None, 10_000)[::-1])
    records = [(f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f["warc-type"], None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, b) for f, b in warc.parse(io.BytesIO(data))]
    schema = "origin string, number int, total long, type string, refers_to string, digest string, block binary"
    whole = warc.decode(warc.reassemble(spark.createDataFrame(records, schema))).collect()
    assert len(whole) == 1 and bytes(whole[0].payload) == LONG.encode()
    for broken in (records[1:], records[:-1], [*records[:3], *records[4:]], [*records, records[0]]):
        with pytest.raises(Exception, match="segments missing"):
            warc.decode(warc.reassemble(spark.createDataFrame(broken, schema))).collect()


def test_chunks():
    for n in (0, 1, 7, 8, 9, 100):
        assert warc.from_chunks(warc.to_chunks(b"z" * n, 8)) == b"z" * n
    assert warc.from_chunks(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"q\r\n", b"3\r\nabc\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(warc.Damaged):
            warc.from_chunks(bad)


def test_truncated_archive():
    data = gzip.decompress(warc.records_of(1, "u", b"hello", None)[0])[:-9]
    with pytest.raises(warc.Damaged):
        list(warc.parse(io.BytesIO(gzip.compress(data))))
