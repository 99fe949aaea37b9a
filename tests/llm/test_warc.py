import base64
import hashlib
import struct
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuscle.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_contract(spark, rows_equal):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 40} {'word ' * (i % 9)}</p>") for i in range(200)]
    rows += [(900, "u", None), (901, None, ""), (902, "sp ace\r\nbreak", "é" * 100), (903, "", "\r\n\r\nWARC/1.1\r\n\r\n"), (904, "big", "x" * 3_000_000)]
    rows += [(1000 + i, "hot", "same") for i in range(150)]
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), i)
    want = [(i, len((h or "").encode()), digest(h), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, _, h in rows]
    out = W.warc_digest(spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit(1)).withColumn("sha", F.lit(2)))
    rows_equal(out, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], want)


def test_ways_of_finding_revisits(spark, monkeypatch):
    rows = [(i, "u", f"page {i % 30}".encode()) for i in range(100)] + [(1000 + i, "hot", b"same") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    monkeypatch.setattr(W, "LIGHT", 10)
    few, many = ({tuple(r) for r in W.with_revisits(pages, n).collect()} for n in (500_000, 0))
    assert few == many and len(few) == 150 and sum(r[4] for r in few) == 150 - 31


def test_whole_records_come_back(spark, tmp_path):
    rows = [(i, f"http://x/{i}?q=%20", f"payload {i}") for i in range(50)] + [(None, None, "no id"), (7, "again", "payload 7")]
    out = W.archive_pages(spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted((r["page_id"] or -1, r["url"] or "", r["payload"].decode()) for r in out) == sorted((i or -1, u or "", h) for i, u, h in rows)
    assert {r["record_type"] for r in out} == {"response"}  # equal rows of the largest id are all responses
    assert not list(tmp_path.glob(".*.part"))


def test_null_ids_revisit(spark):
    out = W.warc_digest(spark.createDataFrame([(None, "a", "x"), (3, "b", "x")], SCHEMA)).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {(None, "revisit", 3), (3, "response", None)}
    assert W.warc_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def records(n=300):
    return [W.record_bytes(i, f"http://x/{i}", f"<html>{i} some common words</html>".encode(), None, False) for i in range(n)]


def test_reading_is_linear():
    """Frames larger and smaller than a step, and many of them."""
    given = [W.record_bytes(i, "u", bytes(range(256)) * (i % 400), None, False) for i in range(900)]
    assert [r[5] for r in W.read_archive(W.archive_bytes(given, b""))] == [256 * (i % 400) for i in range(900)]
    noise = np.random.default_rng(0).bytes(3 * W.STEP)
    assert [r[6] for r in W.read_archive(W.archive_bytes([W.record_bytes(1, "u", noise, None, False)] * 3, b""))] == [noise] * 3
    times = []
    for n in (4_000, 32_000):
        data, began = W.archive_bytes([W.record_bytes(1, "u", b"short", None, False)] * n, b""), time.perf_counter()
        assert sum(1 for _ in W.read_archive(data)) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 24 * times[0]


@pytest.mark.parametrize("dictionary", [b"", None])
def test_frames_and_dictionary(dictionary):
    given = records()
    made = W.train_dictionary(given, 4096) if dictionary is None else dictionary
    data = W.archive_bytes(given, made)
    assert (struct.unpack_from("<I", data)[0] == W.DICTIONARY_FRAME) == bool(made)
    assert [r[0] for r in W.read_archive(data)] == list(range(300))
    if made:
        plain = struct.pack("<II", W.DICTIONARY_FRAME, len(made)) + made + W.archive_bytes(given, made)[8 + struct.unpack_from("<I", data, 4)[0] :]
        assert len(list(W.read_archive(plain))) == 300  # a dictionary that is not packed itself


def test_faults_are_found():
    good = W.record_bytes(1, "u", b"payload", None, False)
    assert W.parse_record(good)[5] == 7
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9.9"),
        good.replace(b"payload\r\n", b"paxload\r\n"),
        good.replace(b"Content-Length: 7", b"Content-Length: 8"),
        good + b"more",
        good[:-3],
        good.replace(b"WARC-Type: response", b"WARC-Type: wrong"),
        good.replace(b"<urn:page:1>", b"page 1"),
        good.replace(b"WARC-Date:", b"WARC-Date"),
        good.replace(b"WARC-Type:", b"Other-Type:"),
    ):
        with pytest.raises(W.WarcError):
            W.parse_record(bad)
    data = W.archive_bytes([good, good], b"")
    for bad in (data[:-2], data[:-9] + b"123456789", struct.pack("<II", W.DICTIONARY_FRAME, 99) + b"x", struct.pack("<II", W.DICTIONARY_FRAME, 4) + b"none"):
        with pytest.raises(W.WarcError):
            list(W.read_archive(bad))
    alone = zstandard.ZstdCompressor(write_checksum=True).compress(b"no record")
    with pytest.raises(W.WarcError):
        list(W.read_archive(alone))
