"""Operator 9: round trip through the archives."""

import base64
import gzip
import hashlib

from mandisight.llm import store, warc
from mandisight.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, archive string, keeper int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA)


ROWS = [(1, "http://a/x y\r\nX: 1", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>é</p>"),
        (5, "http://d", "one"), (5, "http://d", "one"), (None, "http://e", "one"), (None, "http://f", "alone"),
        (6, "http://g", "x\r\n\r\ny" * 50_000)]


def test_round_trip(spark):
    index = warc.write_archives(pages(spark, ROWS), fresh_path(spark, "w"), archive_bytes=600, stretch_bytes=256)
    got = warc.read_records(index, gap=10, most=400, keep_html=True).collect()
    assert len(got) == len(ROWS)
    keeper = {"<p>é</p>": 4, "": 3, "one": 5, "alone": None, ROWS[-1][2]: 6}
    left = {}
    for r in got:
        left.setdefault(r.page_id, []).append(r)
    for page_id, _, html in ROWS:
        payload = html or ""
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        r = next(x for x in left[page_id] if x.payload_digest == digest)
        assert r.payload_bytes == len(payload.encode())
        if keeper[payload] in (page_id, None):
            assert (r.record_type, r.refers_to, r.html) == ("response", None, payload)
        else:
            assert (r.record_type, r.refers_to, r.html) == ("revisit", keeper[payload], None)
    assert index.select("archive").distinct().count() > 1


def test_archives_are_plain_warc_members(spark):
    index = warc.write_archives(pages(spark, ROWS[:4]), fresh_path(spark, "w"))
    for r in index.collect():
        with store.open_random(r.archive) as f:
            member = gzip.decompress(f.read_at(r.length, r.offset)).decode()
        assert member.startswith("WARC/1.1\r\nWARC-Type: " + r.record_type) and member.endswith("\r\n\r\n")
        assert "\r\nX: 1" not in member.split("\r\n\r\n")[0]


def test_least_bytes_and_selection(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    index = warc.write_archives(pages(spark, rows), fresh_path(spark, "w"), min_bytes=3)
    got = {r.page_id: r.record_type for r in warc.read_records(index).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert [r.page_id for r in warc.read_records(index.where("page_id = 3")).collect()] == [3]


def test_empty(spark):
    index = warc.write_archives(pages(spark, []), fresh_path(spark, "w"))
    assert warc.read_records(index).count() == 0


def test_coalesce():
    assert store.coalesce([(0, 10), (10, 10), (25, 5), (100, 50)], 5, 40) == [(0, 30, [0, 1, 2]), (100, 50, [3])]
    assert store.coalesce([(0, 10), (10, 10)], 5, 15) == [(0, 10, [0]), (10, 10, [1])]
    assert store.coalesce([], 1, 1) == []
