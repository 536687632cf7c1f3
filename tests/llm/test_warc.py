"""WARC archives: exact round trip."""

import gzip
import hashlib

import pytest

from tidemark.llm import warc
from tidemark.llm.common import new_path

LONG = "é<p>" * 400


def expected(rows):
    owner = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            owner[b] = max(owner.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = owner.get(b)
        revisit = to is not None and p != to
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/x y\r\nz", LONG), (5, "http://b", LONG), (3, None, LONG), (5, "http://b", LONG), (7, "u", None), (8, "u", ""), (9, "u", "small"), (10, "u", "small"),
    (None, "n", LONG), (None, "n", "k" * 1000), (None, "n", "k" * 1000), (11, "u", "\r\n\r\nContent-Length: 5\r\n\r\n" * 60), (12, "u", "x" * 3_000_000),
]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("sent", [0, 100])
def test_round_trip(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT_ROWS", sent)
    pages = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "page_id long, url string, html string, offset int, digest string")
    got = sorted((tuple(r) for r in warc.round_trip(pages, file_records=3).select(*COLUMNS).collect()), key=str)
    assert got == expected(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_are_gzip_and_records_are_found_by_offset(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    whole, split, index = (new_path(spark, n) for n in "abc")
    warc.write_archives(pages, whole)
    warc.normalise(spark, whole, split, index)
    before = b"".join(gzip.decompress(bytes(r.content)) for r in warc._files(spark, whole).collect())
    after = b"".join(gzip.decompress(bytes(r.content)) for r in warc._files(spark, split).collect())
    assert before == after and before.count(b"WARC/1.1\r\n") == len(ROWS)
    entries = spark.read.parquet(index)
    some = entries.where("record_id in ('<urn:page:12>', '<urn:page:9>')")
    got = {r.page_id: bytes(r.payload) for r in warc.fetch(warc._files(spark, split), some).collect()}
    assert got == {12: b"x" * 3_000_000, 9: b"small"}
    contents = {r.path: bytes(r.content) for r in warc._files(spark, split).collect()}
    for e in entries.collect():
        assert gzip.decompress(contents[e.path][e.offset : e.offset + e.length]).startswith(b"WARC/1.1\r\n")


def test_streams():
    data = b"".join(warc.member(b"r" * n) for n in (1, 5, 70_000))
    assert [r for _, _, r in warc.members_in(data)] == [b"r", b"r" * 5, b"r" * 70_000]
    assert b"".join(warc.inflate(data)) == b"r" * 70_006
    assert b"".join(warc.inflate(b"")) == b""
    for broken in (data[:-3], gzip.compress(b"abc")[:-1]):
        with pytest.raises(ValueError):
            b"".join(warc.inflate(broken))
    with pytest.raises(ValueError):
        list(warc.records_in(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"])))
