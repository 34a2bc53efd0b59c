"""Reading of WARC files, canonical URLs, and revisits that resolve or do not."""

import gzip

import pytest
from pyspark.sql import functions as F

from fringelake.llm import warc

RECORDS = [
    warc.format_record("response", "http://a.org/", "2020-01-01T00:00:00Z", "<1>", "HTTP/1.1 200 OK", {"ETag": '"t"', "X": "1"}, "h\u00e9llo WARC/1.0 inside"),
    warc.format_record("warcinfo", "", "", "<2>", "", {}),
    warc.format_record("revisit", "http://a.org:80/", "2020-01-02T00:00:00Z", "<3>", "HTTP/1.1 304 Not Modified", {"ETag": 'W/"t"', "Date": "d"}),
    warc.format_record("response", "http://b.org/", "no date", "<4>", "HTTP/1.1 200 OK", {}, "x" * 3_000_000),
]


@pytest.mark.parametrize("packed", [False, True], ids=["plain", "gzip members"])
def test_records_in_any_portions(monkeypatch, packed):
    data = b"".join(gzip.compress(x) for x in RECORDS) if packed else b"".join(RECORDS)
    want = [x["block"] for x in warc.parse_records(b"".join(RECORDS))]
    assert len(want) == 4 and len(want[3]) > 3_000_000
    for portion in (7_001, 1 << 20):
        monkeypatch.setattr(warc, "PORTION", portion)
        assert [x["block"] for x in warc.parse_records(data)] == want


def test_damaged_tails_end_the_reading():
    whole = b"".join(gzip.compress(x) for x in RECORDS[:3])
    last = len(gzip.compress(RECORDS[2]))
    assert len(list(warc.parse_records(whole[: -last // 2]))) == 2
    assert len(list(warc.parse_records(whole[:-last] + b"\x1f\x8b" + b"junk" * 9))) == 2
    assert len(list(warc.parse_records(whole + b"junk"))) == 3
    assert len(list(warc.parse_records(b"".join(RECORDS)[:-10]))) == 3
    assert list(warc.parse_records(b"")) == list(warc.parse_records(b"nothing")) == []


def test_files_are_read_and_resolved(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in RECORDS))
    (tmp_path / "b.warc").write_bytes(RECORDS[0][: len(RECORDS[0]) // 2])
    captures = warc.read_warc(spark, str(tmp_path)).cache()
    assert sorted((r["url"], r["kind"], r["ts"] is None) for r in captures.collect()) == [("http://a.org/", "response", False), ("http://a.org:80/", "revisit", False), ("http://b.org/", "response", True)]
    got = [r for r in warc.with_bodies(warc.resolve_revisits(captures), captures).collect() if r["kind"] == "revisit"]
    assert [(r["status"], r["body"]) for r in got] == [("resolved", "h\u00e9llo WARC/1.0 inside")]
    assert got[0]["merged_headers"]["x"] == "1" and got[0]["merged_headers"]["date"] == "d"


def test_canonical_urls(spark):
    same = ["http://www.A.org:80/x/?b=2&a=1&utm_source=q#f", "https://a.org:443/x?a=1&b=2", "HTTP://a.org/x?a=1&b=2&ref=z"]
    other = ["http://a.org:443/x?a=1&b=2", "https://a.org:80/x?a=1&b=2", "http://a.org/X?a=1&b=2", "ftp://a.org/x?a=1&b=2", "http://a.org:8080/x?a=1&b=2"]
    rows = spark.createDataFrame([(x,) for x in [*same, *other, None]], "url string").select(warc.canonical_url(F.col("url")).alias("c")).collect()
    found = [r["c"] for r in rows]
    assert len(set(found[:3])) == 1 and len({*found[:3], *found[3:8]}) == 6 and found[8] is None


def test_statuses(spark):
    h = {"a": "1"}
    rows = [
        (1, "http://a.org/", 1, "revisit", "t", None, h, None), (2, "http://a.org/", 2, "response", None, None, h, "x"), (3, "http://a.org/", 3, "revisit", "t", "day", h, None),
        (4, "http://a.org/", 4, "response", "t", "day", h, "y"), (5, "http://a.org/", 5, "revisit", None, "day", h, None), (6, "http://a.org/", 6, "revisit", None, "night", h, None), (7, "http://a.org/", None, "revisit", "t", None, None, None),
    ]
    rows += [(9, None, 9, "response", "t", None, h, "z"), (10, None, 10, "revisit", "t", None, h, None)] + [(8, "http://a.org/", 7, "revisit", "t", None, h, None)] * 2
    table = spark.createDataFrame([(*r, "clash") for r in rows], warc.CAPTURE + ", status string")
    got = sorted((r["record_id"], r["status"], r["resolved_id"]) for r in warc.resolve_revisits(table).collect())
    assert got == [(1, "unresolved", None), (2, "response", None), (3, "no_validator", None), (4, "response", None), (5, "resolved", 4), (6, "mismatch", None), (7, "unresolved", None), (8, "resolved", 4), (8, "resolved", 4), (9, "response", None), (10, "unresolved", None)]


def test_a_hot_url_over_many_partitions(spark):
    rows = []
    for i in range(3000):
        rows.append((i, "http://hot.org/", i, "response" if i % 50 == 0 else "revisit", f"e{i // 50}", None, None, None))
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.CAPTURE), partitions=17).collect()}
    assert all(got[i]["resolved_id"] == i // 50 * 50 for i in range(3000) if i % 50)
