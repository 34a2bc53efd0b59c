"""WARC captures and not-modified revisits.

A revisit record ("not modified") holds no body. It is resolved to the latest
earlier full response for the same canonical URL, by an as-of join; its
validators (entity tag, else last-modified) must agree with that response's.
The resolved record has the response's body and headers, updated by the headers
that a 304 answer may carry.

Hot URLs: captures are range-partitioned by (URL, time), so the captures of one
URL may fill many partitions; each partition needs only the last response before
it, which a table of one row a partition gives.

Cases: null URLs match nothing; null times sort first; captures of one time
sort by record id, then by content; a revisit of no earlier response is ``unresolved``; a
response without validators, or a revisit without any, is ``no_validator``;
disagreeing validators give ``mismatch``; responses are passed through as
``response``; entity tags agree by weak comparison; equal rows are separate captures; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Headers that a 304 answer may update (RFC 9111, 3.2 and RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
CAPTURE = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, body string"


def canonical_url(url: Column) -> Column:
    """http(s) as one scheme, host in lower case, no default port, no ``www.``, no fragment, no trailing slash; query arguments sorted, tracking ones (``utm_*``, ``ref``) left out."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).when(scheme.isin("", "http"), F.regexp_replace(host, r":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[A-Za-z]*|ref)(=|$)"))), "&")
    return F.concat(F.when(scheme == "", F.lit("http")).when(scheme == "https", F.lit("http")).otherwise(scheme), F.lit("://"), host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(F.lit("")))


def opaque(tag: Column) -> Column:
    """What weak comparison sees of an entity tag (RFC 9110, 8.8.3.2): not whether it is weak."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def body_key() -> Column:
    """16 bytes that tell captures apart as far as their bodies differ: equal and null ids are no matter."""
    return F.unhex(F.md5(F.to_json(F.struct("record_id", "url", "ts", "kind", F.sha2(F.col("body"), 256).alias("digest")))))


def resolve_revisits(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add canonical_url, status, resolved_id, merged_headers, body_key to the capture columns other than the body.

    ``body_key`` is that of the capture whose body the row has; where there is none, it is longer and matches nothing.
    """
    spark = captures.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("canonical_url").asc_nulls_first(), F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("body_key")]
    meta = captures.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "headers", body_key().alias("body_key"))
    ranged = cut(meta.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()))
    response = F.struct("record_id", "etag", "last_modified", "headers", "body_key")
    full = F.when((F.col("kind") == "response") & F.col("canonical_url").isNotNull(), response)
    inside = Window.partitionBy("part", "canonical_url").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("prior", F.last(full, ignorenulls=True).over(inside))
    # One row a partition: its first URL, and its last URL with that URL's last response.
    edges = ranged.groupBy("part").agg(
        F.min("canonical_url").alias("first_url"), F.max("canonical_url").alias("last_url"),
        F.max_by(full, F.when(full.isNotNull(), F.struct("canonical_url", F.coalesce(F.col("ts"), F.lit(-(1 << 63))), "record_id", "body_key"))).alias("found"), F.max(F.when(full.isNotNull(), F.col("canonical_url"))).alias("found_url"),
    )
    carried, open_url, held = [], None, None
    for row in edges.orderBy("part").collect():  # as many rows as partitions
        if held is not None and open_url is not None and row["first_url"] == open_url:
            carried.append((row["part"], open_url, held))
        if row["found"] is not None and row["found_url"] == row["last_url"]:
            open_url, held = row["last_url"], row["found"]
        elif row["last_url"] != open_url:
            open_url, held = None, None
    schema = f"part int, canonical_url string, before {local.schema['prior'].dataType.simpleString()}"
    joined = local.join(F.broadcast(spark.createDataFrame(carried, schema)), ["part", "canonical_url"], "left")
    found = F.coalesce("prior", "before")
    joined = joined.withColumn("found", F.when(F.col("kind") == "revisit", found)).drop("prior", "before", "part")
    got = F.col("found")
    status = (
        F.when(F.col("kind") != "revisit", F.lit("response"))
        .when(got.isNull(), F.lit("unresolved"))
        .when(F.col("etag").isNotNull() & got["etag"].isNotNull(), F.when(opaque(F.col("etag")) == opaque(got["etag"]), F.lit("resolved")).otherwise(F.lit("mismatch")))
        .when(F.col("last_modified").isNotNull() & got["last_modified"].isNotNull(), F.when(F.col("last_modified") == got["last_modified"], F.lit("resolved")).otherwise(F.lit("mismatch")))
        .otherwise(F.lit("no_validator"))
    )
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    allowed = F.map_filter(own, lambda k, v: F.lower(k).isin(*PERMITTED))
    base = F.map_filter(F.coalesce(got["headers"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.transform(F.map_keys(allowed), lambda x: F.lower(x)), F.lower(k)))
    joined = joined.withColumn("status", F.coalesce(status, F.lit("response")))
    resolved = F.col("status") == "resolved"
    # A key of its own for a row without a body too: nulls would all be joined in one task.
    source = F.when(resolved, got["body_key"]).when(F.col("status") == "response", F.col("body_key")).otherwise(F.concat(F.col("body_key"), F.lit(b"-")))
    return joined.select("record_id", "canonical_url", "ts", "kind", "status", F.when(resolved, got["record_id"]).alias("resolved_id"), F.when(resolved, F.map_concat(base, allowed)).otherwise(F.col("headers")).alias("merged_headers"), source.alias("body_key"))


def with_bodies(resolved: DataFrame, captures: DataFrame) -> DataFrame:
    """Give each resolved revisit its response's body, each response its own; others have none."""
    bodies = captures.filter(F.col("body").isNotNull()).select(body_key().alias("body_key"), "body").dropDuplicates(["body_key"])
    return resolved.join(bodies, "body_key", "left").drop("body_key")


#: Bytes that are unpacked at a time, and the most records of a batch.
PORTION, RECORDS = 1 << 20, 256


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in portions, its gzip members unpacked one after another; a damaged member ends them."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PORTION):
            yield data[at : at + PORTION]
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        while not member.eof and at < len(data):
            piece = data[at : at + PORTION]
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            if out:
                yield out
        if not member.eof:
            return


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, plain or gzip members: {headers, block}; a damaged tail ends the reading.

    One record, and a portion of the file, are held unpacked at a time.
    """
    portions, held = _unpacked(data), b""

    def more(least: int) -> bool:
        nonlocal held
        parts, size = [held], len(held)
        while size < least and (part := next(portions, None)) is not None:
            parts.append(part)
            size += len(part)
        held = b"".join(parts)
        return size >= least

    while True:
        while (start := held.find(b"WARC/")) < 0:
            held = held[-4:]
            if not more(len(held) + 1):
                return
        held = held[start:]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "0")
        length = int(length) if length.isdecimal() else 0
        if not more(end + 4 + length):
            return
        yield {"headers": headers, "block": held[end + 4 : end + 4 + length]}
        held = held[end + 4 + length :]


def _http(block: bytes) -> tuple[dict, str]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}, body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures (``CAPTURE`` columns) of the response and revisit records of WARC files; a date that is none is null.

    A file is one row of bytes; its records are unpacked one at a time.
    """
    import datetime

    import pandas as pd
    import xxhash

    names = ["record_id", "url", "ts", "kind", "etag", "last_modified", "headers", "body"]

    def moment(text: str) -> int | None:
        try:
            return int(datetime.datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp())
        except ValueError:
            return None

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for r in parse_records(data):
                    h = r["headers"]
                    if h.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, body = _http(r["block"])
                    when = h.get("warc-date", "")
                    ts = moment(when)
                    rid = xxhash.xxh3_64_intdigest(h.get("warc-record-id", "").encode()) >> 1
                    rows.append((rid, h.get("warc-target-uri"), ts, h["warc-type"], http.get("etag"), http.get("last-modified"), http, body if h["warc-type"] == "response" else None))
                    if len(rows) == RECORDS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, CAPTURE)


def format_record(kind: str, uri: str, date: str, record_id: str, status_line: str, headers: dict[str, str], body: str = "") -> bytes:
    """One WARC record with an HTTP block."""
    block = "\r\n".join([status_line, *(f"{k}: {v}" for k, v in headers.items()), "", ""]).encode("latin-1", "replace") + body.encode()
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Record-ID: {record_id}", "Content-Type: application/http", f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"
