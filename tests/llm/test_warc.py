"""Legacy archives made into WARC: round trips, both versions, revisits, broken archives."""

import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from sluice.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, offset int"


def brute(rows):
    best = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, -1), -1 if page is None else page)
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and page != best[data]
        yield page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[data] if again else None


def rows_of(n=120):
    long = ["<p>" + "ab\r\n\r\nWARC/1.0\r\n" * k + "é" * 400 for k in range(60, 64)]
    rows = [(k, f"http://h{k}.example/{k}", f"<html>{k} " + "x" * (k * 7) + "</html>") for k in range(n)]
    rows += [(1000 + k, f"https://copy.example/{k % 5} with space/é", long[k % 4]) for k in range(40)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://a\nb", "y" * 999), (2003, "http://c", "y" * 999), (2004, "no scheme", "y" * 1000), (2005, "q", "y" * 1000), (2006, "r", "HTTP/1.1 200 OK\r\n\r\n" + "z" * 2000), (-5, "s", "y" * 1000)]
    return rows


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("size", [2_000, 1 << 24])
def test_round_trip_equals_brute_force(spark, size):
    rows = rows_of()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in warc.round_trip(table, archive_bytes=size).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, "u", "w" * 1200, "", 0)] * 3 + [(None, "u", "w" * 1200, "", 0)] * 2 + [(None, "v", "short", "", 0)]
    got = sorted((tuple(r)[0], tuple(r)[1], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).where("page_id is not null").collect())
    assert got == [(7, 1200, "response", None), (7, 1200, "revisit", 7), (7, 1200, "revisit", 7)]
    nulls = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).where("page_id is null").collect()
    assert sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in nulls) == [(5, "response", None), (1200, "revisit", 7), (1200, "revisit", 7)]


def test_archives_of_both_versions(spark, tmp_path):
    rows = rows_of(40)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).coalesce(1)
    warc.archived(table, str(tmp_path / "arc"), archive_bytes=3_000)
    warc.converted(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = spark.read.format("sluice_arc").load(str(tmp_path / "arc"))
    assert {r["version"] for r in found.select("version").distinct().collect()} == {1, 2}
    name = sorted(os.listdir(tmp_path / "arc"))[0]
    lines = gzip.decompress((tmp_path / "arc" / name).read_bytes()).splitlines()
    assert lines[0].startswith(b"filedesc://") and lines[2].decode() == warc.FIELDS[int(lines[1][:1])]
    records = warc.read(spark, str(tmp_path / "warc"))
    assert records.where("problem is not null").count() == 0
    assert {r["record_type"]: r["count"] for r in records.groupBy("record_type").count().collect()} == {"warcinfo": len(os.listdir(tmp_path / "arc")), "response": len(rows) - 38, "revisit": 38}
    assert records.select("record_id").distinct().count() == records.count()
    # every record is a gzip member of its own, and a revisit holds no payload
    body = gzip.decompress((tmp_path / "warc" / name.replace(".arc", ".warc")).read_bytes())
    for _, told, block in warc.warc_records(io.BytesIO(body)):
        assert told["warc-date"] == "2000-01-01T00:00:00Z" and told["warc-record-id"].startswith("<urn:uuid:")
        if told["warc-type"] == "revisit":
            assert block.endswith(b"\r\n\r\n") and told["warc-profile"] == warc.PROFILE and told["warc-refers-to-target-uri"]


def arc(version, *records, tail=b""):
    body = warc.description("t", version)
    for url, block, extra in records:
        more = ("200", "-", "-", "0", "t.arc") if version == 2 else ()
        body += warc.header_line(version, url, "1.2.3.4", "19990102030405", "text/html", len(block) + extra, *more) + block + b"\n"
    return io.BytesIO(body + tail)


@pytest.mark.parametrize("version", [1, 2])
def test_declared_lengths_decide(version):
    tricky = b"HTTP/1.0 200 OK\r\n\r\nhttp://fake 1.2.3.4 19990102030405 text/html 5\nabcde\n"
    found = list(warc.arc_records(arc(version, ("http://with space/x", tricky, 0), ("dns:host", b"a record", 0), ("http://e", b"", 0))))
    assert [(h["URL"], b) for _, _, h, b in found[1:]] == [("http://with space/x", tricky), ("dns:host", b"a record"), ("http://e", b"")]
    assert all(v == version for _, v, _, _ in found)
    told = [next(warc.warc_records(io.BytesIO(warc.converted_record("t", at, v, h, b, None, "i")))) for at, v, h, b in found]
    assert [t["warc-type"] for _, t, _ in told] == ["warcinfo", "response", "resource", "resource"]
    assert told[1][1]["warc-date"] == "1999-01-02T03:04:05Z" and told[1][1]["warc-ip-address"] == "1.2.3.4" and told[2][2] == b"a record"
    assert len({t["warc-record-id"] for _, t, _ in told}) == 4


def test_broken_archives_say_so(spark, tmp_path):
    whole = ("http://a", b"HTTP/1.0 200 OK\r\n\r\nfine", 0)
    for name, file in {"short": arc(1, whole, ("http://b", b"HTTP/1.0 200 OK\r\n\r\n", 50)), "line": arc(2, whole, tail=b"no header\n"), "none": io.BytesIO(b"some text\n"), "fine": arc(1, whole)}.items():
        (tmp_path / f"{name}.arc").write_bytes(file.getvalue())
    warc.register(spark)
    found = spark.read.format("sluice_arc").load(str(tmp_path)).select(F.regexp_extract("archive", "([a-z]+).arc$", 1).alias("a"), "url", "problem").collect()
    assert {(r["a"], r["url"], (r["problem"] or "").lstrip("0123456789 ")[:12]) for r in found} == {("short", "http://a", ""), ("short", None, "bytes declar"), ("line", "http://a", ""), ("line", None, "not a header"), ("none", None, "no descripti"), ("fine", "http://a", "")}
    with pytest.raises(warc.Broken, match="declared|header line|description"):
        warc.converted(spark, str(tmp_path), str(tmp_path / "out"))


def test_dates_are_filled_up():
    assert warc.timestamp("1999") == "1999-01-01T00:00:00Z" and warc.timestamp("19991231") == "1999-12-31T00:00:00Z" and warc.timestamp("?") == "1970-01-01T00:00:00Z"
    assert warc.timestamp("199912") == "1999-12-01T00:00:00Z" and warc.timestamp("19991231235958") == "1999-12-31T23:59:58Z"
