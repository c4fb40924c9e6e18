"""Legacy web archives made into WARC: parsed by their declared lengths, written with what WARC adds.

ARC archives open with a description of themselves whose lines give the
version and the fields of all header lines that follow; a header line's last
field declares its record's length, and nothing but that length tells where the
next one begins. The converter makes of each record a WARC record with an
identifier (of its archive's name and its place), a timestamp, a type and
digests of block and payload. Records of equal payloads from some length on
become revisits of one of them.

Payloads are never shuffled: one pass digests the records, the choice of
revisits works on digests, and a second pass turns each archive into a WARC
archive, given the few lines about its own revisits. Archives are written up to
a size, so what a task reads or is told of one is bounded, and one record is
held at a time. Archives appear whole, when all of them are written; a task
that is lost is run again. Both kinds are gzipped record by record.

Defined cases: a null payload is empty; a null page id is left out of the
record, ranks below all others and comes back null; a null url becomes
``urn:page:``; characters that header lines cannot hold are percent-encoded;
rows that share an id, or all columns, are records of their own, of which one
is the response; other columns, whatever their names, are ignored; an empty
table gives no rows. An archive that breaks off, or whose lengths do not hold,
gives a row with ``problem`` at that place and is read no further.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from sluice.plans.lineage import durable, scratch
from sluice.sources.storage import Files, Output, Sink, StagedWriter, dealt, listed, stream

#: Payloads from so many bytes on are stored once.
REVISIT_FROM = 1000
#: Bytes, as stored, from which an archive is ended, and of archives that a task reads.
ARCHIVE_BYTES = 16 << 20
#: Rows in one batch of payloads on their way to a writer.
BATCH_ROWS = 1000
LEVEL = 4
#: Fields of the header lines of both versions, by the names that archives give them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The HTTP header that carries a page's id through the archives.
PAGE = "X-Page-Id"
DATE = "20000101000000"
NO_ADDRESS = "0.0.0.0"


class Broken(ValueError):
    """An archive that cannot be read on."""


def reader_of(file: BinaryIO) -> BinaryIO:
    """The archive's bytes, unpacked if they are gzipped, in one piece or by records."""
    first = file.read(2)
    file.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 17) if first == b"\x1f\x8b" else io.BufferedReader(file, 1 << 17)


def _taken(file: BinaryIO, length: int) -> bytes:
    found = file.read(length)
    if len(found) < length:
        raise Broken(f"{length} bytes declared, {len(found)} left")
    return found


def arc_records(file: BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, version, header, block) of an ARC archive's records, its own description first.

    Header lines are split from their end, as old archives' URLs may hold spaces.
    """
    at, version, names = 0, 0, FIELDS[1].split()
    while line := file.readline():
        if not line.strip():
            at += len(line)
            continue
        told = line.decode("latin-1").rstrip("\r\n")
        parts = told.rsplit(" ", len(names) - 1)
        if not version and not told.startswith("filedesc://"):
            raise Broken("no description of the archive")
        if len(parts) < len(names) or not re.fullmatch("[0-9]+", parts[-1]):
            raise Broken(f"not a header line of version {version}: {told[:60]}")
        header = dict(zip(names, parts))
        block = _taken(file, int(parts[-1]))
        if not version:
            lines = block.decode("latin-1").splitlines()
            if len(lines) < 2 or not re.match("[12] ", lines[0]):
                raise Broken("a version that is not known")
            version, names = int(lines[0][0]), lines[1].split()
            if names[:1] != ["URL"] or names[-1] != "Archive-length":
                raise Broken("fields that are not known")
        yield at, version, header, block
        at += len(line) + len(block)


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers (with the blank line) and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def page_id(head: bytes) -> int | None:
    told = http_header(head, PAGE)
    return int(told) if told and re.fullmatch("-?[0-9]+", told) else None


def base32(digest: bytes) -> str:
    return f"sha1:{base64.b32encode(digest).decode()}"


def record_id(archive: str, offset: int) -> str:
    """An identifier that an archive's name and a record's place in it decide."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def timestamp(date: str) -> str:
    """An archive's date of 14 digits (shorter ones are filled up) as WARC writes it."""
    if not re.fullmatch("[0-9]{4,14}", date):
        date = "1970"
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def stem(uri: str) -> str:
    return re.sub(r"\.arc(\.gz)?$", "", uri.rsplit("/", 1)[-1])


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record's bytes; fields without a value are left out."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def converted_record(archive: str, offset: int, version: int, header: dict[str, str], block: bytes, original: tuple[str, str, str] | None, info: str) -> bytes:
    """The WARC record of an ARC record; ``original`` (id, url, timestamp) makes it a revisit."""
    common = [("WARC-Record-ID", record_id(archive, offset)), ("WARC-Date", timestamp(header["Archive-date"]))]
    if header["URL"].startswith("filedesc://"):
        about = f"software: sluice\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC version {version}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", f"{archive}.warc.gz"), ("Content-Type", "application/warc-fields")], about)
    head, payload = split_block(block)
    where = [("WARC-Target-URI", header["URL"]), ("WARC-IP-Address", None if header["IP-address"] == NO_ADDRESS else header["IP-address"]), ("WARC-Warcinfo-ID", info)]
    digest = ("WARC-Payload-Digest", base32(hashlib.sha1(payload).digest()))
    if not head:
        return warc_record([("WARC-Type", "resource"), *common, *where, ("Content-Type", header["Content-type"]), digest, ("WARC-Block-Digest", digest[1])], block)
    stored = head if original else block
    kind = [("WARC-Type", "response")]
    if original:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), *zip(("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"), original)]
    return warc_record([*kind, *common, *where, ("Content-Type", "application/http; msgtype=response"), digest, ("WARC-Block-Digest", base32(hashlib.sha1(stored).digest()))], stored)


def warc_records(file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields by lower-case name, block) of a WARC archive's records."""
    at = 0
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise Broken("no record begins here")
        size, fields = len(line), {}
        while (line := file.readline()).strip():
            size += len(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        if not line:
            raise Broken("a record's fields break off")
        if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
            raise Broken("no length")
        block = _taken(file, int(fields["content-length"]))
        if _taken(file, 4) != b"\r\n\r\n":
            raise Broken("a record does not end where its length says")
        yield at, fields, block
        at += size + len(line) + len(block) + 4


def zipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class ArcArchives(DataSource):
    """ARC archives: read as a line for each record but its payload, written from rows of url, ip, date, mime, status and content."""

    @classmethod
    def name(cls) -> str:
        return "sluice_arc"

    def schema(self) -> str:
        return _ARC

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], "*.arc*", _arc_rows, _ARC)

    def writer(self, schema: StructType, overwrite: bool) -> ArcWriter:
        if overwrite:
            raise ValueError("archives are never replaced: use mode append")
        return ArcWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)))


_ARC = "archive string, offset long, version int, url string, date string, page_id long, payload_bytes long, sha1 string, sha256 string, problem string"
_WARC = "archive string, offset long, record_type string, record_id string, refers_to_id string, date string, url string, page_id long, payload_bytes long, payload_digest string, problem string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


class _ArchiveReader(DataSourceReader):
    """Archives, as many to a task as make up some bytes; each row of ``rows`` is a line about a record."""

    def __init__(self, path: str, glob: str, rows, ddl: str):
        self.path, self.glob, self.rows = path, glob, rows
        self.fields = [c.strip().split(" ") for c in ddl.split(",")]

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, self.glob), ARCHIVE_BYTES, split=False)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema, held = pa.schema([(name, _TYPES[kind]) for name, kind in self.fields]), []
        for file in partition.files:
            for row in self.rows(file.uri):
                held.append(row)
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _arc_rows(uri: str) -> Iterator[tuple]:
    end = 0
    with stream(uri) as raw:
        try:
            for at, version, header, block in arc_records(reader_of(raw)):
                end = at + 1
                if at:
                    head, payload = split_block(block)
                    yield uri, at, version, header["URL"], header["Archive-date"], page_id(head), len(payload), hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest(), None
        except (Broken, EOFError, gzip.BadGzipFile, zlib.error) as error:
            yield uri, end, *(None,) * 7, str(error)


def _warc_rows(uri: str) -> Iterator[tuple]:
    end = 0
    with stream(uri) as raw:
        try:
            for at, told, block in warc_records(reader_of(raw)):
                end = at + 1
                head, payload = split_block(block)
                digest, problem = hashlib.sha1(payload), None
                if told.get("warc-block-digest") not in (None, base32(hashlib.sha1(block).digest())):
                    problem = "block digest"
                elif told["warc-type"] != "revisit" and told.get("warc-payload-digest") not in (None, base32(digest.digest())):
                    problem = "payload digest"
                revisit = told["warc-type"] == "revisit"
                own = base64.b32decode(told["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit else digest.hexdigest()
                yield uri, at, told["warc-type"], told.get("warc-record-id"), told.get("warc-refers-to"), told.get("warc-date"), told.get("warc-target-uri"), page_id(head), None if revisit else len(payload), own, problem
        except (Broken, EOFError, gzip.BadGzipFile, zlib.error) as error:
            yield uri, end, *(None,) * 8, str(error)


class ArcWriter(StagedWriter):
    """Archives of both versions in turn, each ended once it holds enough bytes."""

    def __init__(self, target: str, archive_bytes: int):
        super().__init__(target)
        self.archive_bytes = archive_bytes

    def put(self, batches: Iterator[pa.RecordBatch], out: Output) -> None:
        sink, version, task = None, 1, uuid.uuid4().hex[:16]
        for batch in batches:
            columns = [batch.column(n) for n in ("url", "ip", "date", "mime", "status", "content")]
            for row in zip(*columns):
                if sink is None:
                    version = 1 + (len(out.files) + int(task[0], 16)) % 2
                    name = f"{task}-{len(out.files):05d}"
                    sink = out.begin(f"{name}.arc.gz")
                    sink.write(zipped(description(name, version)))
                sink.write(zipped(arc_record(version, sink.size, name, *(c.as_py() for c in row))))
                if sink.size >= self.archive_bytes:
                    out.close()
                    sink = None


def description(name: str, version: int) -> bytes:
    """The record that opens an archive."""
    about = f"{version} 0 sluice\n{FIELDS[version]}\n".encode()
    return header_line(1, f"filedesc://{name}.arc", NO_ADDRESS, DATE, "text/plain", len(about)) + about + b"\n"


def header_line(version: int, url: str, ip: str, date: str, mime: str, length: int, *more: str) -> bytes:
    return (" ".join([url, ip, date, mime, *more, str(length)]) + "\n").encode()


def arc_record(version: int, offset: int, name: str, url: str, ip: str, date: str, mime: str, status: int, content: bytes) -> bytes:
    url = quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    more = (str(status), base64.b32encode(hashlib.sha1(content).digest()).decode(), "-", str(offset), f"{name}.arc") if version == 2 else ()
    return header_line(version, url, ip, date, mime, len(content), *more) + content + b"\n"


class WarcArchives(DataSource):
    """WARC archives: read as a line for each record, checked against its digests; written from ARC archives.

    Rows to write name an archive and hold, of its records that are revisits,
    offset and the original (archive, offset, url and date).
    """

    @classmethod
    def name(cls) -> str:
        return "sluice_warc"

    def schema(self) -> str:
        return _WARC

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], "*.warc*", _warc_rows, _WARC)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are never replaced: use mode append")
        return WarcWriter(self.options["path"])


class WarcWriter(StagedWriter):
    def put(self, batches: Iterator[pa.RecordBatch], out: Output) -> None:
        for batch in batches:
            for uri, revisits in zip(batch.column("archive").to_pylist(), batch.column("revisits").to_pylist()):
                of = {r["offset"]: r["of"] for r in revisits or ()}
                self._convert(uri, {at: (record_id(stem(o["archive"]), o["offset"]), o["url"], timestamp(o["date"])) for at, o in of.items()}, out.begin(f"{stem(uri)}.warc.gz"))

    def _convert(self, uri: str, revisits: dict[int, tuple[str, str, str]], sink: Sink) -> None:
        archive = stem(uri)
        with stream(uri) as raw:
            for at, version, header, block in arc_records(reader_of(raw)):
                sink.write(zipped(converted_record(archive, at, version, header, block, revisits.get(at), record_id(archive, 0))))


def register(spark: SparkSession) -> None:
    for source in (ArcArchives, WarcArchives):
        spark.dataSource.register(source)


@contextlib.contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def archived(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes pages (page_id, url, html) as ARC archives of both versions."""
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    name = F.col("page_id").cast("long").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(F.concat(F.lit(f"{PAGE}: "), name, F.lit("\r\n")), F.lit("")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce(F.nullif(F.col("url").cast("string"), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(name, F.lit(""))))
    rows = pages.select(url.alias("url"), F.lit(NO_ADDRESS).alias("ip"), F.lit(DATE).alias("date"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.concat(head.cast("binary"), body).alias("content"))
    with _batches_of(spark, BATCH_ROWS):
        rows.write.format("sluice_arc").mode("append").option("archiveBytes", archive_bytes).save(folder)


def originals(found: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """archive, offset and the original's id, url and date of the records whose payload a record of a larger page id holds too."""
    long = found.where(F.col("problem").isNull() & (F.col("payload_bytes") >= least)).select("archive", "offset", "page_id", "url", "date", "sha256", "payload_bytes")
    # one row for each payload that occurs more than once, counted before it is shuffled
    first = long.groupBy("sha256", "payload_bytes").agg(F.max(F.struct("page_id", "archive", "offset", "url", "date")).alias("best"), F.count("*").alias("n")).where("n > 1").select("sha256", "payload_bytes", "best")
    met = long.select("archive", "offset", "sha256", "payload_bytes").join(first, ["sha256", "payload_bytes"])
    return met.where((F.col("archive") != F.col("best.archive")) | (F.col("offset") != F.col("best.offset"))).select("archive", "offset", F.struct(F.col("best.archive").alias("archive"), F.col("best.offset").alias("offset"), F.col("best.url").alias("url"), F.col("best.date").alias("date")).alias("of"))


def converted(spark: SparkSession, arcs: str, warcs: str, least: int = REVISIT_FROM) -> None:
    """Writes a WARC archive for each ARC archive of a folder. An archive that cannot be read to its end is an error."""
    register(spark)
    found = durable(spark.read.format("sluice_arc").load(arcs))
    # the few broken ones that a message can name
    if broken := found.where("problem is not null").limit(3).collect():
        raise Broken("; ".join(f"{r['archive']}: {r['problem']}" for r in broken))
    # an archive's revisits are fewer than its records, which its size bounds
    by_archive = originals(found, least).groupBy("archive").agg(F.collect_list(F.struct("offset", "of")).alias("revisits"))
    archives = [f.uri for f in listed(arcs, "*.arc*")]
    if archives:
        plan = spark.createDataFrame([(a,) for a in archives], "archive string").join(by_archive, "archive", "left")
        plan.repartition(min(len(archives), 10_000)).write.format("sluice_warc").mode("append").save(warcs)


def read(spark: SparkSession, warcs: str) -> DataFrame:
    """A line for each record of the WARC archives of a folder, with its payload's length and digest (a revisit's as it says) and what is wrong."""
    register(spark)
    return spark.read.format("sluice_warc").load(warcs)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page id) of responses and revisits."""
    sound = records.where(F.col("problem").isNull())
    own = sound.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = sound.where("record_type = 'revisit'").alias("r").join(sound.where("record_type = 'response'").alias("o"), F.col("r.refers_to_id") == F.col("o.record_id"))
    same: Column = F.col("r.payload_digest") == F.col("o.payload_digest")
    return own.unionByName(again.where(same).select("r.page_id", "o.payload_bytes", "o.payload_digest", "r.record_type", F.col("o.page_id").alias("refers_to")))


def round_trip(pages: DataFrame, least: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """:func:`pages_of` the WARC archives made from ARC archives of pages; the archives are removed afterwards."""
    spark = pages.sparkSession
    with scratch(spark, "web-archives") as folder:
        archived(pages, f"{folder}/arc", archive_bytes)
        if not _any(f"{folder}/arc"):
            return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
        converted(spark, f"{folder}/arc", f"{folder}/warc", least)
        return durable(pages_of(durable(read(spark, f"{folder}/warc"))))


def _any(folder: str) -> bool:
    try:
        return bool(listed(folder))
    except FileNotFoundError:
        return False
