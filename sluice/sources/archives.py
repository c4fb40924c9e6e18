"""ZIP archives as tables: members read by ranges, archives written, members extracted.

    register(spark)
    spark.read.format("sluice_zip").option("suffix", ".mp4").load("/data/archives")
    rows.write.format("sluice_zip").mode("append").save("/data/packed")

A scan's tasks are ranges of archives, planned from sizes alone. A task reads
an archive's directory, at the file's end, and takes the members whose headers
lie in its range, so one archive of any size keeps many tasks at work and
nothing but what they need is fetched. A member is read a piece at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from sluice.plans.lineage import durable
from sluice.sources.storage import PIECE, TASK_BYTES, Files, Output, StagedWriter, arrow, batch, batched, dealt, listed, listing, opened, pieces, stream, tasks_for, written

MEMBER = "archive string, member string, size long, compressed long, crc32 long, offset long, problem string, sha256 string"
#: Bytes from which an archive that is written is ended.
ARCHIVE_BYTES = 256 << 20


def register(spark: SparkSession) -> None:
    """Makes the formats of this module and of :mod:`arrays` known to a session."""
    from sluice.sources.arrays import ArrayFiles

    for source in (ZipArchives, ZipExtraction, FileInventory, ArrayFiles):
        spark.dataSource.register(source)


class ZipArchives(DataSource):
    """Members of ZIP archives below ``path``: where they lie, their sizes and checksum, what is wrong, and a digest.

    Options: ``suffix`` (other members are left out; any case), ``digest``
    (false: members are not read), ``taskBytes``, ``archiveBytes`` (writing).
    Written rows have member and content.
    """

    @classmethod
    def name(cls) -> str:
        return "sluice_zip"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("archives are never replaced: use mode append")
        return ZipWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.suffix = options["path"], options.get("suffix", "").lower()
        self.digest, self.task_bytes = options.get("digest", "true").lower() != "false", int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, "*.zip"), self.task_bytes, split=True)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            yield from batched(self._members(file.uri, file.problem, partition.begin, partition.end), MEMBER)

    def _members(self, uri: str, refused: str | None, begin: int, end: int | None) -> Iterator[tuple]:
        nothing = (None,) * 5
        if refused:
            if not begin:
                yield uri, *nothing, refused, None
            return
        with stream(uri) as file:
            try:
                archive = zipfile.ZipFile(file)
            except (zipfile.BadZipFile, NotImplementedError, pa.ArrowInvalid):
                if not begin:
                    yield uri, *nothing, "not an archive", None
                return
            seen: set[str] = set()
            for info in archive.infolist():
                name = info.filename.replace("\\", "/")
                if info.is_dir() or not name.lower().endswith(self.suffix):
                    continue
                problem = "unsafe" if name.startswith("/") or ".." in name.split("/") else "repeated" if name in seen else "encrypted" if info.flag_bits & 1 else None
                seen.add(name)
                if info.header_offset < begin or end is not None and info.header_offset >= end:
                    continue
                digest = None
                if problem is None and self.digest:
                    digest, problem = _read(archive, info)
                yield uri, info.filename, info.file_size, info.compress_size, info.CRC, info.header_offset, problem, digest


def _read(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[str | None, str | None]:
    """A member's digest, or what is wrong with it."""
    digest = hashlib.sha256()
    try:
        with archive.open(info) as member:
            while piece := member.read(PIECE):
                digest.update(piece)
    except zipfile.BadZipFile:
        return None, "checksum"
    except (zlib.error, EOFError, OSError, NotImplementedError) as error:
        return None, f"unreadable: {type(error).__name__}"
    return digest.hexdigest(), None


class ZipWriter(StagedWriter):
    """Rows of member and content as archives, each ended once it holds enough bytes."""

    def __init__(self, target: str, archive_bytes: int):
        super().__init__(target)
        self.archive_bytes = archive_bytes

    def put(self, batches: Iterator[pa.RecordBatch], out: Output) -> None:
        archive, sink, task = None, None, uuid.uuid4().hex[:12]
        for batch in batches:
            for member, content in zip(batch.column("member"), batch.column("content")):
                if archive is None:
                    sink = out.begin(f"{task}-{len(out.files):05d}.zip")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(member.as_py()), content.as_py() or b"", zipfile.ZIP_DEFLATED)
                if sink.size >= self.archive_bytes:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()


class ZipExtraction(DataSource):
    """Writes members of archives as files: rows of archive, member and target (a path below the folder)."""

    @classmethod
    def name(cls) -> str:
        return "sluice_zip_extract"

    def writer(self, schema: StructType, overwrite: bool) -> ZipExtractor:
        if overwrite:
            raise ValueError("extracted files are never replaced: use mode append")
        return ZipExtractor(self.options["path"])


class ZipExtractor(StagedWriter):
    def put(self, batches: Iterator[pa.RecordBatch], out: Output) -> None:
        at, archive = None, None
        for batch in batches:
            for uri, member, target in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "target"))):
                if uri != at:
                    at, archive = uri, zipfile.ZipFile(stream(uri))
                sink = out.begin(target)
                with archive.open(member) as content:
                    while piece := content.read(PIECE):
                        sink.write(piece)


def members(spark: SparkSession, path: str, suffix: str = ".mp4", digest: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row for each member: archive, member, size, compressed, crc32, offset, problem, sha256."""
    register(spark)
    return spark.read.format("sluice_zip").option("suffix", suffix).option("digest", str(digest).lower()).option("taskBytes", task_bytes).load(path)


def extracted(found: DataFrame, target: str, done: DataFrame | None = None) -> DataFrame:
    """Extracts the sound members that ``done`` lacks under the same archive, name, size and CRC, each to
    ``<archive's stem>/<member>`` below ``target``, and returns them with ``file``.

    All of them appear, or none if a task fails for good. Members are dealt out by archive and place.
    """
    spark = found.sparkSession
    sound = found.where("problem is null")
    if done is not None:
        sound = sound.join(done, ["archive", "member", "size", "crc32"], "left_anti")
    stem = F.regexp_extract("archive", r"([^/]+?)(?:\.zip)?$", 1)
    named = durable(sound.withColumn("file", F.concat(stem, F.lit("/"), F.regexp_replace("member", r"\\", "/"))))
    # the driver takes samples of the key for its ranges, which a digest keeps short
    tasks = tasks_for(spark, *named.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())
    dealt_out = named.select("archive", "member", F.col("file").alias("target"), "offset").repartitionByRange(tasks, F.xxhash64("archive"), "offset").sortWithinPartitions("archive", "offset")
    written(dealt_out.drop("offset"), ZipExtractor(target))
    return named


class FileInventory(DataSource):
    """Files below a folder, by path: path, size, mtime (nanoseconds), sha256 and problem (links, changes while they were read)."""

    @classmethod
    def name(cls) -> str:
        return "sluice_inventory"

    def schema(self) -> str:
        return _INVENTORY

    def reader(self, schema: StructType) -> DataSourceReader:
        return InventoryReader({k.lower(): v for k, v in self.options.items()})


_INVENTORY = "path string, size long, mtime long, sha256 string, problem string"


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.digest = options["path"], options.get("glob", "*"), options.get("digest", "true").lower() != "false"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, self.glob), self.task_bytes, split=False)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for file in partition.files:
            problem, digest = file.problem, None
            if self.digest and not problem:
                digest, problem = digested(file.uri, file.size, file.mtime)
            rows.append((file.path, file.size, file.mtime, digest, problem))
        if rows:
            yield batch(rows, arrow(_INVENTORY))


def digested(uri: str, size: int, mtime: int) -> tuple[str | None, str | None]:
    """A file's digest, unless its size or time differ from those listed once it is read."""
    digest = hashlib.sha256()
    try:
        with stream(uri) as file:
            for piece in pieces(file):
                digest.update(piece)
    except FileNotFoundError:
        return None, "gone"
    store, path = opened(uri)
    about = store.get_file_info(path)
    return (digest.hexdigest(), None) if (about.size, about.mtime_ns or 0) == (size, mtime) else (None, "changed")


def inventory(spark: SparkSession, path: str, glob: str = "*", digest: bool = True) -> DataFrame:
    """path (below the folder), size, mtime, sha256 and problem of every file, ordered by the bytes of the path.

    The rows of ``sluice_inventory``, but tasks list the folders too, so the driver holds no files; each is read once.
    """
    files = listing(spark, path, glob)
    if not digest:
        return files.select("path", "size", "mtime", F.lit(None).cast("string").alias("sha256"), "problem").orderBy("path")
    tasks = tasks_for(spark, *files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())
    return durable(files.repartition(tasks).mapInArrow(_digests, _INVENTORY)).orderBy("path")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for some in batches:
            for uri, path, size, mtime, problem in zip(*(c.to_pylist() for c in some.columns)):
                yield path, size, mtime, *((None, problem) if problem else digested(uri, size, mtime))

    return batched(rows(), _INVENTORY)
