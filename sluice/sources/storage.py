"""Files in any store that a URI names: opened by ranges, listed without links, written so that they appear whole or not at all."""

from __future__ import annotations

import fnmatch
import functools
import hashlib
import os
import re
import stat
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

from sluice.plans.lineage import durable

#: Schemes that Hadoop and Arrow name differently.
_SAME = {"s3a": "s3", "s3n": "s3"}
#: Bytes that are read or written at a time.
PIECE = 1 << 20
#: Bytes of files that one task of a scan takes, about.
TASK_BYTES = 128 << 20
#: What opening a file is worth in bytes where files are dealt out, and files that are moved at a time.
OPEN_BYTES, MOVERS = 256 << 10, 32
#: Small files that a task of a Spark job takes, about.
TASK_FILES = 4096

LISTED = "uri string, path string, size long, mtime long, problem string"
WRITTEN = "path string, waits string, size long, sha256 string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of names and types of Spark."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.strip().split(" ") for c in ddl.split(","))])


def batched(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches, a few at a time."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) >= 2048:
            yield batch(some, arrow(ddl))
            some = []
    if some:
        yield batch(some, arrow(ddl))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def tasks_for(spark: SparkSession, files: int, size: int) -> int:
    """The tasks that work on so many files and bytes is dealt out to."""
    return max(1, min(files, spark.sparkContext.defaultParallelism), files // TASK_FILES + size // TASK_BYTES)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", uri, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest) if rest.startswith("/") else os.path.abspath(rest)
    return fs.FileSystem.from_uri(f"{_SAME.get(scheme, scheme)}:{rest}")


def stream(uri: str) -> BinaryIO:
    """A file to read from, at any place: only what is asked for is fetched."""
    store, path = opened(uri)
    return store.open_input_file(path)


def pieces(file: BinaryIO, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The bytes of a range of a file, a piece at a time."""
    file.seek(begin)
    left = None if end is None else end - begin
    while left is None or left > 0:
        piece = file.read(PIECE if left is None else min(PIECE, left))
        if not piece:
            return
        left = left if left is None else left - len(piece)
        yield piece


@dataclass(frozen=True)
class Listed:
    """A file below a folder: its URI, path below it, size, time (nanoseconds) and why it is refused, if it is."""

    uri: str
    path: str
    size: int
    mtime: int
    problem: str | None = None


def listed(root: str, glob: str = "*") -> list[Listed]:
    """The files below a folder whose names match, by the bytes of their paths; links and special files are refused.

    A single file lists itself. Names that begin with ``_`` or ``.`` are left out.
    """
    store, path = opened(root)
    about = store.get_file_info(path)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    local = isinstance(store, fs.LocalFileSystem)
    head = f"{root.split(':', 1)[0]}:" if re.match("[A-Za-z][A-Za-z0-9+.-]*:", root) and not local else "file://" if local else ""
    if about.type == fs.FileType.File:
        found = [(path, about.size, about.mtime_ns or 0, None)]
        top = os.path.dirname(path)
    else:
        top = path.rstrip("/")
        found = list(_walked(top)) if local else [(i.path, i.size, i.mtime_ns or 0, None) for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File]
    files = []
    for p, size, mtime, problem in found:
        below = p[len(top) :].lstrip("/")
        if fnmatch.fnmatch(os.path.basename(p), glob) and not any(part[:1] in ("_", ".") for part in below.split("/")):
            files.append(Listed(f"{head}{p}" if local else _rejoined(root, path, p), below, size, mtime, problem))
    return sorted(files, key=lambda f: f.path.encode())


def _rejoined(root: str, path: str, found: str) -> str:
    """The URI of a file found below a folder's URI."""
    below = found[len(path.rstrip("/")) :].lstrip("/")
    return f"{root.rstrip('/')}/{below}" if below else root


def _walked(top: str) -> Iterator[tuple[str, int, int, str | None]]:
    for folder, folders, names in os.walk(top):
        linked = [n for n in folders if os.path.islink(f"{folder}/{n}")]
        for name in names + linked:
            about = os.lstat(f"{folder}/{name}")
            problem = "link" if stat.S_ISLNK(about.st_mode) else None if stat.S_ISREG(about.st_mode) else "not a regular file"
            yield f"{folder}/{name}", about.st_size, about.st_mtime_ns, problem


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """uri, path, size, mtime and problem of the files that ``listed`` gives, found by tasks, a level of folders at a time; the driver holds none of them."""
    store, path = opened(root)
    about = store.get_file_info(path).type
    if about == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if about == fs.FileType.File:
        return spark.createDataFrame([astuple(f) for f in listed(root, glob)], LISTED)
    found, folders = [], spark.createDataFrame([("",)], "path string")
    while True:
        seen = durable(folders.mapInArrow(_entries(root, glob), f"{LISTED}, folder boolean"))
        found.append(seen.where("not folder").drop("folder"))
        below = seen.where("folder").select("path")
        if not (many := below.count()):
            return functools.reduce(DataFrame.union, found)
        # opening a folder is worth some files
        folders = below.repartition(tasks_for(spark, many, many * OPEN_BYTES))


def _entries(root: str, glob: str):
    """What lies in folders below ``root``: files whose names match, and folders."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, top = opened(root)
        top, local = top.rstrip("/"), isinstance(store, fs.LocalFileSystem)
        for some in batches:
            for folder in some.column("path").to_pylist():
                held = _held(f"{top}/{folder}" if folder else top or "/") if local else _held_by(store, f"{top}/{folder}" if folder else top)
                for name, size, mtime, problem, is_folder in held:
                    below = f"{folder}/{name}" if folder else name
                    if name[:1] not in ("_", ".") and (is_folder or fnmatch.fnmatch(name, glob)):
                        yield f"file://{top}/{below}" if local else f"{root.rstrip('/')}/{below}", below, size, mtime, problem, is_folder

    return lambda batches: batched(rows(batches), f"{LISTED}, folder boolean")


def _held(folder: str) -> Iterator[tuple]:
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:  # gone meanwhile
        return
    with entries:
        for entry in entries:
            try:
                about = entry.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            is_folder = stat.S_ISDIR(about.st_mode)
            problem = "link" if stat.S_ISLNK(about.st_mode) else None if is_folder or stat.S_ISREG(about.st_mode) else "not a regular file"
            yield entry.name, about.st_size, about.st_mtime_ns, problem, is_folder


def _held_by(store: fs.FileSystem, folder: str) -> Iterator[tuple]:
    for about in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        yield about.base_name, about.size, about.mtime_ns or 0, None, about.type == fs.FileType.Directory


@dataclass
class Files(InputPartition):
    """Files, or a range of one (``begin`` to ``end``), that a task reads."""

    files: list[Listed]
    begin: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


def dealt(files: list[Listed], task_bytes: int, split: bool) -> list[Files]:
    """Files dealt out to tasks of about ``task_bytes``; with ``split`` long ones by ranges."""
    out, some, size = [], [], 0
    for file in files:
        if split and file.size > task_bytes:
            out += [Files([file], k, min(k + task_bytes, file.size)) for k in range(0, file.size, task_bytes)]
            continue
        worth = file.size + OPEN_BYTES
        if some and size + worth > task_bytes:
            out.append(Files(some))
            some, size = [], 0
        some.append(file)
        size += worth
    return out + [Files(some)] * bool(some)


@dataclass(frozen=True)
class Written:
    """A file of a task: its path below the target, where it waits, size and digest."""

    path: str
    waits: str
    size: int
    sha256: str


@dataclass
class TaskFiles(WriterCommitMessage):
    files: list[Written] = field(default_factory=list)


class Sink:
    """An output file that counts and digests what goes through it."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file, self.size, self.digest = store.open_output_stream(path), 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.file.write(data)
        self.size += len(data)
        self.digest.update(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        self.file.flush()


class StagedWriter(DataSourceArrowWriter):
    """Writes files below a folder; they appear when the whole job commits.

    A task writes to a folder of its own below ``_staging-<job>``, under names
    that no other attempt uses, and tells the driver paths, sizes and digests
    only. Commit refuses targets that exist or that two tasks wrote, then moves
    every file to its place; abort, and commit at its end, remove the staging
    folder. Subclasses say with ``put`` what goes into which file. Files of any
    number are for ``written``, which tells the driver none of them.
    """

    def __init__(self, target: str):
        self.target, self.staging = target.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def put(self, batches: Iterator[pa.RecordBatch], out: Output) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        out = Output(self.target, self.staging)
        self.put(iterator, out)
        out.close()
        return TaskFiles(out.files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.target)
        files = [f for m in messages if m for f in m.files]
        names = [f.path for f in files]
        try:
            if twice := [n for n, times in Counter(names).items() if times > 1]:
                raise FileExistsError(f"written twice: {sorted(twice)[:3]}")
            there = [i.path for k in range(0, len(names), 1000) for i in store.get_file_info([f"{root}/{n}" for n in names[k : k + 1000]]) if i.type != fs.FileType.NotFound]
            if there:
                raise FileExistsError(f"not overwritten: {there[:3]}")
            for folder in sorted({os.path.dirname(f"{root}/{n}") for n in names} | {root}):
                store.create_dir(folder, recursive=True)
            with ThreadPoolExecutor(MOVERS) as movers:
                for _ in movers.map(lambda f: _placed(store, root, f), files):
                    pass
        finally:
            self._cleared()

    def staged(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task of ``written`` does: files wait in the staging folder, and are its rows."""
        yield from batched(map(astuple, self.write(batches).files), WRITTEN)

    def there(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of path and times, and whether there is such a file."""
        store, root = opened(self.target)
        for some in batches:
            for k in range(0, some.num_rows, 1000):
                part = some.slice(k, 1000)
                about = store.get_file_info([f"{root}/{n}" for n in part.column("path").to_pylist()])
                yield part.append_column("there", pa.array([i.type != fs.FileType.NotFound for i in about]))

    def places(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Moves the files of a task to their places; a task that comes again finds some of them moved."""
        store, root = opened(self.target)
        made, many = set(), 0
        for some in batches:
            files = [Written(*f) for f in zip(*(some.column(c).to_pylist() for c in ("path", "waits", "size", "sha256")))]
            for folder in {os.path.dirname(f"{root}/{f.path}") for f in files} - made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            # a local move takes no time to wait for
            with ThreadPoolExecutor(1 if isinstance(store, fs.LocalFileSystem) else MOVERS // 4) as movers:
                many += sum(1 for _ in movers.map(lambda f: _placed(store, root, f, again=True), files))
        yield batch([(many,)], arrow("files long"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        store, root = opened(self.target)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


def _placed(store: fs.FileSystem, root: str, file: Written, again: bool = False) -> None:
    try:
        store.move(f"{root}/{file.waits}", f"{root}/{file.path}")
    except FileNotFoundError:
        if not again:
            raise
    if store.get_file_info(f"{root}/{file.path}").size != file.size:
        raise OSError(f"{file.path} is not as long as what was written")


def written(rows: DataFrame, writer: StagedWriter) -> None:
    """Writes ``rows`` as files of any number: all appear when all are written, and none is replaced.

    What tasks wrote is a table in the shared folder. Tasks look for targets that exist or that two of
    them wrote, and if there are none, tasks move the files; the driver gets counts only.
    """
    store, root = opened(writer.target)
    try:
        files = durable(rows.mapInArrow(writer.staged, WRITTEN))
        many = files.count()
        tasks = tasks_for(rows.sparkSession, many, 0)
        named = files.repartition(tasks, "path").groupBy("path").agg(F.count("*").alias("times"))
        fault = named.mapInArrow(writer.there, "path string, times long, there boolean").agg(*[F.min(F.when(c, F.col("path"))).alias(n) for n, c in (("twice", F.col("times") > 1), ("there", F.col("there")))]).first()
        if fault["twice"] is not None:
            raise FileExistsError(f"written twice: {fault['twice']}")
        if fault["there"] is not None:
            raise FileExistsError(f"not overwritten: {fault['there']}")
        store.create_dir(root, recursive=True)
        moved = files.repartition(tasks).mapInArrow(writer.places, "files long").agg(F.sum("files")).first()[0]
        if many and moved != many:
            raise OSError(f"{moved} of {many} files were moved")
    finally:
        writer._cleared()


class Output:
    """The files of one attempt of a task, one open at a time."""

    def __init__(self, target: str, staging: str):
        self.store, root = opened(target)
        self.attempt, self.folder = uuid.uuid4().hex, staging
        self.root, self.files, self.open = root, [], None
        self.store.create_dir(f"{root}/{staging}/{self.attempt}", recursive=True)

    def begin(self, path: str) -> Sink:
        """A new file, for a path below the target; one that is open is ended."""
        self.close()
        if os.path.isabs(path) or ".." in path.split("/") or not path:
            raise ValueError(f"not a path below the target: {path!r}")
        waits = f"{self.folder}/{self.attempt}/{len(self.files)}"
        self.open = (path, waits, Sink(self.store, f"{self.root}/{waits}"))
        return self.open[2]

    def close(self) -> None:
        if self.open:
            path, waits, sink = self.open
            sink.file.close()
            self.files.append(Written(path, waits, sink.size, sink.digest.hexdigest()))
            self.open = None
