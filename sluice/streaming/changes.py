"""A stream of files that come, change or go.

    register(spark)
    spark.readStream.format("sluice_changes").option("stateDir", "/data/_seen").load("/data/incoming")

Spark's file source takes each path once; here a file whose size or time
differs from what was last seen comes again. What was seen is kept in the state
folder: a listing and, for each version of it, the changes that led there. An
offset is a version, so a batch that is run again reads the same changes, and a
run goes on where one stopped. A file is digested when its batch is read; if it
has changed again by then its row says so, and the change comes with a later
version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import replace

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.types import StructType

from sluice.plans.variants import resolved
from sluice.sources.archives import digested
from sluice.sources.storage import TASK_BYTES, Files, Listed, dealt, listed, opened

CHANGE = "path string, change string, size long, mtime long, sha256 string, problem string, version long"


class ChangedFiles(DataSource):
    """Options: ``stateDir``, ``glob``, ``digest`` (false: files are not read), ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sluice_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangesReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangedFiles)


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state, self.glob = options["path"], options["statedir"].rstrip("/"), options.get("glob", "*")
        self.digest, self.task_bytes = options.get("digest", "true").lower() != "false", int(options.get("taskbytes", TASK_BYTES))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """The version after a look at the folder: a new one only if something differs."""
        version = self._version()
        seen = {p: (size, mtime) for p, size, mtime in self._lines(f"seen-{version}")} if version else {}
        now = {f.path: (f.size, f.mtime) for f in listed(self.path, self.glob) if not f.problem}
        changes = [(p, "changed" if p in seen else "new", *at) for p, at in now.items() if seen.get(p) != at] + [(p, "gone", *at) for p, at in seen.items() if p not in now]
        if changes:
            version += 1
            self._write(f"changes-{version}", sorted(changes))
            # last, as it makes the version count
            self._write(f"seen-{version}", sorted((p, *at) for p, at in now.items()))
        return {"version": version}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return [part for version in range(start["version"] + 1, end["version"] + 1) for part in self._parts(version)]

    def _parts(self, version: int) -> list[Files]:
        # of a listed file the kind of its change stands for its problem
        changed = [Listed(f"{self.path.rstrip('/')}/{p}", p, size, mtime, change) for p, change, size, mtime in self._lines(f"changes-{version}")]
        return [replace(part, begin=version) for part in dealt(changed, self.task_bytes, split=False)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for file in partition.files:
            sha256, problem = (None, None) if file.problem == "gone" or not self.digest else digested(file.uri, file.size, file.mtime)
            yield file.path, file.problem, file.size, file.mtime, sha256, problem, partition.begin

    def commit(self, end: dict) -> None:
        """Listings before a version that is done are not needed again; changes stay for batches that are run again."""
        store, root = opened(self.state)
        for about in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if about.base_name.startswith("seen-") and int(about.base_name[5:]) < end["version"]:
                store.delete_file(about.path)

    def _version(self) -> int:
        store, root = opened(self.state)
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return max((int(n[5:]) for n in names if n.startswith("seen-")), default=0)

    def _lines(self, name: str) -> Iterator[list]:
        store, root = opened(self.state)
        with store.open_input_stream(f"{root}/{name}") as file:
            yield from map(json.loads, file.read().splitlines())

    def _write(self, name: str, rows: list[tuple]) -> None:
        store, root = opened(self.state)
        store.create_dir(root, recursive=True)
        waits = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(waits) as file:
            file.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        store.move(waits, f"{root}/{name}")


def arrivals(spark: SparkSession, path: str, state: str, glob: str = "*") -> DataFrame:
    """All changes of a folder up to now, over all runs: it is looked at, what is new is read, and the rest is kept from before.

    A batch that is run again overwrites its own folder.
    """
    register(spark)
    stream = spark.readStream.format("sluice_changes").option("stateDir", f"{state}/seen").option("glob", glob).load(path)
    out = f"{state}/arrivals"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    try:
        exists = bool(listed(out, "*.parquet"))
    except FileNotFoundError:
        exists = False
    return spark.read.schema(f"{CHANGE}, batch long").option("basePath", out).parquet(out) if exists else spark.createDataFrame([], f"{CHANGE}, batch long")


def variants(found: DataFrame) -> DataFrame:
    """:func:`sluice.plans.variants.resolved` of the files that came whole: each content of a path is an artifact of its own."""
    return resolved(found.where("change <> 'gone' and problem is null"), "path", "sha256", "version")
