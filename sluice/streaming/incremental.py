"""Incremental work as streams: new files once, keyed state, dead letters, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.plans.lineage import durable

LEASE_SECONDS = 900


def new_files(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's Parquet files; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def drained(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into Parquet files, and stops."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def numbered(stream: DataFrame, mode: str, sink: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now; the rows of all its batches, with their batch number.

    A batch that is run again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", sink).parquet(sink)


def windowed(events: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and kind; rows later than ``late`` are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upserted(spark: SparkSession, stream: DataFrame, key: str, version: str, table_dir: str, checkpoint: str, compact_every: int = 16) -> DataFrame:
    """The newest row of each key, over all that the stream has brought so far.

    A batch is reduced to its newest rows and written as a delta, a folder with
    the batch's number; a batch that is run again writes its own folder again.
    Every ``compact_every`` batches the table so far becomes one snapshot. What
    is there is found in ``table_dir``, so a run goes on where one stopped, and
    a run without new files returns the table as it is.
    """
    newest = lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, F.xxhash64(*rows.columns))).alias("r")).select("r.*")

    def upto(number: int | None) -> DataFrame | None:
        """All rows of the newest snapshot before a batch and of the deltas after it."""
        snapshots = [n for n in _complete(spark, f"{table_dir}/snapshot") if number is None or n < number]
        base = max(snapshots, default=-1)
        deltas = [n for n in _complete(spark, f"{table_dir}/delta") if n > base and (number is None or n <= number)]
        paths = [*([f"{table_dir}/snapshot/{base:09d}"] if snapshots else []), *(f"{table_dir}/delta/{n:09d}" for n in deltas)]
        return newest(spark.read.schema(stream.schema).parquet(*paths)) if paths else None

    def merge(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{table_dir}/delta/{number:09d}")
        if (number + 1) % compact_every == 0:
            upto(number).write.mode("overwrite").parquet(f"{table_dir}/snapshot/{number:09d}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = upto(None)
    return spark.createDataFrame([], stream.schema) if found is None else found


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of a folder's subfolders that were written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.isDirectory()]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def routed(rows: DataFrame, ok: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a condition, and the dead letters: those that fail it or make it null."""
    passed = F.coalesce(F.expr(ok), F.lit(False))
    kept = durable(rows.withColumn("_ok", passed)) if not rows.isStreaming else rows.withColumn("_ok", passed)
    return kept.where("_ok").drop("_ok"), kept.where("not _ok").drop("_ok")


def _leases(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's lease: claims hold until they are released or their heartbeat is old."""
    holder, beat, grants, denials = state.get if state.exists else ("", 0.0, 0, 0)
    for batch in batches:
        for row in batch.sort_values(["at", "worker"]).itertuples(index=False):
            if holder and row.at - beat > LEASE_SECONDS:
                holder = ""
            if row.kind == "release" and holder == row.worker:
                holder = ""
            elif row.kind == "claim" and not holder:
                holder, beat, grants = row.worker, row.at, grants + 1
            elif row.kind == "claim" and holder != row.worker:
                denials += 1
            elif holder == row.worker:
                beat = row.at
    state.update((holder, beat, grants, denials))
    yield pd.DataFrame({"item": [key[0]], "holder": [holder], "grants": [grants], "denials": [denials]})


def leased(requests: DataFrame) -> DataFrame:
    """item, holder, grants and denials after each batch of (item, worker, kind, at)."""
    return requests.groupBy("item").applyInPandasWithState(_leases, "item long, holder string, grants long, denials long", "holder string, beat double, grants long, denials long", "update", GroupStateTimeout.NoTimeout)
