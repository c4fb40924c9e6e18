"""Cutting lineage through storage that every executor can read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder; on
    a cluster no machine's own folder would do, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sluice-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the shared one, removed at the end: what is read from it later must be durable by then."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        removed(spark, folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
