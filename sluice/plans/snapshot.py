"""Snapshots of manifests: accepted records, a ledger of those refused, and what they were made from."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans import merkle
from sluice.plans.lineage import durable
from sluice.sources.files import inventory


def written(records: DataFrame, key: str, folder: str, fingerprint: str) -> None:
    """``records`` (with problems) as a snapshot: accepted rows, quarantine and summary.

    Records with problems, and keys that come more than once, go to the
    quarantine with their reasons. A folder that exists is left alone and fails.
    """
    kept = durable(records)
    repeated = kept.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    marked = kept.join(repeated, kept[key].eqNullSafe(F.col("_key")), "left")
    reasons = F.concat("problems", F.when(F.col("_key").isNotNull(), F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>")))
    judged = durable(marked.select(*[F.col(c) for c in kept.columns if c != "problems"], reasons.alias("reasons")))
    judged.where("size(reasons) = 0").drop("reasons").write.parquet(f"{folder}/accepted")
    judged.where("size(reasons) > 0").write.parquet(f"{folder}/quarantine")
    judged.agg(F.lit(fingerprint).alias("fingerprint"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("quarantined")).write.parquet(f"{folder}/summary")


def reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many records were refused for each reason."""
    return spark.read.parquet(f"{folder}/quarantine").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def same_inventory(first: DataFrame, second: DataFrame) -> bool:
    """Whether two inventories list the same files with the same sizes and times."""
    columns = ["path", "size", "mtime"]
    a, b = first.select(*columns), second.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def receipt(spark: SparkSession, path: str, source_id: str, folder: str) -> str:
    """Hashes a source that stands still and writes its receipt; the receipt's id.

    The files are listed before, with and after hashing, and the lists must
    agree. The receipt is named by the digest of the source's id and its files'
    ordered digests; one that exists is left alone and fails.
    """
    before = durable(inventory(spark, path, digest=False))
    hashed = durable(inventory(spark, path))
    if not (same_inventory(before, hashed) and same_inventory(hashed, inventory(spark, path, digest=False))):
        raise ValueError(f"{path} changed while it was read")
    root = merkle.rooted(hashed, ["path"], ["path", "size", "sha256"]).first()
    name = hashlib.sha256(f"{source_id}\n{root['rows']}\n{root['digest']}".encode()).hexdigest()
    hashed.write.parquet(f"{folder}/{name}")
    return name


def captured(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """path, size, sha256 and problem of the files of an input: changed while hashed, or not as expected."""
    before = durable(inventory(spark, path, digest=False)).select("path", F.col("size").alias("size_before"), F.col("mtime").alias("mtime_before"))
    hashed = durable(inventory(spark, path))
    wrong = F.when(~(F.col("size").eqNullSafe(F.col("size_before")) & F.col("mtime").eqNullSafe(F.col("mtime_before"))), "changed")
    if expected is not None:
        wrong = wrong.when(F.col("sha256") != expected.lower(), "digest")
    return hashed.join(before, "path", "full").select("path", "size", "sha256", wrong.alias("problem"))
