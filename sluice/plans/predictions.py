"""Shards of predictions: what each rank wrote, its receipt, and a merge that refuses what does not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans import merkle
from sluice.plans.ordinal import with_ordinal

KEY = "sample_id"


def receipts(shards: DataFrame) -> DataFrame:
    """rank, rows and the digest of each rank's rows in the order of their keys."""
    return merkle.rooted(shards, [KEY], [c for c in shards.columns if c != "rank"], ["rank"])


def written(shards: DataFrame, folder: str) -> None:
    """Each rank's rows in a folder of their own, sorted by key, and the receipts; folders that exist fail."""
    shards.repartition("rank").sortWithinPartitions("rank", KEY).write.partitionBy("rank").parquet(f"{folder}/shards")
    receipts(shards.sparkSession.read.parquet(f"{folder}/shards")).write.parquet(f"{folder}/receipts")


def problems(shards: DataFrame, told: DataFrame, expected: DataFrame | None, ranks: int) -> DataFrame:
    """problem and detail: ranks missing or unknown, shards that differ from their receipt, keys repeated, missing or unexpected."""
    spark = shards.sparkSession
    say = lambda df, problem, detail: df.select(F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    every, found = spark.range(ranks).select(F.col("id").cast("int").alias("rank")), receipts(shards)
    there = told.select(F.col("rank").cast("int").alias("rank"))
    same = ["rank", "rows", "digest"]
    checks = [
        say(every.join(there, "rank", "left_anti"), "missing rank", F.col("rank")),
        say(there.join(every, "rank", "left_anti"), "unknown rank", F.col("rank")),
        say(told.join(found, same, "left_anti"), "tampered", F.col("rank")),
        say(found.join(told, "rank", "left_anti"), "no receipt", F.col("rank")),
        say(shards.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1"), "repeated", F.col(KEY)),
    ]
    if expected is not None:
        checks += [say(expected.join(shards, KEY, "left_anti"), "missing", F.col(KEY)), say(shards.join(expected, KEY, "left_anti"), "unexpected", F.col(KEY))]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def merged(spark: SparkSession, folder: str, expected: DataFrame | None, ranks: int) -> DataFrame:
    """All ranks' rows in the order of their keys, with their place; raises if anything is wrong."""
    shards = spark.read.parquet(f"{folder}/shards")
    wrong = problems(shards, spark.read.parquet(f"{folder}/receipts"), expected, ranks).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['problem']}: {r['detail']}" for r in wrong))
    return with_ordinal(shards.drop("rank"), [KEY], name="place")
