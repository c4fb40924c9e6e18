"""Metrics of a stream whose state is sums: kept by batch, added up over batches, runs and shards.

A metric that is a function of sums needs no state in workers: the sums of a
batch are its state, a few rows, written to the batch's own folder, so a batch
that is run again overwrites what it wrote, and a run goes on where one stopped.
Merging states, of one run or of many shards, is one more sum; scores come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.overlap import overlap
from sluice.functions.text import tokens_none

ORDER = 4


def text_state(pairs: DataFrame) -> DataFrame:
    """metric, n and the sums x, y, z of pairs of texts (hyp, ref): pairs, exact matches and edits; characters; and n-grams by order."""
    bare = pairs.where("hyp is not null and ref is not null").select(F.trim("hyp").alias("hyp"), F.trim("ref").alias("ref"))
    row = lambda metric, n, *sums: F.struct(F.lit(metric).alias("metric"), F.lit(n).alias("n"), *[s.cast("long").alias(c) for s, c in zip(sums, "xyz")])
    totals = bare.agg(F.count("*").alias("pairs"), F.count_if(F.col("hyp") == F.col("ref")).alias("exact"), F.coalesce(F.sum(F.levenshtein("hyp", "ref")), F.lit(0)).alias("edits"), F.coalesce(F.sum(F.length("ref")), F.lit(0)).alias("characters"))
    told = totals.select(F.inline(F.array(row("pairs", 0, F.col("pairs"), F.col("exact"), F.col("edits")), row("characters", 0, F.col("characters"), F.lit(0), F.lit(0)))))
    grams = pairs.select(F.inline(overlap(tokens_none(F.col("hyp")), tokens_none(F.col("ref")), ORDER))).groupBy("n").agg(*[F.sum(c).cast("long").alias(a) for c, a in (("hyp_grams", "x"), ("ref_grams", "y"), ("matched", "z"))])
    return told.unionByName(grams.select(F.lit("ngrams").alias("metric"), F.col("n").cast("int").alias("n"), "x", "y", "z"))


def accumulated(stream: DataFrame, state: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now; the state of each batch goes to the batch's folder."""

    def add(batch: DataFrame, number: int) -> None:
        state(batch).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, *folders: str) -> DataFrame:
    """metric, n and the sums of all batches of some folders: of one run, or of the shards of many."""
    every = None
    for folder in folders:
        own = spark.read.parquet(folder).select("metric", "n", "x", "y", "z")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("metric", "n").agg(*[F.sum(c).alias(c) for c in "xyz"])


def text_scores(state: DataFrame) -> DataFrame:
    """n, exact, edits, characters and cer, as :func:`sluice.operators.scores.language_totals` has them, from a state."""
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    sums = state.agg(of("pairs", "x").alias("n"), of("pairs", "y").alias("same"), of("pairs", "z").alias("edits"), of("characters", "x").alias("characters"))
    return sums.select("n", F.round(F.try_divide("same", F.col("n")), 6).alias("exact"), "edits", "characters", F.round(F.try_divide("edits", F.col("characters")), 6).alias("cer"))


def ngrams(state: DataFrame) -> DataFrame:
    """n, hyp_grams, ref_grams and matched of a state: what :func:`sluice.operators.scores.bleu` reads."""
    return state.where("metric = 'ngrams'").select("n", F.col("x").alias("hyp_grams"), F.col("y").alias("ref_grams"), F.col("z").alias("matched"))
