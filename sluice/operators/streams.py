"""Queries that run a stream over the events to its end and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.registry import query, table
from sluice.operators.scores import _LANGUAGE, pairs
from sluice.plans.lineage import durable, removed, scratch
from sluice.sources import arrays
from sluice.streaming import changes, incremental, metrics

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _spread(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The events as a folder of files, as they would arrive: by time."""
    path = f"{folder}/events"
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts", "event_id").write.parquet(path)
    return path


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows by kind; at the end of the input all windows are closed."""
    with scratch(spark, "events") as folder:
        stream = incremental.new_files(spark, _spread(spark, sf_dir, folder), EVENTS)
        counts = incremental.windowed(stream, "1 day", "30 days")
        batches = incremental.numbered(counts, "complete", f"{folder}/out", f"{folder}/state")
        last = batches.agg(F.max("batch").alias("batch"))
        return durable(batches.join(F.broadcast(last), "batch").select("start", "event_type", "n", F.round("total", 4).alias("total")))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event, merged batch by batch, and how many there were."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("seen"))
    with scratch(spark, "events") as folder:
        stream = incremental.new_files(spark, _spread(spark, sf_dir, folder), EVENTS, 1).select("user_id", "event_id", F.struct("ts", "event_id").alias("version"))
        newest = incremental.upserted(spark, stream, "user_id", "version", f"{folder}/table", f"{folder}/state")
        return durable(newest.join(seen, "user_id").select("user_id", "event_id", "seen"))


@query("SELECT count(*) FILTER (value > 1 AND event_type <> 'error') AS passed, count(*) FILTER (NOT (value > 1 AND event_type <> 'error')) AS quarantined FROM events")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail go to a dead-letter sink; none is lost or met twice."""
    with scratch(spark, "events") as folder:
        good, bad = incremental.routed(incremental.new_files(spark, _spread(spark, sf_dir, folder), EVENTS), "value > 1 and event_type <> 'error'")
        for name, rows in (("good", good), ("bad", bad)):
            incremental.drained(rows, f"{folder}/{name}", f"{folder}/{name}-state")
        count = lambda name, alias: spark.read.schema(EVENTS).parquet(f"{folder}/{name}").agg(F.count("*").alias(alias))
        return durable(count("good", "passed").crossJoin(F.broadcast(count("bad", "quarantined"))))


@query()
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases on items, kept as state: who holds each, and claims granted and denied."""
    kind = F.when(F.col("event_type") == "purchase", "release").when(F.col("event_type") == "view", "beat").otherwise("claim")
    requests = lambda path: incremental.new_files(spark, path, EVENTS).select((F.col("event_id") % 7).alias("item"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker"), kind.alias("kind"), (F.unix_micros("ts") / 1e6).alias("at"))
    with scratch(spark, "events") as folder:
        batches = incremental.numbered(incremental.leased(requests(_spread(spark, sf_dir, folder))), "update", f"{folder}/out", f"{folder}/state")
        newest = batches.groupBy("item").agg(F.max_by(F.struct("holder", "grants", "denials"), "batch").alias("r"))
        return durable(newest.select("item", "r.*"))


@query("SELECT user_id, count(*) AS sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: a user's events with less than six hours between them."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return by.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("""
WITH b AS (SELECT DISTINCT vec_id // 64 AS b FROM embeddings), v AS (SELECT b, unnest(CASE b % 4 WHEN 0 THEN ['1new'] WHEN 1 THEN ['1new', '2changed'] WHEN 2 THEN ['1new', '2gone'] ELSE ['2new'] END) AS v FROM b)
SELECT b || '.npy' AS path, v[1]::BIGINT AS version, v[2:] AS change, CASE WHEN v[2:] = 'gone' THEN NULL WHEN b % 4 = 1 THEN CASE v[1] WHEN '1' THEN 'quarantined' ELSE 'current' END ELSE 'current' END AS state FROM v""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of vectors that come, change and go between two looks, with the state of each content."""
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("b")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    named = durable(rows.select("b", F.concat("b", F.lit(".npy")).alias("path"), F.col("v.embedding").alias("vectors")))
    with scratch(spark, "changes") as folder:
        arrays.written(named.where("b % 4 < 3").drop("b"), f"{folder}/in")
        changes.arrivals(spark, f"{folder}/in", f"{folder}/state")
        for r in named.where("b % 4 in (1, 2)").select("path").toLocalIterator():
            removed(spark, f"{folder}/in/{r['path']}")
        # one component more in each, so that sizes differ
        longer = named.where("b % 4 = 1").select("path", F.transform("vectors", lambda v: F.concat(v, F.array(F.lit(0.0).cast("float")))).alias("vectors"))
        arrays.written(longer.unionByName(named.where("b % 4 = 3").select("path", "vectors")), f"{folder}/in")
        found = durable(changes.arrivals(spark, f"{folder}/in", f"{folder}/state"))
        return durable(found.join(changes.variants(found).select("path", "sha256", "state"), ["path", "sha256"], "left").select("path", "version", "change", "state"))


@query(_LANGUAGE)
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text scores from the states of two shards' streams, each in several batches."""
    with scratch(spark, "metrics") as folder:
        both = durable(pairs(spark, sf_dir).withColumn("shard", F.col("conv_id") % 2))
        # three batches a shard, each of as many files as tasks can run
        wide = spark.sparkContext.defaultParallelism
        for shard in (0, 1):
            both.where(F.col("shard") == shard).select("hyp", "ref").repartition(3 * wide).write.parquet(f"{folder}/in{shard}")
            metrics.accumulated(incremental.new_files(spark, f"{folder}/in{shard}", "hyp string, ref string", wide), metrics.text_state, f"{folder}/state{shard}", f"{folder}/at{shard}")
        return durable(metrics.text_scores(metrics.merged(spark, f"{folder}/state0", f"{folder}/state1")))
