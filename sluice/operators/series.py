"""Time series: differences, gaps, smoothing, resampling, windows, survivors."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.registry import query, table
from sluice.plans.lineage import durable
from sluice.plans.ordinal import with_ordinal
from sluice.plans.segments import CHUNK, carried, met, with_halo

RATE = 10.0
#: Keeps values that lie between two roundings on one side.
NUDGE = 1e-9
#: Weights of a Gaussian of deviation 1, cut at four deviations.
GAUSS = [math.exp(-k * k / 2) for k in range(-4, 5)]
GAUSS = [w / sum(GAUSS) for w in GAUSS]

_FRAMES = "SELECT user_id, event_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of their user's sequence, which may be as long as all others together."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return with_ordinal(events, ["ts", "event_id"], ["user_id"], "frame")


@query(f"WITH f AS ({_FRAMES}), v AS (SELECT user_id, frame, (lead(value) OVER (PARTITION BY user_id ORDER BY frame) - value) * 10 AS v FROM f) SELECT user_id, frame, round(v, 6) AS velocity FROM v WHERE v IS NOT NULL")
def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next frame's difference times the rate; the last frame has none."""
    rows, near = with_halo(frames(spark, sf_dir), ["user_id"], "frame", 0, 1)
    v = (F.lead("value").over(near) - F.col("value")) * RATE
    return rows.select("user_id", "frame", "_own", F.round(v, 6).alias("velocity")).where("_own and velocity is not null").drop("_own")


@query(f"WITH f AS ({_FRAMES}), d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) AS d FROM f) SELECT round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS most, count(d) AS n FROM d")
def motion_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-to-frame motion, pooled over all sequences."""
    marks = quantiles(motion(spark, sf_dir), "d", {"p99": 0.99, "most": 1.0})
    return marks.select(F.round("p99", 6).alias("p99"), F.round("most", 6).alias("most"), "n")


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and d: how far each frame's value is from the one before it."""
    rows, near = with_halo(frames(spark, sf_dir), ["user_id"], "frame", 1, 0)
    return rows.select("user_id", "_own", F.abs(F.col("value") - F.lag("value").over(near)).alias("d")).where("_own and d is not null").drop("_own")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """n, and by name the exact quantiles (on the line between neighbours) of a column without nulls.

    Ranges of the values are counted, and only the ranges that hold a quantile's
    neighbours are put in order: no task holds all rows.
    """
    placed = durable(rows.select(F.col(value).cast("double").alias("v")).repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    # a row for each range
    sums = placed.groupBy("part").agg(F.count("*").alias("rows"))
    upto, every = W.orderBy("part").rowsBetween(W.unboundedPreceding, 0), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranges = sums.select("part", (F.sum("rows").over(upto) - F.col("rows")).alias("before"), F.sum("rows").over(upto).alias("upto"), F.sum("rows").over(every).alias("n"))
    place = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    ends = [end(p) for p in place.values() for end in (F.floor, F.ceil)]
    wanted = ranges.where(functools.reduce(operator.or_, [e.between(F.col("before"), F.col("upto") - 1) for e in ends]))
    held = placed.join(F.broadcast(wanted), "part")
    at = held.select("v", "n", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("v")) - 1).alias("at"))
    pick = lambda p: F.max(F.when(F.col("at") == p, F.col("v")))
    found = at.groupBy("n").agg(*[pick(end(p)).alias(f"{side}_{name}") for name, p in place.items() for side, end in (("low", F.floor), ("high", F.ceil))])
    line = lambda name, p: F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (p - F.floor(p))
    return found.select("n", *[line(name, p).alias(name) for name, p in place.items()])


@query(f"WITH f AS ({_FRAMES}) SELECT user_id, frame // 5 AS frame, value FROM f WHERE frame % 5 = 0")
def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where("frame % 5 = 0").select("user_id", F.floor(F.col("frame") / 5).alias("frame"), "value")


@query(f"""
WITH f AS ({_FRAMES}), g AS (SELECT user_id, frame, CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN NULL ELSE value END AS x FROM f),
b AS (SELECT user_id, frame, x, last_value(x IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS t0, first_value(x IGNORE NULLS) OVER n AS x1, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS t1
FROM g WINDOW p AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, frame, round(CASE WHEN x IS NOT NULL THEN x WHEN x0 IS NULL AND x1 IS NULL THEN 0 WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (frame - t0) / (t1 - t0) END, 6) AS value, x IS NULL AS imputed FROM b""")
def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled on the line between their ends, held at the edges, 0 if nothing was seen."""
    lost = (F.col("event_type") == "error") | (F.col("event_id") % 4 == 0)
    seen = frames(spark, sf_dir).select("user_id", "frame", F.when(~lost, F.col("value")).alias("x"))
    return filled(seen, ["user_id"], "frame", "x").select("user_id", "frame", F.round("x", 6).alias("value"), "imputed")


def filled(df: DataFrame, keys: list[str], frame: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the gaps of ``value`` filled, and which were; frames are numbered without gaps."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("x"), F.col(frame).alias("t")))
    known = carried(df, keys, frame, seen, "_last", "_first", chunk)
    (x0, t0), (x1, t1) = [(F.col(f"{c}.x"), F.col(f"{c}.t")) for c in ("_last", "_first")]
    line = x0 + (x1 - x0) * F.try_divide(F.col(frame) - t0, t1 - t0)
    new = F.coalesce(F.col(value), line, x0, x1, F.lit(0.0))
    return known.select(*[c for c in df.columns if c != value], new.alias(value), F.col(value).isNull().alias("imputed"))


@query(f"WITH f AS ({_FRAMES}) SELECT user_id, frame, round(value - avg(value) OVER (PARTITION BY user_id) + 1e-9, 6) AS centred FROM f")
def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values less their sequence's mean: the means are aggregated, then joined."""
    rows = frames(spark, sf_dir)
    means = rows.groupBy("user_id").agg(F.avg("value").alias("mean"))
    return rows.join(means, "user_id").select("user_id", "frame", F.round(F.col("value") - F.col("mean") + NUDGE, 6).alias("centred"))


_TERMS = " + ".join(f"{w!r} * s[1 + least((frame + {k} + 8 * n) % (2 * n), 2 * n - 1 - (frame + {k} + 8 * n) % (2 * n))]" for k, w in zip(range(-4, 5), GAUSS))


@query(f"WITH f AS ({_FRAMES}), a AS (SELECT user_id, list(value ORDER BY frame) AS s, count(*) AS n FROM f GROUP BY user_id) SELECT user_id, frame, round({_TERMS}, 6) AS smooth FROM f JOIN a USING (user_id)")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian smoothing, the ends reflected, as often as a short sequence needs."""
    rows = frames(spark, sf_dir)
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, "user_id")
    # a frame and its mirror image come back every 2n frames; where they fall on the four before and after counts
    images = F.flatten(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda j: F.array(F.col("frame") + 2 * F.col("n") * j, 2 * F.col("n") * (j + 1) - 1 - F.col("frame"))))
    images = rows.select("user_id", "n", "value", F.explode(F.filter(images, lambda p: (p >= -4) & (p < F.col("n") + 4))).alias("frame"))
    padded, near = with_halo(images, ["user_id"], "frame", 4, 4)
    total = sum((F.coalesce(F.lag("value", -k).over(near) if k < 0 else F.lead("value", k).over(near), F.lit(0.0)) * w for k, w in zip(range(-4, 5), GAUSS) if k > 0), F.lit(0.0))
    total = total + sum((F.coalesce(F.lag("value", -k).over(near), F.lit(0.0)) * w for k, w in zip(range(-4, 5), GAUSS) if k <= 0), F.lit(0.0))
    return padded.withColumn("smooth", F.round(total, 6)).where("_own and frame >= 0 and frame < n").select("user_id", "frame", "smooth")


@query(f"""
WITH f AS ({_FRAMES}), a AS (SELECT user_id, list(value ORDER BY frame) AS s, count(*) AS n FROM f GROUP BY user_id), g AS (SELECT user_id, s, n, i, i * (n - 1) / (2.0 * n - 1) AS x FROM a, LATERAL (SELECT unnest(range(2 * n)) AS i))
SELECT user_id, i AS frame, round(s[1 + floor(x)::INT] + (s[1 + least(floor(x)::INT + 1, n - 1)] - s[1 + floor(x)::INT]) * (x - floor(x)), 6) AS value FROM g""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many frames on an even grid from the first to the last, linearly."""
    rows = frames(spark, sf_dir)
    n, frame = F.col("n"), F.col("frame")
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    spread, near = with_halo(rows, ["user_id"], "frame", 0, 1)
    ahead = met(spread.withColumn("next", F.coalesce(F.lead("value").over(near), F.col("value"))).where("_own"), sizes, ["user_id"], "inner", ["n"])
    # each frame makes the places of the grid between it and the next one: a grid of its own would be joined, and looks small to the planner
    place = lambda i: i * (n - 1) / (2.0 * n - 1)
    steps = (2.0 * n - 1) / F.greatest(n - 1, F.lit(1))
    span = F.sequence(F.greatest(F.floor(frame * steps) - 1, F.lit(0)), F.least(F.ceil((frame + 1) * steps) + 1, 2 * n - 1))
    found = ahead.select("user_id", "frame", "n", "value", "next", F.explode(F.filter(span, lambda i: F.floor(place(i)) == frame)).alias("i")).withColumn("x", place(F.col("i")))
    return found.select("user_id", F.col("i").alias("frame"), F.round(F.col("value") + (F.col("next") - F.col("value")) * (F.col("x") - F.floor("x")), 6).alias("value"))


@query(f"""
WITH f AS ({_FRAMES}), a AS (SELECT user_id, list(value ORDER BY frame) AS s, count(*) AS n FROM f GROUP BY user_id)
SELECT user_id, frame, round(list_sum([CASE WHEN frame + k BETWEEN 0 AND n - 1 THEN s[1 + frame + k] ELSE 0 END FOR k IN [-2, -1, 0, 1, 2]]), 6) AS total, least(frame, 2) + least(n - 1 - frame, 2) + 1 AS real FROM f JOIN a USING (user_id)""")
def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five frames around each, zeros past the ends, and how many are real."""
    rows, near = with_halo(frames(spark, sf_dir), ["user_id"], "frame", 2, 2)
    around = near.rowsBetween(-2, 2)
    return rows.select("user_id", "frame", "_own", F.round(F.sum("value").over(around), 6).alias("total"), F.count("value").over(around).alias("real")).where("_own").drop("_own")


@query(f"""
WITH f AS ({_FRAMES}), a AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id), b AS (SELECT user_id, user_id % 4 AS batch, n, max(n) OVER (PARTITION BY user_id % 4) AS longest FROM a)
SELECT user_id, batch, n, longest - n AS padded FROM b""")
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pads a batch's sequences to its longest."""
    sizes = frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("batch", F.col("user_id") % 4)
    longest = sizes.groupBy("batch").agg(F.max("n").alias("longest"))
    return sizes.join(longest, "batch").select("user_id", "batch", "n", (F.col("longest") - F.col("n")).alias("padded"))


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS valid, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS v FROM orders)
SELECT o_custkey, min(o_orderkey) FILTER (n = 1 OR valid) AS survivor, any_value(CASE WHEN n = 1 THEN 'single' WHEN v = 1 THEN 'resolved' ELSE 'ambiguous' END) AS state FROM c GROUP BY o_custkey""")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key's variants the only valid one; several or none are ambiguous."""
    valid = F.col("o_orderstatus") == "F"
    by_key = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(valid).alias("v"), F.min("o_orderkey").alias("any"), F.min(F.when(valid, F.col("o_orderkey"))).alias("best"))
    return by_key.select("o_custkey", F.when(F.col("n") == 1, F.col("any")).otherwise(F.col("best")).alias("survivor"), F.when(F.col("n") == 1, "single").when(F.col("v") == 1, "resolved").otherwise("ambiguous").alias("state"))


@query(f"""
WITH f AS ({_FRAMES}) SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM f GROUP BY user_id""")
def strongest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of the largest value, ties to the smaller id."""
    return frames(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query(f"""
WITH f AS ({_FRAMES}), g AS (SELECT user_id, frame, event_type = 'error' AS bad, frame - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY frame) AS island FROM f)
SELECT user_id, max(n) AS longest, count(*) FILTER (n >= 2) AS breaks FROM (SELECT user_id, island, count(*) AS n FROM g WHERE bad GROUP BY user_id, island) GROUP BY user_id""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of failures in a row, and how many would trip a breaker of two."""
    runs = runs_of(frames(spark, sf_dir), ["user_id"], "frame", F.col("event_type") == "error")
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 2).alias("breaks"))


def runs_of(rows: DataFrame, keys: list[str], frame: str, holds: Column, chunk: int = CHUNK) -> DataFrame:
    """The keys, start (a frame) and n of each run of frames for which a condition holds: a run is told by its first frame."""
    spread, near = with_halo(rows.select(*keys, frame, F.coalesce(holds, F.lit(False)).alias("_holds")), keys, frame, 1, 0, chunk)
    marked = spread.withColumn("_start", F.when(F.col("_holds") & ~F.coalesce(F.lag("_holds").over(near), F.lit(False)), F.col(frame))).where("_own").drop("_own", "_chunk")
    known = carried(marked, keys, frame, F.col("_start"), "start", chunk=chunk)
    return known.where("_holds").groupBy(*keys, "start").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT ts, value, row_number() OVER (ORDER BY ts DESC, event_id) AS i FROM events), t AS (SELECT count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS span, sum(value) AS elapsed FROM r WHERE i <= 200)
SELECT n, round((n - 1) * 3600 / nullif(span, 0), 6) AS per_hour, round(n / nullif(elapsed, 0), 6) AS rate, round((SELECT count(*) - 200 FROM events) / nullif((n - 1) * 3600 / nullif(span, 0), 0), 6) AS hours_left FROM t""")
def recent_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the last 200 rows, and the time that the rest takes at them."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.orderBy(F.desc("ts"), "event_id").limit(200)
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    facts = last.agg(F.count("*").alias("n"), span.alias("span"), F.sum("value").alias("elapsed")).crossJoin(F.broadcast(events.agg(F.count("*").alias("all"))))
    per_hour = F.try_divide((F.col("n") - 1) * 3600, F.col("span"))
    return facts.select("n", F.round(per_hour, 6).alias("per_hour"), F.round(F.try_divide("n", F.col("elapsed")), 6).alias("rate"), F.round(F.try_divide(F.col("all") - 200, per_hour), 6).alias("hours_left"))


@query("""SELECT vec_id, [embedding[6 - i]::DOUBLE FOR i IN range(5)] || [embedding[11 + i]::DOUBLE FOR i IN range(5)] AS joints, embedding[1 + least(32, len(embedding) - 1)]::DOUBLE AS centre FROM embeddings""")
def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements gathered by a list of places, and the middle one."""
    places = [5, 4, 3, 2, 1, 10, 11, 12, 13, 14]
    v = F.col("embedding")
    pick: Column = F.array(*[F.get(v, F.lit(p)).cast("double") for p in places])
    return table(spark, sf_dir, "embeddings").select("vec_id", pick.alias("joints"), F.get(v, F.least(F.lit(32), F.size(v) - 1)).cast("double").alias("centre"))
