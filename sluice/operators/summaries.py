"""Summaries: quantile profiles, quality totals, moments with gaps filled, reviews of variants, stacked frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.arrays import norm, points
from sluice.operators.kernels import HAND_SQL, JOINTS, hand_edges
from sluice.operators.registry import query, table
from sluice.operators.series import frames, motion, quantiles
from sluice.plans import quantile

PROFILE = {"low": 0.0, "p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}
DECIMATION = 5
#: Frames that a review of variants shows.
WORST = 10

_MOVED = "SELECT abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events"


@query(f"WITH m AS ({_MOVED}) SELECT {', '.join(f'round(quantile_cont(d, {q}), 6) AS {n}' for n, q in PROFILE.items())}, count(d) AS n FROM m WHERE d IS NOT NULL")
def motion_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven exact quantiles of frame-to-frame motion, pooled over all sequences."""
    return quantiles(motion(spark, sf_dir), "d", PROFILE).select(*[F.round(n, 6).alias(n) for n in PROFILE], "n")


@query(f"WITH m AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) SELECT user_id, {', '.join(f'round(quantile_cont(d, {q}), 6) AS {n}' for n, q in PROFILE.items())}, count(d) AS n FROM m WHERE d IS NOT NULL GROUP BY user_id")
def motion_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of each sequence."""
    found = quantile.grouped(motion(spark, sf_dir), ["user_id"], "d", PROFILE)
    return found.select("user_id", *[F.round(n, 6).alias(n) for n in PROFILE], "n")


@query("""
WITH e AS (SELECT user_id, event_type, value, event_type || 'x' || event_id % 3 AS resolution FROM events), t AS (SELECT count(*) AS frames, avg((event_type <> 'error')::INT) AS valid, avg((value BETWEEN 0 AND 80)::INT) AS in_bounds FROM e)
SELECT resolution, count(*) AS samples, any_value(frames) AS frames, round(any_value(valid), 6) AS valid, round(any_value(in_bounds), 6) AS in_bounds FROM e, t GROUP BY resolution""")
def quality_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, share valid and share in bounds of all, and samples by resolution."""
    events = table(spark, sf_dir, "events")
    resolution = F.concat("event_type", F.lit("x"), (F.col("event_id") % 3).cast("string")).alias("resolution")
    by = events.groupBy(resolution).agg(F.count("*").alias("samples"), F.count_if(F.col("event_type") != "error").alias("v"), F.count_if(F.col("value").between(0, 80)).alias("b"))
    totals = by.agg(F.sum("samples").alias("frames"), (F.sum("v") / F.sum("samples")).alias("valid"), (F.sum("b") / F.sum("samples")).alias("in_bounds"))
    return by.crossJoin(F.broadcast(totals)).select("resolution", "samples", "frames", F.round("valid", 6).alias("valid"), F.round("in_bounds", 6).alias("in_bounds"))


@query("""
WITH l AS (SELECT label, axis % 3 AS axis, CASE WHEN (vec_id + axis) % 11 = 0 THEN NULL ELSE x END AS x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings)),
m AS (SELECT label, avg(x) AS mean FROM l GROUP BY label), f AS (SELECT axis, coalesce(x, mean) AS x, x IS NULL AS filled FROM l JOIN m USING (label))
SELECT axis, count(*) AS n, count(*) FILTER (filled) AS imputed, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM f GROUP BY axis""")
def imputed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation by axis; values that are not numbers count as the mean of their file."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    gaps = long.select("label", (F.col("i") % 3).cast("long").alias("axis"), F.when((F.col("vec_id") + F.col("i")) % 11 != 0, F.col("x")).alias("x"))
    # one sum over (file, axis), numbers and gaps apart, gives both the files' means and what filling them adds
    sums = gaps.groupBy("label", "axis").agg(F.count("*").alias("n"), F.count("x").alias("k"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    means = sums.groupBy("label").agg((F.sum("s") / F.sum("k")).alias("mean"))
    filled = sums.join(means, "label").select("axis", "n", (F.col("n") - F.col("k")).alias("gaps"), "mean", "s", "q")
    whole = filled.groupBy("axis").agg(F.sum("n").alias("n"), F.sum("gaps").alias("imputed"), F.sum(F.col("s") + F.col("gaps") * F.col("mean")).alias("s"), F.sum(F.col("q") + F.col("gaps") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / F.col("n")
    return whole.select("axis", "n", "imputed", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.col("q") / F.col("n") - mean * mean), 6).alias("deviation"))


_VARIANTS = """
WITH j AS (SELECT vec_id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(21) r(i)),
d AS (SELECT a.vec_id, a.i, k.k, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM j a JOIN (SELECT unnest([1, 2]) AS k) k ON true JOIN j b ON b.vec_id = a.vec_id + k.k AND a.i = b.i),
f AS (SELECT vec_id, max(d) AS worst, arg_max(i, (d, -i)) AS joint FROM d GROUP BY vec_id)"""


@query(f"{_VARIANTS}, s AS (SELECT k AS variant, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS most FROM d GROUP BY k) SELECT variant::INT AS variant, mean, median, p95, most FROM s")
def variant_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each variant's joints from the base's: mean, median, p95 and most."""
    spread = variant_joints(spark, sf_dir).select(F.posexplode(F.array("a", "b")).alias("k", "d")).where("d is not null").select((F.col("k") + 1).alias("variant"), F.explode("d").alias("d"))
    found = None
    # two variants, a pass for each: no task holds all distances of one
    for k in (1, 2):
        of = spread.where(F.col("variant") == k).select("d")
        marks = quantiles(of, "d", {"median": 0.5, "p95": 0.95, "most": 1.0}).crossJoin(F.broadcast(of.agg(F.avg("d").alias("mean")))).select(F.lit(k).alias("variant"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "most")])
        found = marks if found is None else found.unionByName(marks)
    return found


@query(f"{_VARIANTS} SELECT vec_id, joint::INT AS joint, round(worst, 6) AS worst FROM f ORDER BY worst DESC, vec_id LIMIT {WORST}")
def variant_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that any variant moves most, and the joint that it moves."""
    most = F.zip_with(F.coalesce("a", "b"), F.coalesce("b", "a"), lambda x, y: F.greatest(x, y))
    rows = variant_joints(spark, sf_dir).where("a is not null or b is not null").select("vec_id", most.alias("d")).select("vec_id", F.array_max("d").alias("worst"), (F.array_position("d", F.array_max("d")) - 1).cast("int").alias("joint"))
    return rows.orderBy(F.desc("worst"), "vec_id").limit(WORST).select("vec_id", "joint", F.round("worst", 6).alias("worst"))


def variant_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the distances of its joints from those of two variants: the next vector and the one after."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", points(F.col("embedding").cast("array<double>")).alias("p"))
    other = lambda k: poses.select((F.col("vec_id") - k).alias("vec_id"), F.col("p").alias(f"q{k}"))
    apart = lambda k: F.zip_with("p", f"q{k}", lambda x, y: norm(F.zip_with(x, y, lambda u, v: u - v)))
    both = poses.join(other(1), "vec_id", "left").join(other(2), "vec_id", "left")
    return both.select("vec_id", apart(1).alias("a"), apart(2).alias("b"))


@query(f"""
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events), k AS (SELECT user_id, event_id, frame // {DECIMATION} AS place, count(*) OVER (PARTITION BY user_id) AS n FROM f WHERE frame % {DECIMATION} = 0)
SELECT user_id, event_id, (place * {DECIMATION})::BIGINT AS frame FROM k WHERE place = n // 2""")
def central_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle one of the frames that decimation keeps."""
    kept = frames(spark, sf_dir).where(F.col("frame") % DECIMATION == 0)
    counts = kept.groupBy("user_id").agg(F.count("*").alias("n"))
    middle = F.floor(F.col("n") / 2) * DECIMATION
    return kept.join(counts, "user_id").where(F.col("frame") == middle).select("user_id", "event_id", "frame")


@query(f"WITH e(a, b) AS (VALUES {HAND_SQL}), s AS (SELECT a, b FROM e UNION ALL SELECT i::INT, i::INT FROM range({JOINTS}) r(i)), d AS (SELECT b, count(*) AS n FROM s GROUP BY b) SELECT s.a, s.b, round(1 / n, 6) AS weight FROM s JOIN d USING (b)")
def directed_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a directed skeleton's edges and loops, each over the number that end where it does."""
    loops = spark.range(JOINTS).select(F.col("id").cast("int").alias("a"), F.col("id").cast("int").alias("b"))
    every = hand_edges(spark).unionByName(loops)
    return every.join(every.groupBy("b").agg(F.count("*").alias("n")), "b").select("a", "b", F.round(1 / F.col("n"), 6).alias("weight"))


def stacked(rows: DataFrame, keys: list[str], frame: str, values: str) -> DataFrame:
    """keys and frames: a sequence's frames in order; one of another shape than the first, or lost, is zeros."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(F.size(values).alias("n"), _shape(F.col(values)).alias("shape")), frame).alias("_first"))
    joined = rows.join(first, keys)
    zeros = F.array_repeat(F.lit(0.0), F.col("_first.n"))
    fits = F.coalesce(_shape(F.col(values)) == F.col("_first.shape"), F.lit(False))
    placed = joined.select(*keys, F.struct(F.col(frame).alias("at"), F.when(fits, F.col(values)).otherwise(zeros).alias("v")).alias("f"))
    # a sequence is the unit here, as a document is
    return placed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["v"]).alias("frames"))


def unstacked(rows: DataFrame, keys: list[str], frames: str, frame: str = "frame", values: str = "values") -> DataFrame:
    """A row for each frame of a sequence, numbered from 0: what :func:`stacked` puts together; an empty sequence has none."""
    return rows.select(*keys, F.posexplode(frames).alias(frame, values))


def _shape(values: Column) -> Column:
    return F.when(values.isNotNull(), F.size(values))
