"""Long sequences in chunks, and exact quantiles of groups of which one is large."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import series
from sluice.plans import quantile, segments


def sequences(seed):
    rng = random.Random(seed)
    return {key: [None if rng.random() < 0.4 else round(rng.uniform(-5, 5), 3) for _ in range(rng.choice([1, 2, 7, 23, 60]))] for key in ("a", "b", "c", "d", None)} | {"none": [None] * 9}


def rows_of(spark, found):
    return spark.createDataFrame([(k, t, v) for k, values in found.items() for t, v in enumerate(values)], "key string, frame long, v double").repartition(3)


@pytest.mark.parametrize("chunk", [1, 3, 8, 1 << 16])
def test_values_are_carried_over_chunks(spark, chunk):
    found = sequences(chunk)
    got = {(r["key"], r["frame"]): (r["last"], r["first"]) for r in segments.carried(rows_of(spark, found), ["key"], "frame", F.col("v"), "last", "first", chunk).collect()}
    assert len(got) == sum(map(len, found.values()))
    for key, values in found.items():
        for t in range(len(values)):
            last, first = [v for v in values[: t + 1] if v is not None], [v for v in values[t:] if v is not None]
            assert got[key, t] == (last[-1] if last else None, first[0] if first else None)


@pytest.mark.parametrize("chunk", [1, 4, 1 << 16])
def test_gaps_and_runs_do_not_know_of_chunks(spark, chunk):
    found = sequences(chunk + 100)
    rows = rows_of(spark, found)
    got = {(r["key"], r["frame"]): (r["v"], r["imputed"]) for r in series.filled(rows, ["key"], "frame", "v", chunk).collect()}
    runs = {(r["key"], r["start"]): r["n"] for r in series.runs_of(rows, ["key"], "frame", F.col("v") > 0, chunk).collect()}
    for key, values in found.items():
        known = [(t, v) for t, v in enumerate(values) if v is not None]
        want = np.interp(range(len(values)), *zip(*known)) if known else [0.0] * len(values)
        assert all(got[key, t][0] == pytest.approx(want[t]) and got[key, t][1] == (values[t] is None) for t in range(len(values)))
        begin = None
        for t, v in enumerate([*values, None]):
            if v is not None and v > 0:
                begin = t if begin is None else begin
            elif begin is not None:
                assert runs.pop((key, begin)) == t - begin
                begin = None
    assert not runs


@pytest.mark.parametrize(("before", "after", "chunk"), [(0, 1, 1), (2, 2, 3), (5, 9, 4), (4, 4, 1 << 16)])
def test_halos_reach_as_far_as_asked(spark, before, after, chunk):
    rows = spark.range(50).selectExpr("id % 2 as key", "id div 2 as frame", "id as v")
    spread, near = segments.with_halo(rows, ["key"], "frame", before, after, chunk)
    got = spread.withColumn("sum", F.sum("v").over(near.rowsBetween(-before, after))).where("_own").collect()
    assert len(got) == 50
    assert all(r["sum"] == sum(2 * t + r["key"] for t in range(max(0, r["frame"] - before), min(24, r["frame"] + after) + 1)) for r in got)


def test_one_long_sequence_keeps_all_tasks_at_work(spark):
    n = 600_000
    rows = spark.range(n, numPartitions=8).selectExpr("1 as key", "id as frame", "if(id % 1000 < 10, cast(id as double), null) as v")
    found = series.filled(rows, ["key"], "frame", "v", chunk=1 << 14)
    # small partitions would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 0.6 * n
    told = found.where("frame in (500, 1005, 599500)").orderBy("frame").collect()
    assert [r["v"] for r in told] == [500.0, 1005.0, 599009.0] and [r["imputed"] for r in told] == [True, False, True]


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"large": rng.normal(size=5000), "like": np.full(3000, 2.5), "few": np.array([1.0]), "two": np.array([1.0, 2.0]), None: rng.integers(0, 9, 400).astype(float)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("large", None), ("empty", None)]
    shares = {"low": 0.0, "odd": 0.137, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["key"]: r for r in quantile.grouped(spark.createDataFrame(rows, "key string, v double").repartition(5), ["key"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        assert all(math.isclose(got[key][name], np.quantile(values, share), abs_tol=1e-12) for name, share in shares.items())
    assert quantile.grouped(spark.createDataFrame([], "key string, v double"), ["key"], "v", shares).collect() == []


def test_a_grid_is_not_broadcast(spark, small):
    found = series.resampled(spark, small)
    found.collect()
    lines, inside = found._jdf.queryExecution().executedPlan().toString().splitlines(), None
    for line in lines[: next(i for i, l in enumerate(lines) if "Initial Plan" in l)]:
        depth = len(line) - len(line.lstrip(" :+-"))
        inside = None if inside is not None and depth <= inside else inside
        inside = depth if inside is None and "BroadcastExchange" in line else inside
        assert inside is None or "Generate" not in line
