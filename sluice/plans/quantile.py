"""Exact quantiles of many groups, one of which may hold most rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.plans.lineage import durable
from sluice.plans.segments import met


def grouped(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The keys, n, and by name the exact quantiles (on the line between neighbours) of a group's values that are not null.

    Like values of a group are counted first. Values lie in ranges of (group,
    value), so a large group has many; the ranges' counts, a row for each range
    and group, tell which ones hold a quantile's neighbours, and only those are
    put in order.
    """
    counted = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    placed = durable(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    of_group = W.partitionBy(*keys)
    upto = F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
    ranges = sums.select(*keys, "_part", (upto - F.col("_rows")).alias("_before"), upto.alias("_upto"), F.sum("_rows").over(of_group).alias("n"))
    place = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    ends = [end(p) for p in place.values() for end in (F.floor, F.ceil)]
    wanted = ranges.where(functools.reduce(operator.or_, [e.between(F.col("_before"), F.col("_upto") - 1) for e in ends]))
    held = met(placed, wanted, [*keys, "_part"], "inner", ["_before", "n"])
    end = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    at = held.select(*keys, "n", "_v", (end - F.col("_n")).alias("_from"), end.alias("_to"))
    pick = lambda p: F.max(F.when((p >= F.col("_from")) & (p < F.col("_to")), F.col("_v")))
    found = at.groupBy(*keys, "n").agg(*[pick(side(p)).alias(f"{kind}_{name}") for name, p in place.items() for kind, side in (("low", F.floor), ("high", F.ceil))])
    line = lambda name, p: F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (p - F.floor(p))
    return found.select(*keys, "n", *[line(name, p).alias(name) for name, p in place.items()])
