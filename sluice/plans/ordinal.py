"""Dense positions in an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.plans.lineage import durable


def with_ordinal(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "ordinal") -> DataFrame:
    """``df`` and each row's position, from 0, in ``order`` (which must tell rows apart).

    With ``within`` positions start anew in each of its groups. Rows are dealt
    out by ranges of the order; the ranges' counts (a row for each range and
    group) give their offsets.
    """
    within = within or []
    placed = durable(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*within).orderBy("_range") if within else W.orderBy("_range")
    offsets = counts.select("_range", *within, (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    local = placed.withColumn("_at", F.row_number().over(W.partitionBy("_range", *within).orderBy(*order)) - 1)
    met = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_range", *within)]
    condition = met[0]
    for m in met[1:]:
        condition = condition & m
    joined = local.alias("l").join(offsets.alias("r"), condition)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_at") + F.col("_before")).cast("long").alias(name))
