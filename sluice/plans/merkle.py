"""Digests of long ordered lists: a tree of SHA-256, so that no task holds the list and any change shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.plans.lineage import durable
from sluice.plans.ordinal import with_ordinal

#: Digests under one node.
FAN = 1024


def leaf(columns: list[str]) -> Column:
    """A row's digest: of the columns' names and values, in the names' order, nulls included."""
    written = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit("row\n"), written), 256)


def rooted(rows: DataFrame, order: list[str], columns: list[str], within: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """rows and digest, for each group of ``within``, of its rows in ``order``.

    A node is the digest of at most ``fan`` digests in their order; the last one
    is bound to the number of rows. Rows that agree in ``order`` are put in the
    order of their own digests. Groups without rows have no digest; without
    ``within`` an empty table is one group.
    """
    within = within or []
    leaves = with_ordinal(rows.select(*within, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], leaf(columns).alias("_digest")), [*[f"_o{i}" for i in range(len(order))], "_digest"], within, "_at")
    level = durable(leaves.select(*within, "_at", "_digest"))
    totals = level.groupBy(*within).agg(F.count("*").alias("rows"))
    longest = totals.agg(F.max("rows").alias("n")).first()["n"] or 0
    while longest > 1:
        longest = -(-longest // fan)
        nodes = level.groupBy(*within, F.floor(F.col("_at") / fan).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_at", "_digest"))).alias("_under"))
        level = nodes.select(*within, "_at", F.sha2(F.concat(F.lit("node\n"), F.array_join("_under._digest", "\n")), 256).alias("_digest"))
    root = F.sha2(F.concat_ws("\n", F.lit("root"), F.col("rows").cast("string"), F.coalesce("_digest", F.lit(""))), 256)
    if not within:
        return totals.join(level, F.col("_at") == 0, "left").select("rows", root.alias("digest"))
    met = totals.alias("t")
    condition = F.lit(True)
    for c in within:
        condition = condition & F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}"))
    return met.join(level.alias("l"), condition).select(*[F.col(f"t.{c}") for c in within], "rows", root.alias("digest"))
