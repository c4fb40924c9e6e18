"""Sequences cut into chunks of frames, so that one long sequence keeps many tasks at work.

Frames are numbered without gaps (:func:`sluice.plans.ordinal.with_ordinal`
does that without one task for a sequence). A window of bounded reach needs its
chunk and a halo of the neighbours' frames; what reaches on without a bound, as
the last value seen, takes a chunk's own part and what one row for each chunk
before or after carries over.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 16


def with_halo(rows: DataFrame, keys: list[str], frame: str, before: int, after: int, chunk: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """``rows`` with _chunk and _own, and the window of a chunk's frames.

    A frame is also in the chunks that look back or ahead to it, by as many
    frames as ``before`` and ``after`` say; there it is not _own, and the
    caller leaves it out at the end.
    """
    of = lambda f: F.floor(f / chunk).cast("long")
    chunks = F.sequence(of(F.col(frame) - after), of(F.col(frame) + before))
    spread = rows.withColumn("_chunk", F.explode(chunks)).withColumn("_own", F.col("_chunk") == of(F.col(frame)))
    return spread, W.partitionBy(*keys, "_chunk").orderBy(frame)


def carried(rows: DataFrame, keys: list[str], frame: str, value: Column, last: str | None = None, first: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the last value that is not null up to each frame (``last``), and the first from it on (``first``)."""
    cut = rows.withColumn("_chunk", F.floor(F.col(frame) / chunk).cast("long")).withColumn("_value", value)
    sums = cut.where("_value is not null").groupBy(*keys, "_chunk").agg(F.max_by("_value", frame).alias("_last"), F.min_by("_value", frame).alias("_first"))
    # a row for each chunk of a sequence, also of those without a value
    every = cut.groupBy(*keys, "_chunk").agg(F.lit(1).alias("_one")).drop("_one")
    told = met(every, sums, [*keys, "_chunk"], "left", ["_last", "_first"])
    # what follows is what came before in the other order: a frame that reaches on without end is worked out anew for each row
    of, past = W.partitionBy(*keys), (W.unboundedPreceding, -1)
    own, upto = W.partitionBy(*keys, "_chunk"), (W.unboundedPreceding, 0)
    told = told.select(*keys, "_chunk", F.last("_last", True).over(of.orderBy("_chunk").rowsBetween(*past)).alias("_before"), F.last("_first", True).over(of.orderBy(F.desc("_chunk")).rowsBetween(*past)).alias("_after"))
    both = met(cut, told, [*keys, "_chunk"], "inner", ["_before", "_after"])
    made = []
    if last:
        made.append(F.coalesce(F.last("_value", True).over(own.orderBy(frame).rowsBetween(*upto)), "_before").alias(last))
    if first:
        made.append(F.coalesce(F.last("_value", True).over(own.orderBy(F.desc(frame)).rowsBetween(*upto)), "_after").alias(first))
    return both.select(*rows.columns, *made)


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str, columns: list[str]) -> DataFrame:
    """A join by keys that may be null."""
    a, b = left.alias("a"), right.alias("b")
    same = functools.reduce(operator.and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, same, how).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in columns])
