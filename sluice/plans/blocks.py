"""All pairs of vectors by tiles: only what each row needs of its products leaves a task, never a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.lineage import durable
from sluice.plans.ordinal import with_ordinal

BLOCK = 1024
#: Strips that the rows are cut into; each goes to one task for each other. Longer strips than LONGEST make more of them.
STRIPS, LONGEST = 16, 1 << 17
HELD, PASSING = 0, 1


def similarities(rows: DataFrame, key: str, vector: str, scale: float = 1.0, same_from: float = 0.999, block: int = BLOCK, strips: int = STRIPS, longest: int = LONGEST) -> DataFrame:
    """The key, and of each row's cosines with all rows: nearest and nearest_key, log_sum_exp (of the scaled cosines, its own
    among them), positive (its own cosine) and same_as (others of ``same_from`` or more).

    Ties for the nearest go to the smaller key; a row without a neighbour has
    none. Vectors of zeros, null, empty or with parts that are no finite numbers take no part;
    all others must agree in length. Rows are cut into blocks and these into strips, ``strips`` of
    them at most unless they would be longer than ``longest``, so the blocks are moved so many times
    and no more often when the table grows. A pair of strips is one task's work: one is held, the other's
    blocks stream past it, and each row of both gets one row of sums.
    """
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    known = rows.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast(kind).alias("_v"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0.0)
    placed = with_ordinal(known.where(F.col("_key").isNotNull() & F.coalesce(fine, F.lit(False))), ["_key"], name="_at")
    blocks = durable(placed.groupBy(F.floor(F.col("_at") / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_at", "_key", "_v"))).alias("_rows")))
    many = (blocks.agg(F.max("_block")).head()[0] or 0) + 1
    wide = min(-(-many // strips), max(1, longest // block))
    last = (many - 1) // wide
    held = blocks.select("_block", F.floor(F.col("_block") / wide).alias("_strip"), F.col("_rows._key").alias("_keys"), F.col("_rows._v").alias("_vectors"))
    tile = lambda a, b: (a * F.lit(last + 1) + b).cast("long").alias("_tile")
    first = held.select("*", F.lit(HELD).alias("_role"), F.explode(F.sequence(F.col("_strip"), F.lit(last).cast("long"))).alias("_other"))
    second = held.select("*", F.lit(PASSING).alias("_role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_strip"))).alias("_other"))
    columns = ["_role", "_block", "_keys", "_vectors"]
    met = first.select(tile(F.col("_strip"), F.col("_other")), *columns).unionByName(second.select(tile(F.col("_other"), F.col("_strip")), *columns))
    dealt = met.repartition((last + 1) * (last + 2) // 2, "_tile").sortWithinPartitions("_tile", "_role", "_block")
    parts = dealt.mapInArrow(_products(scale, same_from), "_key long, nearest double, nearest_key long, total double, positive double, same_as long")
    best = F.max(F.when(F.col("nearest").isNotNull(), F.struct("nearest", (-F.col("nearest_key")).alias("minus"))))
    sums = parts.groupBy("_key").agg(best.alias("best"), F.sum("total").alias("total"), F.max("positive").alias("positive"), F.sum("same_as").alias("same_as"))
    return sums.select(F.col("_key").alias(key), F.col("best.nearest").alias("nearest"), (-F.col("best.minus")).alias("nearest_key"), (F.lit(float(scale)) + F.log("total")).alias("log_sum_exp"), "positive", "same_as")


class _Sums:
    """What some rows need of their cosines. Exponents are less that of a row's own cosine, 1, which keeps sums from overflowing."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.nearest, self.nearest_key = keys, np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
        self.total, self.positive, self.same = np.zeros(len(keys)), np.full(len(keys), np.nan), np.zeros(len(keys), np.int64)

    def add(self, cosines: np.ndarray, exponents: np.ndarray, same: np.ndarray, others: np.ndarray) -> None:
        """Cosines with ``others``, whose keys are larger than all before: (rows, others)."""
        at = cosines.argmax(axis=1)
        found = cosines[np.arange(len(at)), at]
        better = found > self.nearest
        self.nearest, self.nearest_key = np.where(better, found, self.nearest), np.where(better, others[at], self.nearest_key)
        self.total += exponents.sum(axis=1)
        self.same += same.sum(axis=1)

    def batch(self) -> pa.RecordBatch:
        alone = np.isneginf(self.nearest)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.keys), pa.array(self.nearest, mask=alone), pa.array(self.nearest_key, mask=alone), pa.array(self.total), pa.array(self.positive, mask=np.isnan(self.positive)), pa.array(self.same)],
            names=["_key", "nearest", "nearest_key", "total", "positive", "same_as"],
        )


def _products(scale: float, same_from: float):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                tile, role, block = (batch.column(c)[i].as_py() for c in ("_tile", "_role", "_block"))
                if tile != at:
                    yield from (sums.batch() for sums, _ in held.values())
                    at, held = tile, {}
                keys, vectors = batch.column("_keys")[i].values.to_numpy(), _unit(batch.column("_vectors")[i])
                if role == HELD:
                    held[block] = (_Sums(keys), vectors)
                    continue
                # a strip against itself: each pair of its blocks comes once from either side, and only the held side counts
                within, passing = block in held, _Sums(keys)
                for other, (sums, against) in held.items():
                    cosines = against @ vectors.T
                    exponents = np.exp(scale * (cosines - 1))
                    if other == block:
                        sums.positive = np.diagonal(cosines).copy()
                        np.fill_diagonal(cosines, -np.inf)
                    same = cosines >= same_from
                    sums.add(cosines, exponents, same, keys)
                    if not within:
                        passing.add(cosines.T, exponents.T, same.T, sums.keys)
                if not within:
                    yield passing.batch()
        yield from (sums.batch() for sums, _ in held.values())

    return multiply


def _unit(vectors: pa.ListScalar) -> np.ndarray:
    lists = vectors.values
    x = lists.flatten().to_numpy().astype(float).reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]
