"""What the vector searches share: valid vectors, samples of them, shards, and searching these."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.sampling import hash_sample
from sluice.plans.lineage import durable

BUILD, PROBE = 0, 1
#: Bytes of the vectors of a sample, at most.
SAMPLE_BYTES = 32 * 2**20
#: Hits that a task holds before it drops those that cannot be among the best.
HELD = 400_000


def valid_vectors(table: DataFrame, zero: bool = True) -> DataFrame:
    """row (a number of its own), vec_id, vector and dim of the rows that take part, kept in the shared folder.

    Vectors that are null, empty or hold null or non-finite components do not,
    nor rows without vec_id, nor (with ``zero=False``) vectors of zeros. Rows
    that share a vec_id are rows of their own.
    """
    kind = "array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector")).where("vec_id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0.0))
    return durable(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("dim")))


def samples(vectors: DataFrame, at_most: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: how many there are, and rows and vectors of a bounded sample."""
    found = {}
    # as many rows as there are lengths of vectors
    for r in vectors.groupBy("dim").count().orderBy("dim").collect():
        few = max(1, min(at_most, SAMPLE_BYTES // (8 * r["dim"])))
        picked = hash_sample(vectors.where(F.col("dim") == r["dim"]).select("row", "vector"), "row", few, r["count"]).toArrow()
        order = np.argsort(picked["row"].to_numpy())
        x = picked["vector"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, r["dim"])
        found[r["dim"]] = (r["count"], picked["row"].to_numpy()[order], x[order])
    return found


def matrices(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each length among a batch's vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        part = batch.column(column) if len(at) == len(dims) else batch.column(column).take(pa.array(at))
        yield dim, at, part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of ``x``; with fewer rows than ``k``, the rows."""
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + 4096] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Shards:
    """Which shards the rows of a length's lists lie in: several small lists in one, a long one in several."""

    def __init__(self, counts: np.ndarray, rows: int, first: int):
        self.first, self.width, at, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), first, 0
        for k, n in enumerate(counts.tolist()):
            if filled and filled + n > rows:
                at, filled = at + 1, 0
            self.first[k], self.width[k] = at, max(1, math.ceil(n / rows))
            if n > rows:
                at, filled = at + int(self.width[k]), 0
            else:
                filled += n
        self.end = at + 1

    def of_rows(self, lists: np.ndarray, rows: np.ndarray) -> np.ndarray:
        mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[lists] + (mixed % self.width[lists].astype(np.uint64)).astype(np.int64)

    def visits(self, lists: np.ndarray) -> dict[int, list[int]]:
        """The shards of some lists, and the lists to look at in each."""
        found: dict[int, list[int]] = {}
        for k in lists.tolist():
            for shard in range(int(self.first[k]), int(self.first[k] + self.width[k])):
                found.setdefault(shard, []).append(k)
        return found


def searched_shards(build: DataFrame, visits: DataFrame, search: Callable, prepare: Callable, keep: int, score: str) -> DataFrame:
    """Hits (q_row, query_id, row, vec_id, score) of queries in the shards that they visit.

    ``build`` has shard, dim, row, vec_id, list and what ``prepare`` reads;
    ``visits`` has shard, dim, row, vec_id, vector, lists and floor. A shard is
    held and prepared once, and its queries stream past. Of a query's hits in
    all shards of a task the best ``keep`` go on.
    """
    kinds = {"vector": visits.schema["vector"].dataType.simpleString(), "code": "binary", "list": "int", "lists": "array<int>", "floor": "double"}
    columns = ["shard", "role", "dim", "row", "vec_id", *kinds]

    def filled(rows: DataFrame, role: int) -> DataFrame:
        made = rows.withColumn("role", F.lit(role))
        return made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(kinds[c] if c in kinds else made.schema[c].dataType).alias(c) for c in columns])

    dealt = filled(build, BUILD).unionByName(filled(visits, PROBE)).repartition("shard").sortWithinPartitions("shard", "role")
    return dealt.mapInArrow(_run(search, prepare, keep), f"q_row long, query_id long, row long, vec_id long, score {score}")


def _run(search: Callable, prepare: Callable, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ready, held, size = None, [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, role = batch.column("shard").to_numpy(), batch.column("role").to_numpy()
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)]):
                if shard[a] != at:
                    at, parts, ready = shard[a], [], None
                if role[a] == BUILD:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    ready = ready or prepare(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                    for k in range(a, b, 256):
                        held.append(search(batch.slice(k, min(256, b - k)), ready))
                        size += len(held[-1][0])
                        if size > HELD:
                            held = [best(*map(np.concatenate, zip(*held)), keep)]
                            size = len(held[0][0])
                            if size > HELD // 2:
                                yield _hits(held[0])
                                held, size = [], 0
        if held:
            yield _hits(best(*map(np.concatenate, zip(*held)), keep))

    return run


Hits = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def best(q_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> Hits:
    """The ``keep`` highest scores of each query, ties to the smaller id."""
    order = np.lexsort((rows, ids, -scores, q_rows))
    sorted_rows = q_rows[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_rows)) + 1]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    top = order[rank < keep]
    return q_rows[top], queries[top], rows[top], ids[top], scores[top]


def _hits(hits: Hits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in hits[:4]), pa.array(hits[4])], names=["q_row", "query_id", "row", "vec_id", "score"])


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best hits."""
    by_score = W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def list_counts(filed: DataFrame) -> dict[tuple[int, int], int]:
    """Rows of each list of each length (as many rows as the index has lists)."""
    return {(r["dim"], r["list"]): r["count"] for r in filed.groupBy("dim", "list").count().collect()}


def shards_of(filed: DataFrame, lists: dict[int, int], rows: int) -> tuple[dict[int, Shards], dict[int, np.ndarray]]:
    """Shards of about ``rows`` rows for each length, and the sizes of its lists."""
    counts, shards, sizes, first = list_counts(filed), {}, {}, 0
    for dim, n in sorted(lists.items()):
        sizes[dim] = np.array([counts.get((dim, k), 0) for k in range(n)], np.int64)
        shards[dim] = Shards(sizes[dim], rows, first)
        first = shards[dim].end
    return shards, sizes


def dealt_out(filed: DataFrame, shards: dict[int, Shards]) -> DataFrame:
    """``filed`` and each row's shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lists, rows = (batch.column(c).to_numpy() for c in ("dim", "list", "row"))
            found = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = dims == dim
                found[at] = shards[dim].of_rows(lists[at], rows[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "shard"])

    return filed.mapInArrow(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in filed.schema) + ", shard long")


def asked(vectors: DataFrame, queries: Column, route: Callable[[int, np.ndarray, np.ndarray], tuple[list[np.ndarray], np.ndarray]], shards: dict[int, Shards]) -> DataFrame:
    """A row for each shard that a query visits, with the lists to look at there.

    ``route`` gives the lists, and the score from which hits count, of queries of a length.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, q in matrices(batch):
                rows = batch.column("row").to_numpy()[at]
                for k in range(0, len(at), 64):
                    lists, floors = route(dim, rows[k : k + 64], q[k : k + 64])
                    places, visits, found = [], [], []
                    for i, mine in enumerate(lists):
                        for shard, some in shards[dim].visits(mine).items():
                            places.append(k + i)
                            visits.append(shard)
                            found.append(some)
                    taken = batch.select(["dim", "row", "vec_id", "vector"]).take(pa.array(at[places], pa.int64()))
                    more = [pa.array(visits, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(floors[np.array(places, int) - k], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=[*taken.schema.names, "shard", "lists", "floor"])

    vector = vectors.schema["vector"].dataType.simpleString()
    return vectors.where(queries).select("dim", "row", "vec_id", "vector").mapInArrow(visit, f"dim int, row long, vec_id long, vector {vector}, shard long, lists array<int>, floor double")
