"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments, few and long at first, then more and shorter,
down to two components and then, part by part, one. Mean and deviation of the
segments bound the distance of two vectors from below (and so their inner
product from above: it is half of both squared lengths less the squared
distance).

First a bounded sample of the candidates gives each query a score that its k-th
best reaches at least. Candidates are filed in groups of like segment means;
the range of a group's statistics bounds all of its members, so a query visits
only groups that may hold one of its best. There whatever cannot reach the k-th
score is dropped, coarse to fine, and the survivors are scored exactly. Groups
lie in shards of bounded size; a shard returns at most k hits for a query.

Defined cases: see :func:`sluice.llm.vectors.valid_vectors`; only vectors of
the query's length are its candidates; rows that share an id, or are equal, are
candidates of each other; scores beyond a long are held at its ends; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.vectors import Hits, asked, best, dealt_out, k_means, matrices, nearest, ranked, samples, searched_shards, shards_of, valid_vectors
from sluice.plans.lineage import durable

K = 20
SCALE = 64.0
#: Rows of a shard, about.
SHARD_ROWS = 8_192
#: Candidates that give the queries their first k-th scores, at most.
SAMPLE_ROWS = 16_384
#: Groups of a length, at most.
GROUPS = 256
#: Segments of the first levels.
SEGMENTS = (4, 16)
#: Share of pairs left from which a level is worked out for all pairs at once.
DENSE = 0.05
SEED = 20_261
_EXACT = 2.0**53
_PAIRS = 65_536


def levels(dim: int) -> list[np.ndarray]:
    """Where segments begin, level by level: each is finer than the one before."""
    halves = np.arange(0, dim, 2)
    found = [np.unique((np.arange(s) * dim) // s) for s in SEGMENTS if s < len(halves)]
    found.append(halves)
    # then half, three quarters and seven eighths of the components stand alone
    found += [np.concatenate([np.arange(cut), np.arange(cut, dim, 2)]) for cut in dict.fromkeys((dim // 2 // 2 * 2, dim * 3 // 4 // 2 * 2, dim * 7 // 8 // 2 * 2)) if cut]
    return [f for n, f in enumerate(found) if n == 0 or len(f) > len(found[n - 1])]


def features(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Weighted means and deviations of the segments: products of two vectors'
    features bound their inner product from above. Single components have no deviation."""
    widths = np.diff(np.append(begins, x.shape[1]))
    means = np.add.reduceat(x, begins, axis=1) / np.sqrt(widths)
    wide = widths > 1
    squares = np.add.reduceat(x * x, begins, axis=1)[:, wide] - means[:, wide] ** 2
    return np.concatenate([means, np.sqrt(np.maximum(squares, 0.0))], axis=1)


def _slack(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound, for each query."""
    longest = np.sqrt((theirs**2).sum(axis=1).max(initial=0))
    # deviations are differences of squares, so they keep half of the digits
    return 1e-6 * np.sqrt((mine**2).sum(axis=1)) * longest + 1e-6


def _exact(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (rows, cols)."""
    if max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * q.shape[1] < _EXACT:
        out = [np.einsum("ij,ij->i", q[rows[k : k + _PAIRS]], x[cols[k : k + _PAIRS]]) for k in range(0, len(rows), _PAIRS)]
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q[r], x[c])), low), high) for r, c in zip(rows, cols)], np.int64)


def survivors(q: np.ndarray, x: np.ndarray, theirs: list[np.ndarray], need: np.ndarray, allowed: np.ndarray, told: Callable[[int, int], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows, cols) of those allowed whose bounds reach ``need`` at every level."""
    rows = cols = None
    for n, (begins, f) in enumerate(zip(levels(q.shape[1]), theirs)):
        mine = features(q, begins)
        least = need - _slack(mine, f)
        if rows is None or len(rows) > DENSE * allowed.size:
            bound = ~(mine @ f.T < least[:, None])
            rows, cols = np.nonzero(bound & allowed) if rows is None else (rows[(left := bound[rows, cols])], cols[left])
        else:
            kept = [~(np.einsum("ij,ij->i", mine[rows[a : a + _PAIRS]], f[cols[a : a + _PAIRS]]) < least[rows[a : a + _PAIRS]]) for a in range(0, len(rows), _PAIRS)]
            left = np.concatenate(kept or [np.zeros(0, bool)])
            rows, cols = rows[left], cols[left]
        if told:
            told(n, len(rows))
    return rows, cols


def _prepare(batch: pa.RecordBatch) -> tuple:
    (dim, _, x), = matrices(batch)
    return batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("list").to_numpy(), x, [features(x, b) for b in levels(dim)]


def _searcher(k: int):
    def search(batch: pa.RecordBatch, ready: tuple) -> Hits:
        rows, ids, lists, x, theirs = ready
        (_, _, q), = matrices(batch)
        q_rows, q_ids, need = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("floor").to_numpy()
        allowed = q_rows[:, None] != rows[None, :]
        asked_for = batch.column("lists")
        if len(set(lists.tolist())) > 1:
            allowed &= np.stack([np.isin(lists, mine.values.to_numpy()) for mine in asked_for])
        i, j = survivors(q, x, theirs, need, allowed)
        scores = _exact(q, x, i, j)
        left = scores >= need[i]
        i, j, scores = i[left], j[left], scores[left]
        return best(q_rows[i], q_ids[i], rows[j], ids[j], scores, k)

    return search


def _grouped(centres: dict[int, np.ndarray]):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            for dim, at, x in matrices(batch):
                found[at] = nearest(_means(x), centres[dim])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "vector", "dim")), pa.array(found)], names=["row", "vec_id", "vector", "dim", "list"])

    return group


def _begins(dim: int) -> np.ndarray:
    """Segments whose means tell groups apart, and whose ranges bound them."""
    return levels(dim)[min(1, len(levels(dim)) - 1)]


def _means(x: np.ndarray) -> np.ndarray:
    begins = _begins(x.shape[1])
    return features(x, begins)[:, : len(begins)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest of each statistic in each group of a partition."""
    seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        lists = batch.column("list").to_numpy()
        for dim, at, x in matrices(batch):
            f = features(x, _begins(dim))
            for k in np.unique(lists[at]).tolist():
                part = f[lists[at] == k]
                low, high = part.min(axis=0), part.max(axis=0)
                was = seen.get((dim, k), (low, high))
                seen[dim, k] = np.minimum(low, was[0]), np.maximum(high, was[1])
    rows = [(dim, k, n, float(a), float(b)) for (dim, k), (low, high) in seen.items() for n, (a, b) in enumerate(zip(low, high))]
    columns = list(zip(*rows)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["dim", "list", "place", "low", "high"])


def searched(table: DataFrame, queries: Column, k: int = K, scale: float = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products
    of each vector that ``queries`` (a condition on vec_id) picks, with all others."""
    grid = valid_vectors(table).withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    found = samples(grid, SAMPLE_ROWS)
    rng = np.random.default_rng(SEED)
    centres = {dim: k_means(_means(x), min(GROUPS, math.ceil(n / shard_rows)), rng) for dim, (n, _, x) in found.items()}
    filed = durable(grid.mapInArrow(_grouped(centres), "row long, vec_id long, vector array<double>, dim int, list int"))
    shards, sizes = shards_of(filed, {dim: len(c) for dim, c in centres.items()}, shard_rows)
    bounds = {dim: np.zeros((2, len(c), features(np.zeros((1, dim)), _begins(dim)).shape[1])) for dim, c in centres.items()}
    # a row for each group and statistic
    for r in filed.mapInArrow(_ranges, "dim int, list int, place int, low double, high double").groupBy("dim", "list", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        bounds[r["dim"]][:, r["list"], r["place"]] = r["low"], r["high"]

    def route(dim: int, rows: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        _, known, x = found[dim]
        scores = np.sort(np.where(rows[:, None] == known[None, :], -np.inf, q @ x.T), axis=1)
        exact = max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) * dim < _EXACT
        floors = scores[:, -k] if exact and scores.shape[1] >= k else np.full(len(q), -np.inf)
        mine, (low, high) = features(q, _begins(dim)), bounds[dim]
        most = np.maximum(mine[:, None, :] * low[None], mine[:, None, :] * high[None]).sum(axis=2)
        reached = ~(most < floors[:, None] - _slack(mine, np.maximum(np.abs(low), np.abs(high)))[:, None]) & (sizes[dim] > 0)[None, :]
        return [np.flatnonzero(r) for r in reached], floors

    visits = asked(filed, queries, route, shards)
    return ranked(searched_shards(dealt_out(filed, shards), visits, _searcher(k), _prepare, k, "long"), k)
