"""Sequence alignment, vectorised over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of a deletion, an insertion and a substitution.
DELETION, INSERTION, SUBSTITUTION = 3, 3, 4


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    if len(a) == 0 or len(b) == 0:
        return 0
    codes = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[t] for t in a]), np.array([codes[t] for t in b])
    row = np.zeros(len(y) + 1, np.int32)
    for token in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == token, row[:-1] + 1, 0)))
    return int(row[-1])


def lcs_tokens(x: list[str], y: list[str]) -> list[str]:
    """The longest common subsequence itself; of equal ones that which drops tokens of ``y`` first, from the end."""
    n, m = len(x), len(y)
    table = np.zeros((n + 1, m + 1), np.int32)
    codes = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
    a, b = np.array([codes[t] for t in x], np.int64), np.array([codes[t] for t in y], np.int64)
    for i in range(n):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(b == a[i], table[i, :-1] + 1, 0)))
    found = []
    while n and m:
        if x[n - 1] == y[m - 1]:
            found.append(x[n - 1])
            n, m = n - 1, m - 1
        elif table[n - 1, m] > table[n, m - 1]:
            n -= 1
        else:
            m -= 1
    return found[::-1]


def union_share(sentences: list[list[str]], reference: list[str]) -> float:
    """The different tokens of the reference's common subsequences with several sentences, as a share of their sum; 0 if there are none."""
    found = [set(lcs_tokens(reference, s)) for s in sentences]
    total = sum(map(len, found))
    return len(set().union(*found)) / total if total else 0.0


def alignment(reference: list[str], hypothesis: list[str]) -> list[tuple[str, str | None, str | None]]:
    """The cheapest alignment: (match, substitution, deletion or insertion; reference token; hypothesis token).

    Of alignments that cost the same a match or substitution is preferred,
    then an insertion.
    """
    codes = {t: k for k, t in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    x, y = np.array([codes[t] for t in reference], np.int64), np.array([codes[t] for t in hypothesis], np.int64)
    n, m = len(x), len(y)
    steps = np.arange(m + 1) * INSERTION

    def after(row: np.ndarray, i: int) -> np.ndarray:
        best = np.concatenate([[(i + 1) * DELETION], np.minimum(row[1:] + DELETION, row[:-1] + np.where(y == x[i], 0, SUBSTITUTION))])
        return np.minimum.accumulate(best - steps) + steps

    # of the table every so many rows are kept; those between are worked out again on the way back
    every, kept, row = max(1, math.isqrt(n)), [steps], steps
    for i in range(n):
        row = after(row, i)
        if (i + 1) % every == 0:
            kept.append(row)
    out, i, j, begin, cost = [], n, m, n + 1, []
    while i or j:
        if i and i - 1 < begin:
            begin = (i - 1) // every * every
            cost = [kept[begin // every]]
            for k in range(begin, i):
                cost.append(after(cost[-1], k))
        here, above = (cost[i - begin], cost[i - 1 - begin]) if i else (steps, None)
        if i and j and here[j] == above[j - 1] + (0 if x[i - 1] == y[j - 1] else SUBSTITUTION):
            i, j = i - 1, j - 1
            out.append(("match" if x[i] == y[j] else "substitution", reference[i], hypothesis[j]))
        elif j and here[j] == here[j - 1] + INSERTION:
            j -= 1
            out.append(("insertion", None, hypothesis[j]))
        else:
            i -= 1
            out.append(("deletion", reference[i], None))
    return out[::-1]


def edits(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Deletions, insertions and substitutions of the cheapest alignment."""
    kinds = [kind for kind, _, _ in alignment(reference, hypothesis)]
    return kinds.count("deletion"), kinds.count("insertion"), kinds.count("substitution")


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("deletions", "insertions", "substitutions")]))
def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edits(list(r), list(h)) for r, h in zip(reference, hypothesis)], columns=["deletions", "insertions", "substitutions"])


#: Steps that leave a task at a time, about.
STEPS = 16_384


def steps_of(rows: DataFrame, reference: str, hypothesis: str, keys: list[str], at_most: int = STEPS) -> DataFrame:
    """The keys, step, kind, reference and hypothesis of each step of the rows' alignments; tokens are arrays.

    Pairs are aligned one by one, and what is held are the steps of about ``at_most``, not those of a batch of pairs.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, found = [], [], []
            for i in range(batch.num_rows):
                made = alignment(batch.column("_ref")[i].as_py(), batch.column("_hyp")[i].as_py())
                for k in range(0, len(made), at_most):
                    some = made[k : k + at_most]
                    places += [i] * len(some)
                    numbers += range(k, k + len(some))
                    found += some
                    if len(found) >= at_most:
                        yield _steps(batch, keys, places, numbers, found)
                        places, numbers, found = [], [], []
            if found:
                yield _steps(batch, keys, places, numbers, found)

    return rows.select(*keys, F.col(reference).alias("_ref"), F.col(hypothesis).alias("_hyp")).mapInArrow(align, f"{kinds}, step int, kind string, reference string, hypothesis string")


def _steps(batch: pa.RecordBatch, keys: list[str], places: list[int], numbers: list[int], found: list[tuple]) -> pa.RecordBatch:
    of = batch.select(keys).take(pa.array(places, pa.int64()))
    return pa.RecordBatch.from_arrays([*of.columns, pa.array(numbers, pa.int32()), *(pa.array(c, pa.string()) for c in zip(*found))], names=[*keys, "step", "kind", "reference", "hypothesis"])


@F.pandas_udf(T.DoubleType())
def union_lcs(sentences: pd.Series, references: pd.Series) -> pd.Series:
    """The sum of the union shares of the reference's sentences; both sides are arrays of sentences, words parted by spaces."""
    words = lambda side: [s.split(" ") for s in side]
    return pd.Series([float(sum(union_share(words(h), r) for r in words(refs))) for h, refs in zip(sentences, references)])
