"""Bounded samples by hash, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def hash_sample(rows: DataFrame, key: str, at_most: int, total: int | None = None) -> DataFrame:
    """At most ``at_most`` of ``rows``, those of the least hashes of ``key``.

    A threshold on the hash leaves few more rows than wanted before they are
    put in order, so that what reaches one task does not grow with the table.
    A table of ``at_most`` rows or fewer is its own sample.
    """
    total = rows.count() if total is None else total
    if total <= at_most:
        return rows
    place = F.pmod(F.xxhash64(key), F.lit(_RANGE))
    # eight deviations of the binomial above the wanted count
    share = min(1.0, (at_most + 8 * at_most**0.5 + 8) / total)
    return rows.where(place < int(share * _RANGE)).orderBy(place, F.col(key)).limit(at_most)
