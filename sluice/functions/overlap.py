"""How many n-grams two token lists share, counted within the row, over Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = "array<struct<n: int, hyp_grams: bigint, ref_grams: bigint, matched: bigint>>"


def grams(tokens: Sequence, n: int) -> Counter:
    """The runs of ``n`` tokens (or, of a text, characters) and how often each comes."""
    if isinstance(tokens, str):
        return Counter(tokens[i : i + n] for i in range(len(tokens) - n + 1))
    return Counter(zip(*(tokens[i:] for i in range(n))))


def shared(hyp: Sequence, ref: Sequence, order: int) -> list[tuple[int, int, int, int]]:
    """n, n-grams of each side and those matched (clipped), for each n up to ``order``."""
    out = []
    for n in range(1, order + 1):
        a, b = grams(hyp, n), grams(ref, n)
        small, large = (a, b) if len(a) < len(b) else (b, a)
        out.append((n, max(len(hyp) - n + 1, 0), max(len(ref) - n + 1, 0), sum(min(k, large[g]) for g, k in small.items() if g in large)))
    return out


def overlap(hyp: Column, ref: Column, order: int) -> Column:
    """The counts of two columns of texts (by character) or of token arrays; null sides count as empty."""

    @F.pandas_udf(COUNTS)
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        plain = lambda t: t if isinstance(t, str) else [] if t is None else list(t)
        return pd.Series([[dict(zip(("n", "hyp_grams", "ref_grams", "matched"), row)) for row in shared(plain(x), plain(y), order)] for x, y in zip(a, b)])

    return count(hyp, ref)
