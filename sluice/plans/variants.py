"""Sources that change: each content of a key is an immutable variant, and one of them is current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolved(arrivals: DataFrame, key: str, sha: str, at: str) -> DataFrame:
    """key, sha, artifact, variant, arrivals and state of each content of a key.

    The content that came first has the key's own name; others are named after
    their digest, so nothing is ever overwritten. The content that came last is
    current, the others are quarantined. A content that comes again is the same
    variant.
    """
    seen = arrivals.groupBy(key, sha).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count("*").alias("arrivals"))
    of_key = W.partitionBy(key)
    canonical = F.row_number().over(of_key.orderBy("_first", sha)) == 1
    current = F.row_number().over(of_key.orderBy(F.desc("_last"), sha)) == 1
    name, mark = F.col(key).cast("string"), F.concat(F.lit("source_"), F.col(sha))
    return seen.select(
        key, sha, F.when(canonical, name).otherwise(F.concat(name, F.lit("--"), mark)).alias("artifact"), F.when(canonical, "canonical").otherwise(mark).alias("variant"),
        "arrivals", F.when(current, "current").otherwise("quarantined").alias("state"),
    )
