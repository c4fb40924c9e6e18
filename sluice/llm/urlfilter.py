"""URL filtering by host-suffix and path-prefix expressions.

A rule names a host and the start of a path. Each URL is expanded into the
expressions that a rule could be filed under (every suffix of its host at a
dot, every prefix of its path that ends in a slash). Expressions and rules
meet in an equi-join on the first bytes of their SHA-256; the full digests and
the rule's path then confirm, and the longest rule decides.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; of rules with the same host and path a block wins; repeated
rows are judged each; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: verdict, host, start of the path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT_VERDICT = "allow"
#: Hexadecimal digits of the digest that the join goes by.
SHORT = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules as a table: verdict, host, path."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    found = F.locate("://", url)
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def indexed_rules(rules: DataFrame) -> DataFrame:
    """Each rule under its expression: host and path up to the last slash."""
    host, path = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    filed = F.concat(host, F.regexp_extract(path, r"^((?:[^/]*/)*)", 1))
    return rules.select(
        F.col("verdict").alias("rule_verdict"), F.concat(host, path).alias("rule_text"), path.alias("rule_path"), F.sha2(filed, 256).alias("rule_digest"),
        F.size(F.split(host, r"\.")).alias("labels"), (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("slashes"),
    ).withColumn("short", F.substring("rule_digest", 1, SHORT))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    No rule is deeper than the deepest in the list, so expressions stop there.
    The join is left to Spark: a short list is broadcast by its size, a long
    one shuffles. One row per URL leaves each task for the final aggregate.
    """
    filed = indexed_rules(rules)
    deepest = filed.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes")).first()
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    dots = F.split("host", r"\.")
    cuts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(dots), F.lit(max(deepest["labels"], 1)))), lambda k: F.array_join(F.slice(dots, -k, k), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(cuts) - 1, F.lit(deepest["slashes"]))), lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(cuts, F.lit(1), k), "/"), F.lit("/"))).otherwise(F.lit("")))
    pairs = F.when(F.length("host") > 0, F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    spread = rows.select("*", F.explode_outer(pairs).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    met = spread.join(filed, "short", "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    best = F.max(F.when(fits, F.struct(F.length("rule_text").alias("length"), "rule_text", (F.col("rule_verdict") == "block").alias("blocks"), "rule_verdict")))
    found = met.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return found.select("page_id", "host", "path", F.col("best.rule_text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
