"""Globs as a table: many rules against many texts, met by the words that a rule needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.plans.lineage import durable

#: What words are made of; a glob's longest run of them that ends on both sides is what a text must hold.
_WORD = "[A-Za-z0-9]+"


def pattern(glob: Column) -> Column:
    """A glob (``*``, ``?``) as a regular expression for whole texts."""
    quoted = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def anchor(glob: Column) -> Column:
    """What a text must hold to fit the glob: its longest word, ``=word``, or what a word begins (``<word``) or ends
    with (``>word``) where a wildcard follows or precedes; of equal length the whole word. Empty if there is none."""
    runs = lambda kind, before, after: F.transform(F.regexp_extract_all(glob, F.lit(rf"(?<!{before}){_WORD}(?!{after})"), F.lit(0)), lambda w: F.struct((-F.length(w)).alias("n"), F.lit(kind).alias("kind"), w.alias("w")))
    whole, begins, ends = runs("=", "[A-Za-z0-9*?]", "[A-Za-z0-9*?]"), runs("<", "[A-Za-z0-9*?]", "[A-Za-z0-9]"), runs(">", "[A-Za-z0-9]", "[A-Za-z0-9*?]")
    ranked = F.array_sort(F.transform(F.concat(whole, begins, ends), lambda s: F.struct(s["n"].alias("n"), (s["kind"] != "=").alias("part"), s["kind"].alias("kind"), s["w"].alias("w"))))
    return F.coalesce(F.get(F.transform(ranked, lambda s: F.concat(s["kind"], s["w"])), F.lit(0)), F.lit(""))


def fitting(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """``texts`` with each rule (rule_id, glob and further columns) that fits: a row for each fit.

    A text's words, and their beginnings and ends as long as rules have some, each
    once, meet the rules filed under them; rules without any word meet every text.
    Then the whole glob is confirmed. Case counts.
    """
    filed = durable(rules.select("*", anchor(F.col("glob")).alias("_word"), pattern(F.col("glob")).alias("_pattern")))
    held = durable(texts.withColumn("_row", F.monotonically_increasing_id()))
    # one row: the different lengths of the beginnings and ends that rules are filed under
    lengths = filed.agg(*[F.collect_set(F.when(F.startswith("_word", F.lit(kind)), F.length("_word") - 1)).alias(name) for kind, name in (("<", "_begins"), (">", "_ends"))])
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0)))
    cut = lambda kind, sizes, side: F.flatten(F.transform(found, lambda w: F.transform(F.filter(sizes, lambda n: n <= F.length(w)), lambda n: F.concat(F.lit(kind), side(w, n)))))
    pieces = F.concat(F.transform(found, lambda w: F.concat(F.lit("="), w)), cut("<", "_begins", lambda w, n: F.left(w, n)), cut(">", "_ends", lambda w, n: F.right(w, n)))
    words = held.crossJoin(F.broadcast(lengths)).select("_row", F.col(text).alias("_text"), F.explode(F.array_distinct(pieces)).alias("_word"))
    met = words.join(filed.where("_word <> ''"), "_word")
    wide = held.select("_row", F.col(text).alias("_text")).join(filed.where("_word = ''"), F.lit(True))
    columns = ["_row", *rules.columns]
    found = met.where(F.expr("_text rlike _pattern")).select(*columns).unionByName(wide.where(F.expr("_text rlike _pattern")).select(*columns))
    return held.join(found, "_row").drop("_row")


def decided(texts: DataFrame, key: str, text: str, rules: DataFrame, verdict: str, otherwise: str) -> DataFrame:
    """key and verdict: of the rules that fit, the last (greatest rule_id) decides."""
    last = fitting(texts.select(key, text), text, rules).groupBy(key).agg(F.max_by(verdict, "rule_id").alias(verdict))
    return texts.select(key).join(last, key, "left").select(key, F.coalesce(verdict, F.lit(otherwise)).alias(verdict))

