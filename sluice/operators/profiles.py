"""Profiles of text collections: lengths, characters, coverage, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.functions.hashing import crc_hex, length_prefixed, stable_id
from sluice.operators.registry import query, table

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("""
SELECT lang, count(*) AS n, count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS distinct_texts, count(*) - count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS repeats,
count(*) FILTER (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = 0) AS blank FROM documents GROUP BY lang""")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, different normalised texts and blank ones by language, counted by digest."""
    rows = table(spark, sf_dir, "documents").select("lang", T.collapsed(F.col("text")).alias("text"))
    by_text = rows.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.sum((F.length("text") == 0).cast("int")).alias("blank"))
    return by_text.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_texts"), (F.sum("n") - F.count("*")).alias("repeats"), F.sum("blank").alias("blank"))


@query("""
SELECT source, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, round(avg(n_chars), 6) AS mean,
round(quantile_cont(n_chars, 0.01), 6) AS p01, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50,
round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY source""")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles by source, weighted: from a histogram of lengths, never all rows of a source."""
    lengths = table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    marks = F.percentile("n_chars", F.array(*[F.lit(q) for q in QUANTILES]), F.col("n"))
    out = lengths.groupBy("source").agg(F.min("n_chars").cast("double").alias("low"), F.max("n_chars").cast("double").alias("high"), F.round(F.sum(F.col("n_chars") * F.col("n")) / F.sum("n"), 6).alias("mean"), marks.alias("marks"))
    return out.select("source", "low", "high", "mean", *[F.round(F.get("marks", F.lit(i)), 6).alias(f"p{round(q * 100):02d}") for i, q in enumerate(QUANTILES)])


@query("""
SELECT lang, sum(length(text))::BIGINT AS characters, sum(len(regexp_extract_all(text, '\\pL')))::BIGINT AS letters, sum(len(regexp_extract_all(text, '\\pN')))::BIGINT AS numbers,
sum(len(regexp_extract_all(text, '\\pP')))::BIGINT AS punctuation, sum(len(regexp_extract_all(text, '[\\pP\\pZ\\pC]')))::BIGINT AS not_lexical,
sum(len(regexp_extract_all(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}\\x{30000}-\\x{323AF}]')))::BIGINT AS han FROM documents GROUP BY lang""")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by class and language, counted in the row, not exploded."""
    count = lambda pattern, name: F.sum(F.regexp_count("text", F.lit(pattern)).cast("long")).alias(name)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("characters"), count(r"\p{L}", "letters"), count(r"\p{N}", "numbers"), count(r"\p{P}", "punctuation"), count(T.NOT_LEXICAL, "not_lexical"), count(T.HAN, "han"))


@query("""
WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT c, count(*) AS n FROM c WHERE c <> '' GROUP BY c)
SELECT c AS character, printf('U+%04X', unicode(c)) AS label, n FROM n ORDER BY n DESC, c LIMIT 50""")
def top_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent characters, ties to the smaller."""
    counts = table(spark, sf_dir, "documents").select(F.explode(T.code_points(F.col("text"))).alias("character")).groupBy("character").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "character").limit(50).select("character", T.code_point_label(F.col("character")).alias("label"), "n")


@query("""
WITH c AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents)
SELECT lang, count(DISTINCT c) FILTER (NOT regexp_matches(c, '\\s')) AS not_space, count(DISTINCT c) FILTER (NOT regexp_matches(c, '[\\pP\\pZ\\pC]')) AS lexical FROM c WHERE c <> '' GROUP BY lang""")
def vocabulary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different characters by class and language; each task counts each once."""
    seen = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(T.code_points(F.col("text")))).alias("c")).distinct()
    return seen.groupBy("lang").agg(F.count_if(~F.col("c").rlike(T.SPACES)).alias("not_space"), F.count_if(~F.col("c").rlike(T.NOT_LEXICAL)).alias("lexical"))


@query("""
SELECT page_id, regexp_extract(replace(url, chr(92), '/'), '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem,
lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '.(\\.[^.]*)$', 1)) AS suffix, regexp_matches(url, '^/') OR regexp_matches(url, '(^|/)\\.\\.(/|$)') OR length(url) = 0 AS unsafe FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.basename(url).alias("base"), T.stem(url).alias("stem"), T.suffix(url).alias("suffix"), T.is_unsafe_path(url).alias("unsafe"))


@query("""
SELECT CASE WHEN contains(url, 'example.com') THEN 'com' WHEN contains(url, 'example.net') THEN 'net' ELSE 'unknown' END AS program, count(*) AS n, round(count(*) / (SELECT count(*) FROM pages), 6) AS share FROM pages GROUP BY 1""")
def program_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first of the stated parts that their path has."""
    pages = table(spark, sf_dir, "pages")
    program = F.when(F.contains("url", F.lit("example.com")), "com").when(F.contains("url", F.lit("example.net")), "net").otherwise("unknown")
    counts = pages.groupBy(program.alias("program")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("program", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) FILTER (n > 1) AS duplicate_keys, sum(n - 1)::BIGINT AS extra_rows FROM k GROUP BY l_returnflag")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat, and the rows beyond each key's first."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return counts.groupBy("l_returnflag").agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum(F.col("n") - 1).alias("extra_rows"))


@query("""
SELECT 'documents' AS source, count(*) AS n, count(*) FILTER (length(trim(text)) > 0) AS with_text, count(*) FILTER (length(trim(lang)) > 0) AS with_lang, bool_or(lang = 'de') AS any_german, bool_and(n_chars >= 0) AS all_sized FROM documents
UNION ALL SELECT 'conversations', count(*), count(*) FILTER (length(trim(text)) > 0), count(*) FILTER (length(trim(role)) > 0), bool_or(role = 'de'), bool_and(turn >= 0) FROM conversations""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = lambda c: F.count_if(F.length(F.trim(c)) > 0)
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    a = d.agg(F.lit("documents").alias("source"), F.count("*").alias("n"), filled("text").alias("with_text"), filled("lang").alias("with_lang"), F.bool_or(F.col("lang") == "de").alias("any_german"), F.bool_and(F.col("n_chars") >= 0).alias("all_sized"))
    b = c.agg(F.lit("conversations").alias("source"), F.count("*").alias("n"), filled("text").alias("with_text"), filled("role").alias("with_lang"), F.bool_or(F.col("role") == "de").alias("any_german"), F.bool_and(F.col("turn") >= 0).alias("all_sized"))
    return a.unionByName(b)


@query("SELECT page_id, sha256('web' || chr(0) || url || chr(0) || page_id::VARCHAR)[1:24] AS sample_id, length(html)::INT AS html_chars FROM pages")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", stable_id("web", F.col("url"), F.col("page_id")).alias("sample_id"), F.length("html").alias("html_chars"))


@query()
def member_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 and length-prefixed SHA-256 of every benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", crc_hex(F.col("text")).alias("crc32"), F.sha2(length_prefixed(F.col("text")), 256).alias("sha256"))
