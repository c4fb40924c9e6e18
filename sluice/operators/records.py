"""Records: derived fields, shards and their merge, ledgers, status reports."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.hashing import digest
from sluice.functions.text import code_points, collapsed
from sluice.operators.registry import query, table
from sluice.plans.ordinal import with_ordinal


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@query("SELECT item_id, sha256(nfc_normalize(trim(regexp_replace(text || ' e' || chr(769), '\\s+', ' ', 'g')))) AS digest, length(nfc_normalize(trim(regexp_replace(text || ' e' || chr(769), '\\s+', ' ', 'g'))))::INT AS characters FROM benchmark")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in normal form C with white space collapsed."""
    decomposed = F.concat("text", F.lit(" é"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", nfc(collapsed(decomposed)).alias("t"))
    return rows.select("item_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("characters"))


@query("""
WITH p AS (SELECT o_orderkey AS id, 'primary/' || o_orderkey AS path, o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0), r AS (SELECT o_orderkey AS id, 'replacement/' || o_orderkey AS path FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(r.id, p.id) AS id, coalesce(r.path, p.path) AS path, CASE WHEN r.id IS NOT NULL AND p.id IS NOT NULL THEN 'replaced' WHEN r.id IS NOT NULL THEN 'replacement only' ELSE 'primary' END AS kind FROM p FULL JOIN r USING (id)""")
def archive_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives by id; a replacement wins over the primary."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    path = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("id").cast("string"))
    p, r = ids.where("id % 6 <> 0").withColumn("p", path("primary")), ids.where("id % 5 = 0").withColumn("r", path("replacement"))
    kind = F.when(F.col("r").isNotNull() & F.col("p").isNotNull(), "replaced").when(F.col("r").isNotNull(), "replacement only").otherwise("primary")
    return p.join(r, "id", "full_outer").select("id", F.coalesce("r", "p").alias("path"), kind.alias("kind"))


@query("""SELECT page_id, replace(url_encode(regexp_extract(url, '://(.*)$', 1)), '%2F', '/') AS quoted, regexp_extract(url, '^([^#]*)', 1) AS location, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-quoted members, and the fragment that names an array in a file."""
    member = F.regexp_extract("url", "://(.*)$", 1)
    quoted = F.replace(F.replace(F.url_encode(member), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return table(spark, sf_dir, "pages").select("page_id", quoted.alias("quoted"), F.regexp_extract("url", "^([^#]*)", 1).alias("location"), F.nullif(F.regexp_extract("url", "#(.*)$", 1), F.lit("")).alias("fragment"))


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'S' || c_custkey % 9 || '_P' || c_custkey % 30 || '_T' || c_custkey END AS name FROM customer)
SELECT c_custkey, nullif(regexp_extract(name, '^S[0-9]+_(P[0-9]+)_T[0-9]+$', 1), '') AS subject, try_cast(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS number FROM s""")
def subject_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects from names of the stated form; others have none."""
    key = F.col("c_custkey")
    made = F.concat(F.lit("S"), key % 9, F.lit("_P"), key % 30, F.lit("_T"), key)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 4 == 0, F.col("c_name")).otherwise(made).alias("name"))
    return rows.select("c_custkey", F.nullif(F.regexp_extract("name", r"^S\d+_(P\d+)_T\d+$", 1), F.lit("")).alias("subject"), F.regexp_extract("name", r"(\d+)$", 1).try_cast("long").alias("number"))


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders)
SELECT o_orderkey, epoch(try_cast(t AS TIMESTAMP))::BIGINT AS seconds, t IS NOT NULL AND try_cast(t AS TIMESTAMP) IS NULL AS malformed FROM s""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from text; what cannot be read is null and counted, not raised."""
    key = F.col("o_orderkey")
    text = F.when(key % 9 == 0, "soon").when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).withColumn("at", F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss")))
    return rows.select("o_orderkey", F.unix_seconds("at").alias("seconds"), (F.col("t").isNotNull() & F.col("at").isNull()).alias("malformed"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KiB', n * 10 // 1024 / 10) ELSE printf('%.1f MiB', n * 10 // 1048576 / 10) END AS size FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)""")
def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for people to read, cut (not rounded) to a tenth."""
    n = F.col("n_chars") * 37
    size = F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KiB", F.floor(n * 10 / 1024) / 10)).otherwise(F.format_string("%.1f MiB", F.floor(n * 10 / (1 << 20)) / 10))
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"))


@query("""SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g') || '__' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '__' || sha256(o_orderkey::VARCHAR)[1:8] AS run_id FROM orders""")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A safe name, a compact time and the first digits of a configuration's digest."""
    name = F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("__", name, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'"), F.substring(digest(F.col("o_orderkey")), 1, 8)).alias("run_id"))


@query("""
WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"gloss": "' || lang || '"}' WHEN doc_id % 3 = 1 THEN '"' || lang || '"' END AS gloss FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN json_extract_string(gloss, '$.gloss') WHEN doc_id % 3 = 1 THEN json_extract_string(gloss, '$') END AS gloss, array_to_string(string_split(text, ''), '') AS caption FROM g JOIN documents USING (doc_id)""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are a string or an object with a gloss, and captions of joined characters."""
    doc, lang = F.col("doc_id"), F.col("lang")
    made = F.when(doc % 3 == 0, F.to_json(F.struct(lang.alias("gloss")))).when(doc % 3 == 1, F.concat(F.lit('"'), lang, F.lit('"')))
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("json"), code_points(F.col("text")).alias("characters"))
    gloss = F.coalesce(F.get_json_object("json", "$.gloss"), F.get_json_object(F.concat(F.lit('{"s":'), F.col("json"), F.lit("}")), "$.s"))
    return rows.select("doc_id", gloss.alias("gloss"), F.array_join("characters", "").alias("caption"))


@query("""
WITH m AS (SELECT doc_id, MAP {'source': source, 'lang': lang} AS keys FROM documents) SELECT keys['source'] AS key, count(*) AS n, count(DISTINCT keys['lang']) AS langs FROM m GROUP BY 1""")
def selected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted selector into a map of group keys."""
    rows = table(spark, sf_dir, "documents").select(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("group_keys"))
    by = rows.groupBy(F.col("group_keys.source").alias("key"), F.col("group_keys.lang").alias("lang")).agg(F.count("*").alias("n"))
    return by.groupBy("key").agg(F.sum("n").alias("n"), F.count("lang").alias("langs"))


@query("""
WITH s AS (SELECT event_id % 4 AS rank, event_id, value FROM events UNION ALL SELECT 3, event_id, value FROM events WHERE event_id % 100 = 0),
k AS (SELECT event_id, any_value(value) AS value, count(*) AS n FROM s GROUP BY event_id)
SELECT event_id, round(value, 6) AS value, n > 1 AS repeated, (row_number() OVER (ORDER BY lpad(event_id::VARCHAR, 12, '0')) - 1)::BIGINT AS place FROM k""")
def merged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-local shards merged in the order of their keys; keys of several shards show."""
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("rank"), "event_id", "value")
    shards = events.unionByName(events.where("event_id % 100 = 0").withColumn("rank", F.lit(3).cast("long")))
    merged = shards.groupBy("event_id").agg(F.max("value").alias("value"), (F.count("*") > 1).alias("repeated"), F.lpad(F.first("event_id").cast("string"), 12, "0").alias("sort_key"))
    return with_ordinal(merged, ["sort_key"], name="place").select("event_id", F.round("value", 6).alias("value"), "repeated", "place")


@query("""
WITH s AS (SELECT event_id % 4 AS rank, event_id FROM events) SELECT rank, count(*) AS rows, min(event_id) AS first, max(event_id) AS last, sum(event_id)::BIGINT AS check_sum FROM s GROUP BY rank""")
def shard_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard says it holds."""
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 4).alias("rank")).agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.sum("event_id").alias("check_sum"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS v FROM lineitem) SELECT CASE WHEN v IS NULL THEN 'failed' ELSE 'done' END AS status, count(*) AS n, round(avg(v), 2) AS mean FROM r GROUP BY 1""")
def outcome_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each outcome: what fails is recorded and does not end the run."""
    v = F.try_divide("l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(v.isNull(), "failed").otherwise("done").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(v), 2).alias("mean"))


@query("""
WITH e AS (SELECT user_id, list(value ORDER BY ts, event_id) AS s FROM events GROUP BY user_id), x AS (SELECT user_id, s, len(s) AS n, (('0x' || md5(user_id::VARCHAR)[1:8])::BIGINT % greatest(len(s) - 39, 1))::BIGINT AS a FROM e)
SELECT user_id, a AS start, least(n, 40)::BIGINT AS kept, greatest(40 - n, 0)::BIGINT AS padded, round(list_sum(s[a + 1:a + 40]), 6) AS total FROM x""")
def cut_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences cut to forty frames at a place by seeded hash, or padded to them."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(order) - 1)
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    place = F.pmod(F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.greatest(F.col("n") - 39, F.lit(1)))
    cut = rows.join(sizes.withColumn("start", place), "user_id").where("i >= start and i < start + 40")
    return cut.groupBy("user_id", "n", "start").agg(F.round(F.sum("value"), 6).alias("total")).select("user_id", "start", F.least("n", F.lit(40)).alias("kept"), F.greatest(40 - F.col("n"), F.lit(0)).alias("padded"), "total")


@query("""
WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS bad, max(value) AS high, min(value) AS low FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter([CASE WHEN n < 60 THEN 'short' END, CASE WHEN bad > 0 THEN 'not finite' END, CASE WHEN high > 150 THEN 'high' END, CASE WHEN low < 0.5 THEN 'low' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM e""")
def sequence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a sequence is skipped: all reasons that hold."""
    from sluice.operators.gates import failure_codes

    bad = F.count_if(F.col("value").isNull() | F.isnan("value"))
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), bad.alias("bad"), F.max("value").alias("high"), F.min("value").alias("low"))
    checks = {"short": F.col("n") >= 60, "not finite": F.col("bad") == 0, "high": F.col("high") <= 150, "low": F.col("low") >= 0.5}
    return by.select("user_id", F.array_join(failure_codes(checks), ",").alias("reasons"))


@query("""
SELECT c_mktsegment, count(DISTINCT o_orderkey) AS archives, sum(l_quantity)::BIGINT AS members, round(count(DISTINCT o_orderkey) / (SELECT count(*) FROM orders), 6) AS coverage FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment""")
def archive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and members by owner, and the share of all archives: lines are summed before they meet."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("members"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    by = lines.join(orders, "o_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("archives"), F.sum("members").cast("long").alias("members"))
    return by.crossJoin(F.broadcast(orders.agg(F.count("*").alias("all")))).select("c_mktsegment", "archives", "members", F.round(F.col("archives") / F.col("all"), 6).alias("coverage"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem WHERE l_quantity > 49) SELECT l_returnflag, l_orderkey, l_linenumber FROM v WHERE i <= 5""")
def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each kind of violation."""
    first = W.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").withColumn("i", F.row_number().over(first)).where("i <= 5").select("l_returnflag", "l_orderkey", "l_linenumber")


@query("""
SELECT count(*) AS n, round(max(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 4) AS largest, count(*) FILTER (l_discount <> 0) AS mismatches, round(sum(l_extendedprice) / sum(l_extendedprice * (1 - l_discount)), 6) AS factor FROM lineitem""")
def benchmark_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest difference of two ways, how many rows differ, and the ratio of their sums."""
    price, cut = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.round(F.max(F.abs(cut - price)), 4).alias("largest"), F.count_if(F.col("l_discount") != 0).alias("mismatches"), F.round(F.sum(price) / F.sum(cut), 6).alias("factor"))


@query("""
SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') AS waiting, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS finished, bool_or(o_orderstatus = 'P') AS active, (count(*) FILTER (o_orderstatus = 'O') = 0) AS drained FROM orders GROUP BY 1""")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduler's queues: waiting, running, finished."""
    is_in = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("queue")).agg(is_in("O").alias("waiting"), is_in("P").alias("running"), is_in("F").alias("finished"), F.bool_or(F.col("o_orderstatus") == "P").alias("active"), (is_in("O") == 0).alias("drained"))


@query("SELECT vec_id, embedding[1:6]::DOUBLE[] || embedding[23:64]::DOUBLE[] AS view, round(list_sum([x::DOUBLE FOR x IN embedding[1:32]]), 6) AS first_half, round(list_sum([x::DOUBLE FOR x IN embedding[33:64]]), 6) AS second_half FROM embeddings")
def array_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view put together from slices, and sums along an axis."""
    v = F.col("embedding").cast("array<double>")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.slice(v, 1, 6), F.slice(v, 23, 42)).alias("view"), total(F.slice(v, 1, 32)).alias("first_half"), total(F.slice(v, 33, 32)).alias("second_half"))
