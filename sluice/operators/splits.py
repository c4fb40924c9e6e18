"""Group-disjoint splits, shards and the layout of a delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.hashing import digest, hex_modulo, weighted_bucket
from sluice.operators.registry import query, table
from sluice.plans.ordinal import with_ordinal

WEIGHTS = {"train": 8, "validation": 1, "test": 1}
NAMESPACE, PROTOCOL, SEED = "orders", "hash-split-v1", "17"
ROWS_PER_PART, PARTS_PER_CHUNK = 1024, 64

_FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({h}, ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, c: (a * 16 + c) % {m})"
_GROUP = "sha256('orders' || chr(0) || 'o_custkey' || chr(0) || o_custkey::VARCHAR)"
_ASSIGNED = f"""
WITH g AS (SELECT o_orderkey, {_GROUP} AS group_id FROM orders),
p AS (SELECT o_orderkey, group_id, sha256('hash-split-v1' || chr(0) || '17' || chr(0) || group_id) AS h FROM g),
a AS (SELECT o_orderkey, group_id, {_FOLD.format(h="h", m=10)} AS place FROM p),
s AS (SELECT o_orderkey, group_id, CASE WHEN place < 8 THEN 'train' WHEN place < 9 THEN 'validation' ELSE 'test' END AS split FROM a)
"""


def assigned(rows: DataFrame, key: str, weights: dict[str, int] = WEIGHTS, namespace: str = NAMESPACE, seed: str = SEED) -> DataFrame:
    """``rows`` with group_id and split: all rows of a key fall in one split."""
    grouped = rows.withColumn("group_id", digest(namespace, key, F.col(key)))
    return grouped.withColumn("split", weighted_bucket(digest(PROTOCOL, seed, F.col("group_id")), weights))


@query(f"{_ASSIGNED} SELECT o_orderkey, group_id, split FROM s")
def split_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "group_id", "split")


@query(f"""{_ASSIGNED}, k AS (SELECT unnest(['train', 'validation', 'test']) AS split)
SELECT k.split, count(o_orderkey) AS samples, count(DISTINCT group_id) AS groups, count(DISTINCT group_id) >= 1 AS enough FROM k LEFT JOIN s USING (split) GROUP BY k.split""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and groups by split, with a row for a split that got none."""
    rows = assigned(table(spark, sf_dir, "orders"), "o_custkey")
    by_group = rows.groupBy("split", "group_id").agg(F.count("*").alias("n"))
    counts = by_group.groupBy("split").agg(F.sum("n").alias("samples"), F.count("*").alias("groups"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, WEIGHTS))).alias("split"))
    # null-safe, so that no filter on the split is pushed below the digests, where nothing is shared
    met = names.alias("n").join(counts.alias("c"), F.col("n.split").eqNullSafe(F.col("c.split")), "left")
    return met.select("n.split", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.coalesce("groups", F.lit(0)) >= 1).alias("enough"))


@query("""
WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM orders),
g AS (SELECT o_custkey, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY o_custkey)
SELECT o_custkey, splits, n AS samples FROM g WHERE splits > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a split by row tears apart."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("test").alias("split"))
    counts = rows.groupBy("o_custkey", "split").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.count("*").alias("splits"), F.sum("n").alias("samples"))
    return counts.where("splits > 1")


@query(f"""
WITH m AS (SELECT {_FOLD.format(h="md5(c_name)", m=100)} AS place FROM customer)
SELECT CASE WHEN place < 80 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM m GROUP BY 1""")
def md5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio split by the name's MD5 modulo 100."""
    place = hex_modulo(F.md5(F.col("c_name").cast("binary")), 100, 32)
    return table(spark, sf_dir, "customer").groupBy(F.when(place < 80, "train").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS id FROM customer)
SELECT CASE WHEN id BETWEEN 0 AND 99 THEN '0-99' WHEN id BETWEEN 100 AND 199 THEN '100-199' ELSE 'other' END AS range, count(*) AS n FROM n WHERE id IS NOT NULL GROUP BY 1""")
def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the range of the number in their name; names without one are skipped."""
    number = F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("long")
    rows = table(spark, sf_dir, "customer").select(number.alias("id")).where("id is not null")
    return rows.groupBy(F.when(F.col("id").between(0, 99), "0-99").when(F.col("id").between(100, 199), "100-199").otherwise("other").alias("range")).agg(F.count("*").alias("n"))


@query("SELECT (l_orderkey % 7)::INT AS worker, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def modulo_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(7)).cast("int").alias("worker")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, (pos % 4)::INT AS rank, (pos // 4)::BIGINT AS step FROM r""")
def rank_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's rank and step when ranks take turns, none padded or repeated."""
    rows = with_ordinal(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return rows.select("doc_id", (F.col("ordinal") % 4).cast("int").alias("rank"), F.floor(F.col("ordinal") / 4).alias("step"))


@query(f"""{_ASSIGNED}, r AS (SELECT o_orderkey, split, row_number() OVER (PARTITION BY split ORDER BY lpad(o_orderkey::VARCHAR, 12, '0')) - 1 AS pos FROM s),
l AS (SELECT split, o_orderkey, (pos // 1024)::INT AS part, (pos // 65536)::INT AS chunk FROM r)
SELECT split, chunk, part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, sha256(string_agg(o_orderkey::VARCHAR || chr(10), '' ORDER BY lpad(o_orderkey::VARCHAR, 12, '0'))) AS ids_sha256 FROM l GROUP BY split, chunk, part""")
def delivery_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of at most 1,024 rows, in chunks of 64 parts, with each part's id digest."""
    rows = assigned(table(spark, sf_dir, "orders"), "o_custkey").select("split", "o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sort_key"))
    placed = with_ordinal(rows, ["sort_key"], ["split"])
    laid = placed.select("split", "o_orderkey", "sort_key", F.floor(F.col("ordinal") / ROWS_PER_PART).cast("int").alias("part"), F.floor(F.col("ordinal") / (ROWS_PER_PART * PARTS_PER_CHUNK)).cast("int").alias("chunk"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "o_orderkey"))), lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("\n")))
    return laid.groupBy("split", "chunk", "part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.sha2(F.array_join(ids, ""), 256).alias("ids_sha256"))
