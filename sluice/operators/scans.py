"""Queries over strict scans and over deliveries, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.registry import query, table
from sluice.operators.splits import assigned
from sluice.plans import delivery
from sluice.plans.lineage import durable, scratch
from sluice.sources import manifests


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as lines of a manifest, some of them wrong in stated ways."""
    docs = table(spark, sf_dir, "documents")
    sample = F.concat(F.lit("doc-"), (F.col("doc_id") - (F.col("doc_id") % 40 == 39).cast("int")).cast("string"))
    uri = F.when(F.col("doc_id") % 23 == 0, F.lit("../up.npy")).otherwise(F.concat(F.lit("arrays/"), F.col("doc_id").cast("string"), F.lit(".npy")))
    record = F.struct(
        F.when(F.col("doc_id") % 31 == 0, "sample.v0").otherwise(manifests.SAMPLE_VERSION).alias("schema_version"),
        sample.alias("sample_id"), F.col("lang").alias("dataset"),
        F.struct(F.struct(uri.alias("uri"), F.array(F.lit(2), F.when(F.col("doc_id") % 29 == 0, -1).otherwise(3)).alias("shape")).alias("pose")).alias("modalities"),
        F.when(F.col("doc_id") % 50 == 0, F.lit(1)).alias("extra"),
    )
    return docs.select(F.to_json(record).alias("line"))


@query("""
WITH p AS (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 31 = 0 THEN 'version' END, CASE WHEN doc_id % 23 = 0 THEN 'unsafe location' END, CASE WHEN doc_id % 29 = 0 THEN 'negative shape' END, CASE WHEN doc_id % 50 = 0 THEN 'unknown key' END], lambda x: x IS NOT NULL)) AS problem FROM documents)
SELECT problem, count(*) AS n FROM p GROUP BY problem UNION ALL SELECT 'repeated id', count(*) FILTER (n > 1) FROM (SELECT doc_id - (doc_id % 40 = 39)::INT AS id, count(*) AS n FROM documents GROUP BY 1)""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a manifest's records, by kind, and repeated ids."""
    records = manifests.sample_records(manifest_lines(spark, sf_dir))
    by_kind = records.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    repeats = manifests.repeated(records.select(F.col("record.sample_id").alias("id")), "id").agg(F.lit("repeated id").alias("problem"), F.count("*").alias("n"))
    return by_kind.unionByName(repeats)


@query("""
SELECT lang AS dataset, count(*) AS n, 'pose' AS modalities, sum(CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 6 * 4 END)::BIGINT AS bytes FROM documents GROUP BY lang""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, modalities and the size that their shapes make, by dataset."""
    records = manifests.sample_records(manifest_lines(spark, sf_dir)).select("record.*")
    shapes = F.transform(F.map_values("modalities"), lambda m: F.when(F.exists(m["shape"], lambda n: n < 0), F.lit(0).cast("long")).otherwise(F.aggregate(m["shape"], F.lit(4).cast("long"), lambda a, n: a * n)))
    size = F.aggregate(shapes, F.lit(0).cast("long"), lambda a, n: a + n)
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("modalities"))))), ",")
    return records.groupBy("dataset").agg(F.count("*").alias("n"), names.alias("modalities"), F.sum(size).alias("bytes"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'prov-' || doc_id WHEN doc_id % 3 = 0 THEN 'acq-' || doc_id END AS camera, CASE WHEN doc_id % 5 = 0 THEN 25.0 END::DOUBLE AS fps, CASE WHEN doc_id % 7 < 3 THEN doc_id % 7 * 2000000000 END AS crc FROM documents""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values looked up in two open maps: provenance first, or acquisition first; numbers in their range."""
    doc = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct(F.when(doc % 2 == 0, F.concat(F.lit("prov-"), doc)).otherwise(" ").alias("camera"), (doc % 7 * 2_000_000_000).alias("crc"))).alias("provenance"),
        F.to_json(F.struct(F.when(doc % 3 == 0, F.concat(F.lit("acq-"), doc)).alias("camera"), F.when(doc % 5 == 0, 25.0).otherwise(-1.0).alias("fps"))).alias("acquisition"),
    )
    look = lambda column, key: F.nullif(F.trim(F.get_json_object(column, f"$.{key}")), F.lit(""))
    crc, fps = look("provenance", "crc").try_cast("long"), F.coalesce(look("acquisition", "fps"), look("provenance", "fps")).try_cast("double")
    return rows.select("doc_id", F.coalesce(look("provenance", "camera"), look("acquisition", "camera")).alias("camera"), F.when((fps > 0) & (fps < float("inf")), fps).alias("fps"), F.when(crc.between(0, 2**32 - 1), crc).alias("crc"))


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT split, count(*) AS n, ((count(*) + 1023) // 1024)::BIGINT AS parts, 0::BIGINT AS problems, ((count(*) + 1023) // 1024)::BIGINT AS files FROM s GROUP BY split""")
def delivery_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery staged, published, read again and checked."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 10 < 8, "train").otherwise("test").alias("split"))
    with scratch(spark, "delivery") as base:
        delivery.staged(rows, "o_orderkey", f"{base}/staging")
        delivery.published(spark, f"{base}/staging", f"{base}/final")
        final = delivery.Delivery(*[f"{base}/final/{p}" for p in ("data", "index", "inventory")])
        wrong = delivery.problems(spark, final, rows, "o_orderkey").agg(F.count("*").alias("problems"))
        parts = spark.read.parquet(final.inventory).groupBy("split").agg(F.sum("rows").alias("n"), F.count("*").alias("parts"), F.sum("files").alias("files"))
        return durable(parts.crossJoin(F.broadcast(wrong)).select("split", "n", "parts", "problems", "files"))


@query()
def delivery_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum list of a delivery: each file once, with a digest of 64 digits."""
    rows = assigned(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name", "split")
    with scratch(spark, "delivery") as base:
        delivery.staged(rows, "c_custkey", base)
        found = delivery.checksums(spark, base)
        return durable(found.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count("*").alias("files"), F.count_if(F.col("sha256").rlike(manifests.SHA256)).alias("digests")))
