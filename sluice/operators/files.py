"""Archives and array files written from tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import code_points
from sluice.operators.registry import query, table
from sluice.plans.lineage import durable, scratch
from sluice.sources import archives, arrays, manifests


def _archived(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The documents' texts as members of ZIP archives."""
    archives.register(spark)
    rows = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    rows.write.format("sluice_zip").mode("append").option("archiveBytes", 1 << 22).save(folder)


def _doc_id(path: str) -> F.Column:
    return F.regexp_extract(path, r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id")


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256, NULL::VARCHAR AS problem FROM documents")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as archive members, found by ranges and read with their checksums."""
    with scratch(spark, "archives") as folder:
        _archived(spark, sf_dir, folder)
        found = archives.members(spark, folder, ".txt", task_bytes=1 << 20)
        return durable(found.select(_doc_id("member"), "size", "sha256", "problem"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def extracted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same members as files of their own, in an inventory with digests."""
    with scratch(spark, "archives") as folder:
        _archived(spark, sf_dir, f"{folder}/packed")
        archives.extracted(archives.members(spark, f"{folder}/packed", ".txt", digest=False), f"{folder}/files")
        return durable(archives.inventory(spark, f"{folder}/files").select(_doc_id("path"), "size", "sha256"))


@query("""
WITH b AS (SELECT vec_id // 64 AS block, count(*) AS n, max(len(embedding)) AS width FROM embeddings GROUP BY 1)
SELECT 'block-' || block || '.npz' AS file, name, CASE name WHEN 'vectors' THEN 'float32' ELSE 'int64' END AS dtype, CASE name WHEN 'vectors' THEN [n, width] ELSE [n] END AS shape, true AS finite, NULL::VARCHAR AS problem FROM b, (VALUES ('vectors'), ('vec_ids')) t(name)""")
def array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as .npz files of 64 each, read back with their types and shapes."""
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    named = rows.select(F.concat(F.lit("block-"), "block", F.lit(".npz")).alias("path"), F.col("v.embedding").alias("vectors"), F.col("v.vec_id").alias("vec_ids"))
    with scratch(spark, "arrays") as folder:
        arrays.written(named, folder, {"vectors": "<f4", "vec_ids": "<i8"})
        found = arrays.scanned(spark, folder).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
        return durable(found.select("file", "name", "dtype", "shape", "finite", "problem"))


@query("""
SELECT doc_id::VARCHAR AS name, text AS caption, length(text) AS characters, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN lang || ',' || source WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS glosses,
  array_to_string(list_filter([CASE WHEN text = '' THEN 'label_char' END, CASE WHEN doc_id % 7 = 0 THEN 'label_gloss' END], lambda p: p IS NOT NULL), ',') AS problems FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of characters and glosses, as texts and objects, written as JSON lines and read with their faults."""
    doc, source = F.col("doc_id"), F.to_json(F.array("source"))
    both = F.concat(F.lit("["), F.to_json(F.struct(F.col("lang").alias("gloss"))), F.lit(","), F.substring(source, F.lit(2), F.length(source) - 1))
    gloss = F.when(doc % 7 == 0, F.lit("[7]")).when(doc % 3 == 0, both).when(doc % 3 == 1, F.to_json(F.array("lang"))).otherwise(F.lit("null"))
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null").select("doc_id", "text", "lang", "source", doc.cast("string").alias("name"))
    rows = manifests.by_name(docs).select("name", code_points(F.col("text")).alias("label_char"), F.parse_json(gloss).alias("label_gloss"))
    with scratch(spark, "annotations") as folder:
        manifests.annotations_written(rows, folder, ordered=True)
        found = manifests.annotation_records(manifests.json_lines(spark, folder))
        return durable(found.select("name", "caption", F.size("label_char").cast("long").alias("characters"), F.array_join("label_gloss", ",").alias("glosses"), F.array_join("problems", ",").alias("problems")))
