"""The subpackage's queries, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import ann, bpe, dialogue, infill, jaccard, licenses, mixing, oracles, pii, quality, topk, toxicity, urlfilter, warc

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.searched(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.judged(_table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_source_mix": op3_source_mix,
    "op4_exact_topk": op4_exact_topk,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_ivf_pq": op8_ivf_pq,
    "op9_license_scan": op9_license_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_dialogue_repair": op11_dialogue_repair,
    "op12_warc": op12_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op3_source_mix": oracles.SOURCE_MIX,
    "op4_exact_topk": oracles.EXACT_TOPK,
    "op5_url_filter": oracles.URL_FILTER,
    "op6_pii": oracles.PII,
    "op9_license_scan": oracles.LICENSE_SCAN,
    "op11_dialogue_repair": oracles.DIALOGUE,
    "op12_warc": oracles.WARC,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
