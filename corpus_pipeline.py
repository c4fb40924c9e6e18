"""A corpus through five stages: quality, near-duplicates, personal data, mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of documents. Each result
is written as Parquet to the shared checkpoint folder and read again; it is
removed once the next one is written, and only the last stays.

Defined cases, in any stage: null and empty texts are kept as they are until
the mix, which takes only documents with words; null ids, languages, sources
and lengths are values of their own; repeated rows are copies, of which one
stays; texts of any length are read whole; further columns go along, whatever
their names; n_chars, lang and source may be missing for the first three
stages; an empty table gives an empty table; without labels every document is
kept by the first stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import bpe, jaccard, mixing, pii, quality
from sluice.plans.lineage import removed, shared_dir
from sluice.plans.shipping import shipped

VOCABULARY = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return jaccard.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mix", mixed),
    ("tokens", tokens),
]

#: SQL can't express the classifier; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shipped(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)  # the next stage reads this one's result only
        before = f"{folder}/{name}"
    return docs
