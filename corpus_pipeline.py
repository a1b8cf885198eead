"""A training-corpus pipeline: each stage applies one operator of ``terrace.llm`` to what the last one kept.

Null texts count as empty and null ids are kept; empty texts stay; of repeated rows one stays (``jaccard_stage``); an empty
table gives an empty one in every stage; ties and long texts are as the operators say; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import jaccard, packing, secrets, suffix, toxicity
from terrace.llm.common import cut, documents, few_files

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _small_batches(spark: SparkSession) -> None:
    """Whole documents go to Python workers: fewer rows at a time keep both sides of an executor small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _few(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose rows come in few files."""
    return wraps(stage)(lambda spark, docs, sf_dir: few_files(stage(spark, docs, sf_dir)))


@_few
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest labelled examples call toxic."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels, carry=list(_COLUMNS)).where("predicted = 0").select(*_COLUMNS)


@_few
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates, null ids last; of repeated rows one stays."""
    _small_batches(spark)
    return jaccard.survivors(docs.select(*_COLUMNS))


@_few
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every byte of a 100-byte string that an earlier text has; characters cut in two go whole."""
    _small_batches(spark)
    kept = suffix.remove_repeats(docs, with_text=True, carry=["lang", "source"]).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


@_few
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put [SECRET] in place of every secret; all documents stay."""
    _small_batches(spark)
    clean = secrets.scan(docs, redact="[SECRET]", carry=["lang", "source"]).withColumn("text", F.col("clean_text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


@_few
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("jaccard", jaccard_stage),
    ("suffix", suffix_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Automata, tokenising and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
