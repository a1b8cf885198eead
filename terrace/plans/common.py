"""What the registered queries share: tables, and SQL pieces of their DuckDB equivalents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, piece: str | None = None) -> DataFrame:
    """A table of the folder. Texts that fit one split often stand in one row group, which one task would read and work
    on alone: they are dealt out to all cores. Those of fewer splits than cores are dealt out by key, which needs no sort of
    the rows; larger ones are read as they are, without a shuffle. With ``piece`` they are dealt by key in any case, into
    partitions of about so many bytes of the file, for steps whose memory goes with a task's rows."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name in _TEXTS:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first().n or 0  # a listing: no file is read
        split, cores = in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")), spark.sparkContext.defaultParallelism
        if piece:
            return df.repartition(max(cores, -(-size // in_bytes(piece))), _TEXTS[name])
        if size <= split:
            return df.repartition(cores)
        if size <= split * cores:
            return df.repartition(3 * cores, _TEXTS[name])
    return df


def in_bytes(setting: str) -> int:
    """A size as Spark's settings write it: a number with an optional unit, b, k, m, g or t, and an optional b after that."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as retrieval documents: source stands for the drug, lang for the section."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("drug"), F.col("lang").alias("section"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as questions; each asks about the source of its number modulo 20."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("q"), "text", F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("drugs"))


IMPORTANT = ("de", "es")
HIGH = ("disgusting", "trash", "pathetic")
MEDIUM = ("because", "however", "license")


def sql_tokens(x: str) -> str:
    return rf"list_concat(regexp_extract_all(lower({x}), '[a-zA-Z][a-zA-Z0-9\-]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), regexp_extract_all(lower({x}), '[\x{{4e00}}-\x{{9fff}}]'))"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


CORPUS = "corpus AS (SELECT doc_id AS ord, source AS drug, lang AS section, text FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS q, text, ['src' || (item_id % 20)] AS drugs FROM benchmark)"
