"""A stored postings index: built once, checked for completeness, asked by term.

Documents stand in blocks of neighbours in a given order (by section, say), so that a term's postings of a block lie in one
row. A frequent term has a row for each block with the greatest weight in it; a rare one, with at most one block of
documents, has a single row. The table is bucketed by term and sorted, so questions read the rows of their terms only.

``top_k`` scores rare terms first. They give each question a score that its k-th document reaches at least, and the
greatest weights bound what a block can still reach; frequent terms are then scored in the blocks that can, and nowhere else.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import store
from . import ordinals, retrieval
from .names import broadcast_if_small

BLOCK = 256
#: Terms of questions up to which a scan names them.
NAMED = 200


class IncompleteIndex(Exception):
    """The stored index does not hold the documents it is asked for."""


@dataclass
class StoredIndex:
    """A folder with ``postings``, ``stats`` and ``documents``, and the name under which the session knows the postings."""

    spark: SparkSession
    path: str
    buckets: int
    table: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def stats(self) -> DataFrame:
        """One row: n, mean."""
        return self.spark.read.parquet(f"{self.path}/stats")


def _weight(tf: Column, n_tokens: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_tokens / mean))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _name(path: str) -> str:
    return f"terrace_postings_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def open_index(spark: SparkSession, path: str, buckets: int) -> StoredIndex:
    """An index that stands in ``path``, made known to this session."""
    table = _name(path)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (term string, df long, block long, top double, ords array<long>, tfs array<int>, lens array<int>, blocks array<long>) "
        f"USING parquet CLUSTERED BY (term) SORTED BY (term, block) INTO {buckets} BUCKETS LOCATION '{path}/postings'"
    )
    return StoredIndex(spark, path, buckets, table)


def stored_documents(spark: SparkSession, path: str) -> int:
    """How many documents an index holds; an index whose build did not end holds none."""
    try:
        return spark.read.parquet(f"{path}/documents").agg(F.sum("n").alias("n")).first().n or 0
    except AnalysisException:  # nothing there
        return 0


def build(docs: DataFrame, value: Column, path: str, near: Sequence[str] = (), buckets: int = 16, k1: float = 1.5, b: float = 0.75) -> StoredIndex:
    """Write the index of ``docs(ord, ...)``; ``near`` columns order documents into blocks. The count of documents comes last,
    so a build that was lost on the way counts as none."""
    spark = docs.sparkSession
    # tokens are made once: counts are written, with a row of a null term for each document, which tells its length
    tokens = docs.select("ord", F.coalesce(text.tokens(value), F.array().cast("array<string>")).alias("_t")).withColumn("n_tokens", F.greatest(F.size("_t"), F.lit(1))).repartition("ord")
    counts = tokens.select("ord", "n_tokens", F.explode_outer(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("term"))
    counts = store.written(counts.groupBy("ord", "n_tokens", "term").agg(F.count("*").cast("int").alias("tf")), "counts")
    lengths = counts.where("term is null").select("ord", "n_tokens")
    lengths = ordinals.numbered(docs.select("ord", *near).join(lengths, "ord") if near else lengths, [*near, "ord"])
    lengths = lengths.select("ord", "n_tokens", F.expr(f"number div {BLOCK}").alias("block"))
    lengths.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")  # one row
    rows = counts.where("term is not null").select("ord", "term", "tf")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    rows = rows.join(lengths, "ord").join(df, "term").crossJoin(F.broadcast(stats))
    rows = rows.withColumn("_b", F.col("block")).withColumns({"block": F.when(F.col("df") > BLOCK, F.col("block")).otherwise(F.lit(-1)), "_w": _idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("n_tokens"), F.col("mean"), k1, b)})
    # a row holds at most one block of documents
    held = rows.groupBy("term", "df", "block").agg(F.max("_w").alias("top"), F.array_sort(F.collect_list(F.struct("ord", "tf", "n_tokens", "_b"))).alias("p"))
    held = held.select("term", "df", "block", "top", F.col("p.ord").alias("ords"), F.col("p.tf").alias("tfs"), F.col("p.n_tokens").alias("lens"), F.when(F.col("block") < 0, F.col("p._b")).alias("blocks"))
    held.repartition(buckets, "term").sortWithinPartitions("term", "block").write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "block").option("path", f"{path}/postings").option("compression", "zstd").saveAsTable(_name(path))
    docs.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/documents")
    return StoredIndex(spark, path, buckets, _name(path))


def ensure(docs: DataFrame, value: Column, path: str, near: Sequence[str] = (), buckets: int = 16) -> tuple[str, StoredIndex]:
    """('built' or 'kept', index): an empty place is built, a complete index kept; a partial one is never silently rebuilt."""
    held, wanted = stored_documents(docs.sparkSession, path), docs.count()
    if held == 0:
        return "built", build(docs, value, path, near, buckets)
    if held != wanted:
        raise IncompleteIndex(f"{path} holds {held} of {wanted} documents")
    return "kept", open_index(docs.sparkSession, path, buckets)


def scored(index: StoredIndex, questions: DataFrame, asked: Column, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q, ord, base) that holds the k best documents of each question by BM25, and only documents of blocks that can hold one."""
    wanted = retrieval.question_terms(questions, asked)
    wanted = broadcast_if_small(wanted)
    stats = F.broadcast(index.stats)  # one row
    weight = F.col("c") * _idf(F.col("n"), F.col("df")) * _weight(F.col("p.tfs"), F.col("p.lens"), F.col("mean"), k1, b)
    wanted = wanted.withColumnRenamed("n", "c")

    def scores(rows: DataFrame, *also: str) -> DataFrame:
        pairs = rows.crossJoin(stats).select("q", "c", "n", "df", "mean", F.explode(F.arrays_zip("ords", "tfs", "lens", *also)).alias("p"))
        return pairs.select("q", F.col("p.ords").alias("ord"), weight.alias("w"), *[F.col(f"p.{a}").alias("block") for a in also])

    postings = index.postings
    terms_asked = [r.term for r in wanted.select("term").distinct().limit(NAMED + 1).collect()]
    if len(terms_asked) <= NAMED:  # few enough to be named: whole buckets and row groups are left out
        postings = postings.where(F.col("term").isin(terms_asked))
    # read by three steps below
    rare = store.written(scores(postings.where("block = -1").join(wanted, "term"), "blocks").groupBy("q", "ord", "block").agg(F.sum("w").alias("w")), "rare")
    reached = retrieval.top_k(rare.withColumnRenamed("w", "score"), k).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    # the most that frequent terms can add in a block, from three narrow columns
    bounds = postings.where("block >= 0").select("term", "block", "top").join(wanted, "term").groupBy("q", "block").agg(F.sum(F.col("c") * F.col("top")).alias("most"))
    greatest = rare.groupBy("q", "block").agg(F.max("w").alias("best"))
    open_ = bounds.join(reached, "q", "left").join(greatest, ["q", "block"], "left").where("most + coalesce(best, 0) >= coalesce(least, 0) - 1e-9").select("q", "block")
    frequent = scores(postings.where("block >= 0").join(wanted, "term").join(broadcast_if_small(open_), ["q", "block"], "left_semi"))
    return rare.select("q", "ord", "w").union(frequent).groupBy("q", "ord").agg(F.sum("w").alias("base"))


def top_k(index: StoredIndex, questions: DataFrame, asked: Column, k: int = 8) -> DataFrame:
    """(q, ord, rank, score) as a BM25 scan of all documents gives it."""
    return retrieval.top_k(scored(index, questions, asked, k).withColumnRenamed("base", "score"), k)
