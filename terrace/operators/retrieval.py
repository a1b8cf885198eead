"""Retrieval and ranking over tables of questions: TF-IDF, BM25, hash and dense vectors, fusion, re-ranking.

Scores are compared at nine digits, so that the order in which a cluster adds them does not decide ties; ties go
by document order. Every top-k is a row_number filter, which Spark turns into a limit per group before the shuffle.
Documents that share no term with a question can only score by boosts. Boosts take few values, so the first k
documents of each boost class stand for all of them, and no question meets the whole corpus.

Tokens are exploded with ``explode_outer`` and nulls dropped after it: for a plain ``explode`` Spark adds a filter on the
array's size below it, which tokenises every text once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import terms, text
from ..sources import store
from .names import SMALL


def term_counts(docs: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode_outer(text.tokens(value)).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n_tokens): an empty document counts as one token."""
    return docs.select(key, F.greatest(F.size(text.tokens(value)), F.lit(1)).cast("long").alias("n_tokens"))


def smooth_idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1; ``n_docs(n)`` has one row."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    return df.select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def bm25_idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    return df.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("q",), order: str = "ord", score: str = "score") -> DataFrame:
    """The k best rows of each group with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def question_terms(questions: DataFrame, value: Column) -> DataFrame:
    """(q, term, n): repeated tokens of a question count again."""
    return questions.select("q", F.explode_outer(text.tokens(value)).alias("term")).where("term is not null").groupBy("q", "term").agg(F.count("*").alias("n"))


def boosted(matched: DataFrame, docs: DataFrame, questions: DataFrame, k: int, important: Sequence[str], section: float, drug: float, also: Column | None = None) -> DataFrame:
    """Add boosts to ``matched(q, ord, base)`` and, per boost class, the first k documents that matched no term.

    ``docs(ord, drug, section, ...)``, ``questions(q, drugs)``; the result has (q, ord, score) with score > 0: the ``k``
    best of each question, as ``top_k`` orders them, and few others. Matched rows get their boosts where they are and only
    the k best of a task are shuffled: a question can match nearly every document.
    """
    fixed = F.when(F.col("section").isin(*important), section).otherwise(0.0)
    if also is not None:
        fixed = fixed + also
    docs = docs.select("ord", "drug", fixed.alias("fixed"))
    first = Window.partitionBy("fixed").orderBy("ord")
    by_drug = Window.partitionBy("drug", "fixed").orderBy("ord")
    general = docs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("ord", "drug", "fixed").where("fixed > 0")
    asked = questions.select("q", F.explode("drugs").alias("drug")).distinct()
    own = docs.withColumn("r", F.row_number().over(by_drug)).where(F.col("r") <= k).drop("r").join(asked, "drug").select("q", "ord")
    # at most k documents for each of the few values of ``fixed``
    extra = own.union(questions.select("q").crossJoin(F.broadcast(general.select("ord"))))
    mine = asked.withColumn("mine", F.lit(drug))

    def scored(rows: DataFrame) -> DataFrame:
        rows = rows.join(docs, "ord").join(mine, ["q", "drug"], "left")
        return rows.select("q", "ord", (F.col("base") + F.col("fixed") + F.coalesce("mine", F.lit(0.0))).alias("score")).where("score > 0")

    # a document that is not among the k best matched ones has k before it, with or without its base
    best = top_k(scored(matched.select("q", "ord", "base")), k).drop("rank")
    return best.unionByName(scored(extra.withColumn("base", F.lit(0.0)))).groupBy("q", "ord").agg(F.max("score").alias("score"))


def _n_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))


def _asked_terms(questions: DataFrame, asked: Column) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(q, term, n), and a function that marks tables of at most so many rows for broadcast if there are ``SMALL`` or fewer."""
    wanted = question_terms(questions, asked)
    few = wanted.limit(SMALL + 1).count() <= SMALL
    return wanted, F.broadcast if few else lambda df: df


def bm25(docs: DataFrame, questions: DataFrame, value: Column, asked: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q, ord, base) of documents that share a term with the question; only terms of questions are counted.

    Tokens are made once: the counts of asked terms are written, with a row of a null term for each document, which tells its
    length. They are dealt by document; weights and sums stay in that partitioning.
    """
    wanted, small = _asked_terms(questions, asked)
    terms_ = wanted.select("term").distinct().union(questions.sparkSession.createDataFrame([(None,)], "term string")).withColumnRenamed("term", "_w")
    tokens = docs.select("ord", F.coalesce(text.tokens(value), F.array().cast("array<string>")).alias("_t")).withColumn("n_tokens", F.greatest(F.size("_t"), F.lit(1)).cast("long"))
    rows = tokens.select("ord", "n_tokens", F.explode_outer(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("term"))
    rows = rows.join(small(terms_), F.col("term").eqNullSafe(F.col("_w")), "left_semi")
    held = store.written(rows.groupBy("ord", "n_tokens", "term").agg(F.count("*").alias("tf")), "counts")
    average = held.where("term is null").agg(F.sum(F.col("n_tokens") * F.col("tf")).alias("s"), F.sum("tf").alias("n")).select((F.col("s") / F.col("n")).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))
    counts = held.where("term is not null").repartition("ord")
    idf = bm25_idf(counts, average.select("n")).select("term", "idf")
    hits = counts.join(small(wanted.join(small(idf), "term")), "term").crossJoin(F.broadcast(average.select("mean")))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))
    return hits.groupBy("q", "ord").agg(F.sum(F.col("n") * F.col("idf") * weight).alias("base"))


#: Terms whose document frequencies go to every task, of at most so many characters each.
FREQUENT, LONGEST = 200_000, 64


def _counted(tokens: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, and (row, word, tf) of each word of each list."""
    words = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    n = max(len(words.dictionary), 1)
    pair, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return words.dictionary, pair // n, pair % n, tf


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, _, word, _ = _counted(b.column("_t"))
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(word, minlength=len(words)))], ["term", "n"])


def tfidf(docs: DataFrame, questions: DataFrame, value: Column, asked: Column) -> DataFrame:
    """(q, ord, base): cosine of raw-count TF-IDF vectors; a question's unseen terms count with idf 1 in its norm.

    Texts are not shuffled: tasks count the documents of each term; then, with the frequencies of at most ``FREQUENT`` terms at
    hand, they sum the squares of those terms and send the others, which are most terms and few of their places, and the
    asked ones. Rows of one ``ord`` are one document; where there are such, tokens are dealt by document.
    """
    if docs.groupBy("ord").count().where("count > 1").limit(1).count():
        return _tfidf_dealt(docs, questions, value, asked)
    tokens = docs.select("ord", F.coalesce(text.tokens(value), F.array().cast("array<string>")).alias("_t"))
    n_docs = _n_docs(docs)
    found = store.written(tokens.select("_t").mapInArrow(_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    idf = found.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    cut, above = 1, 0
    for r in sorted(found.groupBy("df").count().collect(), reverse=True):  # one row for each number of documents
        above += r["count"]
        if above > FREQUENT:
            cut = r.df + 1
            break
    held = idf.where((F.col("df") >= cut) & (F.length("term") <= LONGEST)).select("term", "idf").toArrow().combine_chunks()
    wanted, small = _asked_terms(questions, asked)
    asked_terms = wanted.select("term").distinct()
    few = small(asked_terms) is not asked_terms
    terms_asked = sorted(r.term for r in asked_terms.collect()) if few else []
    known, weights = held.column("term").combine_chunks().cast(pa.string()), held.column("idf").to_numpy()
    ord_type = docs.schema["ord"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.array(terms_asked, pa.string())
        for b in batches:
            words, row, word, tf = _counted(b.column("_t"))
            at = pc.index_in(words, known).to_numpy(zero_copy_only=False) if len(known) else np.full(len(words), np.nan)
            rare = np.isnan(at)
            weight = np.zeros(len(words))
            weight[~rare] = weights[at[~rare].astype(np.int64)]
            squares = np.bincount(row, (tf * weight[word]) ** 2, b.num_rows)
            ask = pc.is_in(words, named).to_numpy(zero_copy_only=False) if few else np.ones(len(words), bool)
            send = np.flatnonzero((rare | ask)[word])
            doc = np.concatenate([np.arange(b.num_rows), row[send]])
            none = pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([
                b.column("ord").take(pa.array(doc)), pa.concat_arrays([none, words.take(pa.array(word[send]))]), pa.array(np.concatenate([np.zeros(b.num_rows, np.int64), tf[send]])),
                pa.array(np.concatenate([np.zeros(b.num_rows, bool), rare[word[send]]])), pa.array(np.concatenate([squares, np.zeros(len(send))])),
            ], ["ord", "term", "tf", "rare", "squares"])

    rows = store.written(tokens.mapInArrow(run, f"ord {ord_type.simpleString()}, term string, tf long, rare boolean, squares double"), "weighed")
    weight = F.col("tf") * F.col("idf")
    rare = rows.where("rare").join(idf.where((F.col("df") < cut) | (F.length("term") > LONGEST)).select("term", "idf"), "term").select("ord", (weight * weight).alias("squares"))
    norms = rows.where("term is null").select("ord", "squares").union(rare).groupBy("ord").agg(F.sqrt(F.sum("squares")).alias("norm"))
    known_ = store.written(wanted.join(idf.select("term", "idf"), "term", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(1.0))), "asked")
    own = known_.groupBy("q").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own"))
    hits = rows.where("term is not null").select("ord", "term", "tf").repartition("ord")
    dots = hits.join(small(known_.where("idf is not null").select("q", "term", "v", "idf")), "term").groupBy("q", "ord").agg(F.sum(F.col("v") * weight).alias("dot"))
    return dots.join(norms, "ord").join(small(own), "q").select("q", "ord", (F.col("dot") / (F.col("norm") * F.col("own"))).alias("base"))


def _tfidf_dealt(docs: DataFrame, questions: DataFrame, value: Column, asked: Column) -> DataFrame:
    """``tfidf`` where several rows can be one document: tokens are dealt by document once."""
    tokens = docs.select("ord", text.tokens(value).alias("_t")).repartition("ord").select("ord", F.explode_outer("_t").alias("term")).where("term is not null")
    counts = tokens.groupBy("ord", "term").agg(F.count("*").alias("tf"))
    idf = smooth_idf(counts, _n_docs(docs)).select("term", "idf")
    weight = F.col("tf") * F.col("idf")
    norms = counts.join(idf, "term").groupBy("ord").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    wanted, small = _asked_terms(questions, asked)
    known = wanted.join(idf, "term", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(1.0)))
    own = known.groupBy("q").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own"))
    hits = tokens.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("ord", "term").agg(F.count("*").alias("tf"))
    dots = hits.join(small(known.where("idf is not null").select("q", "term", "v", "idf")), "term").groupBy("q", "ord").agg(F.sum(F.col("v") * weight).alias("dot"))
    return dots.join(norms, "ord").join(small(own), "q").select("q", "ord", (F.col("dot") / (F.col("norm") * F.col("own"))).alias("base"))


def hash_vectors(rows: DataFrame, key: str, value: Column, size: int = 384) -> DataFrame:
    """(key, bucket, w): unit vectors of token counts in hash buckets, sparse."""
    counts = term_counts(rows, key, value).groupBy(key, text.hash_bucket(F.col("term"), size).alias("bucket")).agg(F.sum("tf").alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("w"))


def hash_similarity(docs: DataFrame, questions: DataFrame, value: Column, asked: Column, size: int = 384) -> DataFrame:
    """(q, ord, cosine) of documents that share a bucket with the question."""
    left = hash_vectors(questions, "q", asked, size).withColumnRenamed("w", "v")
    return hash_vectors(docs, "ord", value, size).join(left, "bucket").groupBy("q", "ord").agg(F.sum(F.col("v") * F.col("w")).alias("cosine"))


#: Documents whose tokens are counted at a time, and cosines that are held at a time: what bounds a task's memory.
SLICE, HELD = 1000, 1 << 21


def bucket_counts(tokens: pa.ListArray, size: int) -> np.ndarray:
    """How many tokens of each list fall into each bucket."""
    words = tokens.flatten().dictionary_encode()
    bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest(), "big") % size for t in words.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    if not len(row):
        return np.zeros((len(tokens), size))
    return np.bincount(row * size + bucket[words.indices.to_numpy()], minlength=len(tokens) * size).reshape(-1, size)


def question_parts(n: int, rows: int) -> Iterator[slice]:
    """Questions in parts whose cosines with so many rows are at most ``HELD``."""
    step = max(1, HELD // max(rows, 1))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def hash_nearest(docs: DataFrame, questions: DataFrame, value: Column, asked: Column, k: int, size: int = 384, limit_mb: int = 64) -> DataFrame:
    """(q, ord, cosine) that holds the k nearest documents of each question, and few others: ``top_k`` decides.

    Every document has a cosine with nearly every question, so each Arrow batch of documents is multiplied with the
    questions' vectors and only what can be among the k best of its batch is shuffled. The questions are a stated set;
    vectors of more than ``limit_mb`` go by ``hash_similarity``, a join on buckets. A task holds the cosines of a batch with
    some questions at a time, and leaves out what a batch before has k better ones for.
    """
    vectors = hash_vectors(questions, "q", asked, size)
    most = (limit_mb << 20) // (8 * size)
    asked_ids = [r.q for r in vectors.select("q").distinct().limit(most + 1).collect()]
    if len(asked_ids) > most:
        return hash_similarity(docs, questions, value, asked, size)
    at = {q: i for i, q in enumerate(asked_ids)}
    matrix = np.zeros((len(at), size))
    for r in vectors.collect():  # at most ``most`` questions of ``size`` buckets
        matrix[at[r.q], r.bucket] = r.w
    q_type, ord_type = questions.schema["q"].dataType, docs.schema["ord"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(asked_ids, to_arrow_type(q_type))
        least = np.zeros(len(known))
        for b in batches:
            counts = np.zeros((b.num_rows, size))
            for i in range(0, b.num_rows, SLICE):
                counts[i : i + SLICE] = bucket_counts(b.column("_t").slice(i, SLICE), size)
            norm = np.maximum(np.sqrt((counts * counts).sum(1)), 1.0)[:, None]
            for part in question_parts(len(known), b.num_rows):
                cosine = (counts @ matrix[part].T) / norm
                keep = cosine > 0
                if b.num_rows > k:
                    least[part] = np.maximum(least[part], np.partition(cosine, -k, axis=0)[-k])
                keep &= cosine >= least[part] - 2e-9  # ties at nine digits stay
                docs_at, asked_at = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([known.take(pa.array(asked_at + part.start)), b.column("ord").take(pa.array(docs_at)), pa.array(cosine[keep])], ["q", "ord", "cosine"])

    rows = docs.select("ord", F.coalesce(text.tokens(value), F.array().cast("array<string>")).alias("_t"))
    return rows.mapInArrow(run, f"q {q_type.simpleString()}, ord {ord_type.simpleString()}, cosine double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(docs: DataFrame, questions: DataFrame, scope: str | None = None, limit_mb: int = 64) -> DataFrame:
    """(q, ord, cosine) of unit vectors ``docs(ord, vec, ...)`` and ``questions(q, vec[, scope])``.

    With ``scope`` a question meets only documents of its scope, by an equi-join. Without it every question is
    compared with every document: the questions are a stated set, broadcast in blocks of at most ``limit_mb``.
    """
    if scope:
        pairs = docs.join(questions.select("q", F.col("vec").alias("asked"), F.col(scope).alias("_scope")), F.col(scope) == F.col("_scope"))
        return pairs.select("q", "ord", dot(F.col("vec"), F.col("asked")).alias("cosine"))
    size = questions.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    blocks = -(-size.n * (size.dim or 0) * 8 // (limit_mb << 20)) or 1
    parts = []
    for i in range(blocks):
        part = questions.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).select("q", F.col("vec").alias("asked"))
        parts.append(docs.crossJoin(F.broadcast(part)).select("q", "ord", dot(F.col("vec"), F.col("asked")).alias("cosine")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dense_scored(similar: DataFrame, docs: DataFrame, questions: DataFrame, k: int, important: Sequence[str], section: float = 0.12, drug: float = 0.18) -> DataFrame:
    """The k best of the 3k nearest: 1 / (1 + cosine distance) and boosts, rounded to four digits before the sort."""
    near = top_k(similar.withColumnRenamed("cosine", "score"), 3 * k).select("q", "ord", F.col("score").alias("cosine"))
    asked = questions.select("q", "drugs")
    rows = near.join(docs.select("ord", "drug", "section"), "ord").join(asked, "q")
    value = 1 / (2 - F.col("cosine")) + F.when(F.col("section").isin(*important), section).otherwise(0.0) + F.when(F.array_contains("drugs", F.col("drug")), drug).otherwise(0.0)
    return top_k(rows.select("q", "ord", F.round(value, 4).alias("score")), k)


def rrf(lists: dict[str, DataFrame], key: Sequence[str], mine: Column | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (q, rank, *key): equal keys of one list add up too.

    Scores get 0.02 for keys of several lists and 0.03 where ``mine`` holds, are rounded to four digits and then
    sorted; ties keep the order of the lists.
    """
    rows = None
    for i, (name, ranked) in enumerate(lists.items()):
        part = ranked.select("q", "rank", *key).withColumns({"_list": F.lit(name), "_at": F.lit(i).cast("long") * 1_000_000 + F.col("rank")})
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("q", *key).agg(F.sum(1 / (constant + F.col("rank"))).alias("s"), F.count_distinct("_list").alias("lists"), F.min("_at").alias("at"))
    value = F.col("s") + F.when(F.col("lists") > 1, 0.02).otherwise(0.0)
    if mine is not None:
        value = value + F.when(mine, 0.03).otherwise(0.0)
    fused = fused.withColumn("score", F.round(value, 4)).drop("s")
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "at")))


def rerank(fused: DataFrame, important: Column, mine: Column, risky: Column) -> DataFrame:
    """Rule boosts on fused scores; rounded, stable on the fused order."""
    value = F.col("score") + F.when(important, 0.08).otherwise(0.0) + F.when(mine, 0.08).otherwise(0.0) + F.when(risky, 0.05).otherwise(0.0)
    out = fused.withColumnRenamed("rank", "before").withColumn("score", F.round(value, 4))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "before"))).drop("before")


def first_seen(evidence: DataFrame, key: Sequence[str], snippet: str, order: str = "ord") -> DataFrame:
    """One row of each key and snippet (without a leading ordinal) per question: the first."""
    plain = text.ordinal_stripped(F.col(snippet))
    w = Window.partitionBy("q", *key, F.trim(plain)).orderBy(order)
    return evidence.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diversified(evidence: DataFrame, concept: str, limit: int, order: str = "ord") -> DataFrame:
    """The first max(2, limit / concepts) rows of each concept, concepts by first row, then the rest in order; at most ``limit``."""
    per_concept = Window.partitionBy("q", concept)
    rows = evidence.withColumns({"_first": F.min(order).over(per_concept), "_n": F.row_number().over(per_concept.orderBy(order))})
    rows = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy("q").orderBy("_first")))
    rows = rows.withColumn("_k", F.max("_rank").over(Window.partitionBy("q")))
    quota = F.when(F.col("_k") <= 1, limit).otherwise(F.greatest(F.lit(2), F.floor(F.lit(limit) / F.col("_k"))))
    inside = F.col("_n") <= quota
    at = Window.partitionBy("q").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, F.col("_first")).otherwise(F.col(order)), F.when(inside, F.col("_n")).otherwise(0))
    return rows.withColumn("position", F.row_number().over(at)).where(F.col("position") <= limit).drop("_first", "_n", "_rank", "_k")


def priority(matches: Column, titled: Column, snippet: Column, high: Sequence[str] = terms.POPULATION_HIGH, medium: Sequence[str] = terms.POPULATION_MEDIUM) -> Column:
    """The score +2.0 for a match, +0.8 for its section, +0.4 and +0.3 for strong and mild words."""
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return F.round(F.col("score") + add(matches, 2.0) + add(titled, 0.8) + add(text.contains_any(snippet, high), 0.4) + add(text.contains_any(snippet, medium), 0.3), 4)


def prioritized(evidence: DataFrame, matches: Column, titled: Column, snippet: Column, high: Sequence[str] = terms.POPULATION_HIGH, medium: Sequence[str] = terms.POPULATION_MEDIUM, order: str = "ord") -> DataFrame:
    """Population evidence first, by ``priority``."""
    out = evidence.withColumn("score", priority(matches, titled, snippet, high, medium))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), order)))


# --- both lists from one pass --------------------------------------------------------------------------


def one_pass(docs: DataFrame, asks: DataFrame, value: Column, also: Column, lexical: Column, hashed: Column, near: int, size: int = 384, limit_mb: int = 64) -> tuple[DataFrame, DataFrame]:
    """What BM25 and the hash vectors need of ``docs(ord, ...)``, from tokens that are made once a document and never shuffled.

    Returns (ord, n_tokens, term, tf) for terms of ``asks(q, ...)``, with a row of a null term for each document, and
    (q, ord, cosine) that holds the ``near`` nearest documents of each ask. Tokens of ``value`` make both, those of ``also``
    the first only; ``lexical`` and ``hashed`` are the asks' texts. A task keeps the nearest so far of each ask. The asks are
    a stated set; beyond ``limit_mb`` of vectors or terms the two operators run one by one.
    """
    vectors = hash_vectors(asks, "q", hashed, size)
    asked = asks.select("q").distinct()
    n = asked.count()
    wanted = question_terms(asks, lexical).select("term").distinct()
    if n * size * 8 > limit_mb << 20 or wanted.limit(SMALL + 1).count() > SMALL:
        both = docs.withColumn("_t", F.concat(text.tokens(also), text.tokens(value))).withColumn("n_tokens", F.greatest(F.size("_t"), F.lit(1)).cast("long"))
        rows = both.select("ord", "n_tokens", F.explode_outer("_t").alias("term")).join(wanted, "term", "left_semi")
        counts = rows.groupBy("ord", "n_tokens", "term").agg(F.count("*").alias("tf"))
        return counts.unionByName(both.select("ord", "n_tokens", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))), hash_similarity(docs, asks, value, hashed, size)
    ids = [r.q for r in asked.collect()]  # a stated set of bounded size
    at = {q: i for i, q in enumerate(ids)}
    matrix = np.zeros((n, size))
    for r in vectors.collect():
        matrix[at[r.q], r.bucket] = r.w
    terms_asked = sorted(r.term for r in wanted.collect())
    q_type, ord_type = to_arrow_type(asks.schema["q"].dataType), to_arrow_type(docs.schema["ord"].dataType)

    def best(cosine: np.ndarray, order: np.ndarray) -> np.ndarray:
        return np.lexsort((order, -np.round(cosine, 9)))[:near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms_asked, pa.string())
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * n
        least = np.full(n, -1.0)

        def rows(ord_, n_tokens, term, tf, q, cosine) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ord_, n_tokens, term, tf, q, cosine], ["ord", "n_tokens", "term", "tf", "q", "cosine"])

        for b in batches:
            m, ords = b.num_rows, b.column("ord")
            split = []
            for name in ("_v", "_a"):
                tokens = b.column(name)
                terms_ = tokens.flatten().dictionary_encode()
                split.append((terms_.dictionary, terms_.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(m), np.diff(tokens.offsets.to_numpy()))))
            (words, index, row), extra = split[0], split[1]
            length = np.maximum(np.bincount(row, minlength=m) + np.bincount(extra[2], minlength=m), 1)
            pairs = [r * len(known) + pc.index_in(w, known).to_numpy(zero_copy_only=False)[i] for w, i, r in split if len(i)]
            pairs = np.concatenate([p[~np.isnan(p)] for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
            pair, tf = np.unique(pairs, return_counts=True)
            doc = np.concatenate([pair // max(len(known), 1), np.arange(m)])
            term = pa.concat_arrays([known.take(pa.array(pair % max(len(known), 1))), pa.nulls(m, pa.string())])
            none = len(doc)
            yield rows(ords.take(pa.array(doc)), pa.array(length[doc]), term, pa.array(np.concatenate([tf, np.zeros(m, np.int64)])), pa.nulls(none, q_type), pa.nulls(none, pa.float64()))
            bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest(), "big") % size for t in words.to_pylist()], np.int64)
            counts = np.bincount(row * size + bucket[index], minlength=m * size).reshape(-1, size) if len(row) else np.zeros((m, size))
            norm = np.maximum(np.sqrt((counts * counts).sum(1)), 1.0)[:, None]
            order = ords.to_numpy(zero_copy_only=False)
            for part in question_parts(n, m):
                cosine = (counts @ matrix[part].T) / norm
                for i in range(part.start, part.stop):
                    own = cosine[:, i - part.start]
                    hit = np.flatnonzero((own > 0) & (own >= least[i] - 2e-9))
                    if len(hit):
                        c, o = np.concatenate([kept[i][0], own[hit]]), np.concatenate([kept[i][1], order[hit]])
                        top = best(c, o)
                        kept[i] = (c[top], o[top])
                        if len(top) == near:
                            least[i] = kept[i][0].min()
        sizes = [len(c) for c, _ in kept]
        if sum(sizes):
            total = sum(sizes)
            q = pa.array(ids, q_type).take(pa.array(np.repeat(np.arange(n), sizes)))
            yield rows(pa.array(np.concatenate([o for _, o in kept]), ord_type), pa.nulls(total, pa.int64()), pa.nulls(total, pa.string()), pa.nulls(total, pa.int64()), q, pa.array(np.concatenate([c for c, _ in kept])))

    none = F.array().cast("array<string>")
    tokens = docs.select("ord", F.coalesce(text.tokens(value), none).alias("_v"), F.coalesce(text.tokens(also), none).alias("_a"))
    q_name, ord_name = asks.schema["q"].dataType.simpleString(), docs.schema["ord"].dataType.simpleString()
    found = store.written(tokens.mapInArrow(run, f"ord {ord_name}, n_tokens long, term string, tf long, q {q_name}, cosine double"), "pass")
    return found.where("q is null").select("ord", "n_tokens", "term", "tf"), found.where("q is not null").select("q", "ord", "cosine")


def bm25_of(postings: DataFrame, asks: DataFrame, lexical: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q, ord, base) as ``bm25`` gives it, from the first table of ``one_pass``: counts are dealt by document, sums stay there."""
    average = postings.where("term is null").agg(F.avg("n_tokens").alias("mean"), F.greatest(F.count("*"), F.lit(1)).alias("n"))
    wanted, small = _asked_terms(asks, lexical)
    counts = postings.where("term is not null")
    idf = bm25_idf(counts, average.select("n")).select("term", "idf")
    hits = counts.repartition("ord").join(small(wanted.join(small(idf), "term")), "term").crossJoin(F.broadcast(average.select("mean")))  # one row
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))
    return hits.groupBy("q", "ord").agg(F.sum(F.col("n") * F.col("idf") * weight).alias("base"))


def hybrid(docs: DataFrame, asks: DataFrame, k: Column, most: int, important: Sequence[str], risky: Sequence[str], key: Sequence[str] = ("source", "drug", "section", "snippet")) -> DataFrame:
    """(q, ord, *docs columns, rank, score): the ``k`` best passages of each ask, at most ``most``, fused and re-ranked.

    ``docs(ord, source, drug, section, text, snippet)``, ``asks(q, asked, drugs)``: BM25 over drug, section and text with the
    asked text and the names, hash vectors over texts; max(4 k, 16) passages of each list, vectors over-fetched threefold.
    """
    widest = max(4 * most, 16)
    deep = F.greatest(4 * k, F.lit(16))
    lexical = F.concat_ws(" ", "asked", F.array_join("drugs", " "))
    postings, near = one_pass(docs, asks, F.col("text"), F.concat_ws(" ", "drug", "section"), lexical, F.col("asked"), 3 * widest)
    depth = asks.select("q", deep.alias("_deep"), k.alias("_k"), "drugs")
    small = F.broadcast if asks.limit(SMALL + 1).count() <= SMALL else lambda x: x
    scored = boosted(bm25_of(postings, asks, lexical), docs, asks, widest, important, 0.35, 0.45)
    words = top_k(scored, widest).join(small(depth.select("q", "_deep")), "q").where("rank <= _deep").select("q", "ord", "rank")
    close = top_k(near.withColumnRenamed("cosine", "score"), 3 * widest).join(small(depth.select("q", "_deep", "drugs")), "q").where("rank <= 3 * _deep").select("q", "ord", F.col("score").alias("cosine"), "_deep", "drugs")
    close = close.join(docs.select("ord", "drug", "section"), "ord")
    value = 1 / (2 - F.col("cosine")) + F.when(F.col("section").isin(*important), 0.12).otherwise(0.0) + F.when(F.array_contains("drugs", F.col("drug")), 0.18).otherwise(0.0)
    vectors = top_k(close.select("q", "ord", "_deep", F.round(value, 4).alias("score")), widest).where("rank <= _deep").select("q", "ord", "rank")
    # texts meet only the documents that one of the lists names
    listed = words.withColumn("_l", F.lit(0)).union(vectors.withColumn("_l", F.lit(1)))
    shown = listed.join(docs.select("ord", *key), "ord").join(small(depth.select("q", "_k", "drugs")), "q").withColumn("_mine", F.array_contains("drugs", F.col("drug")))
    shown = store.written(shown, "lists")
    lists = {name: shown.where(F.col("_l") == i) for i, name in enumerate(("bm25", "dense"))}
    firsts = shown.groupBy("q", *key).agg(F.min("ord").alias("ord"))
    fused = rerank(rrf(lists, [*key, "_mine", "_k"], mine=F.col("_mine")), F.col("section").isin(*important), F.col("_mine"), text.contains_any(F.col("snippet"), risky))
    return fused.where(F.col("rank") <= F.col("_k")).join(firsts, ["q", *key]).select("q", "ord", *key, "rank", "score")
