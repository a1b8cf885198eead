"""Quality rules and an importance verdict in DataFrame functions only.

Verdict: hashed n-gram log-likelihood ratio (as in importance resampling of Xie et al., 2023). Word 1- and 2-grams
are hashed into ``buckets``; one multinomial is counted over the trusted documents (labels.quality = 1, of which at
most ``max_trusted``, chosen by a hash of doc_id, so the fit and its broadcast are bounded), one over the whole
corpus. A document's score is the sum of log(trusted / corpus) over its n-grams divided by their number, and it is
kept when base rules pass and the score reaches ``threshold``: no draw, the same verdict for every document in
every run. Weights are rounded to micro-nats, so sums are exact whatever their order.

Each document is one row throughout: n-grams are arrays, counted per bucket by one explode with map-side
aggregation (at most ``buckets`` rows leave a task), and the weights come back as one constant array.

Defined cases: null text has no words; no trusted document at all gives every n-gram weight 0; null doc_ids stay;
repeated rows are judged alike; extra columns are ignored; rows of ``labels`` with null quality are not trusted; an empty
table gives an empty one; long texts are one row like others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def base_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    triple = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    docs = docs.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), triple.alias("triples"),
    )
    # Windows found twice or more: neighbours in sorted order; most documents have none and skip the sort.
    repeats = F.size(F.array_distinct("triples")) < F.size("triples")
    docs = docs.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = F.filter("sorted", lambda x, j: (F.get("sorted", j - 1)["h"] == x["h"]) | (F.coalesce(F.get("sorted", j + 1)["h"] == x["h"], F.lit(False))))
    docs = docs.withColumn("places", F.array_sort(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    return docs.select(
        "doc_id", "words", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def hashed_grams(words: str, buckets: int) -> Column:
    """Buckets of the 1- and 2-grams of an array column."""
    two = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(buckets)).cast("int")))
    return F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")), F.coalesce(two, F.array().cast("array<int>")))


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int, max_trusted: int) -> list[int]:
    """Micro-nats of log(trusted / corpus) per bucket, with one pseudo-count spread by the corpus."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(1))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    marked = marked.join(F.broadcast(trusted), "doc_id", "left")
    counts = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(hashed_grams("words", buckets)).alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    all_raw, all_target = sum(raw) + buckets, sum(target)
    if not all_target:
        return [0] * buckets
    strength = buckets / 10
    shares = [(r + 1) / all_raw for r in raw]
    return [round(1e6 * math.log((t + strength * p) / (all_target + strength) / p)) for t, p in zip(target, shares, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, max_trusted: int = 20_000, threshold: float = -0.1) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    weights = F.split(F.lit(",".join(map(str, gram_weights(docs, labels, buckets, max_trusted)))), ",").cast("array<int>")
    base = base_columns(docs).withColumn("grams", hashed_grams("words", buckets))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b))
    base = base.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams") / 1e6).otherwise(F.lit(0.0)))
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # written, so that a filter on the result reads columns instead of repeating the array expressions inside itself
    return cut(base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept")))
