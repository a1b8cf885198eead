"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

A word's score is log(c(context word) / c(context)) for the longest n-gram (up to ``order`` words) that another
document has, plus log(alpha) for each step down (Brants et al., 2007); single words score log(c / N), and a word
that no other document has log(1 / (N + 1)). A document's own occurrences are subtracted from every count, else
it would always find its own n-grams. A document's score is the mean over its words; the sum follows.

Plan. Documents are dealt to written blocks, so that a block holds the same documents in every pass and after a lost
executor. Each task explodes the n-grams of a block of documents into names, pre-aggregates them and ships each hash
range of each order as one sorted, compressed array: 4 to 5 bytes a distinct n-gram and block instead of a row. One
task per (order, range) sums the counts and answers every block with the totals of the n-grams that it asked about;
the answers are joined to the blocks, where counts meet the words again. Names are 56-bit hashes. A frequent
n-gram costs one entry per block, so no key is hot, and ranges are sized by the corpus.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z folded. Defined cases: null, empty or blank text has no words, score null and
total 0; a repeated row is another document and counts as such; null doc_ids stay; an empty table gives an empty one; a
long text is a block of its own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answer, ask, batch, block_texts, document_blocks, gram_names, unplanes, word_names

#: Bytes of text in a block of documents, and how hard it is compressed: blocks are written and shuffled once each.
BLOCK_BYTES, BLOCK_LEVEL = 8 << 20, 9
_BITS = 56


# --- blocks ------------------------------------------------------------------------------------------


class BlockGrams:
    """The n-grams of a block of texts: per order the distinct names and, per word, which one ends there."""

    def __init__(self, texts: list[bytes], order: int):
        words = [word_names(x, True) for x in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words)
        first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.words)) - first[self.doc]
        self.order = order

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(name, index of the last word) of each k-gram that lies in one document."""
        ends = np.arange(k - 1, len(self.words))
        whole = self.place[ends] >= k - 1
        return gram_names(self.words, k)[whole] >> np.uint64(64 - _BITS), ends[whole]


# --- counting ----------------------------------------------------------------------------------------


def _ask(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, packed in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "packed")), strict=True):
                grams = BlockGrams(block_texts(sizes, packed), order)
                for k in range(1, order + 1):
                    buckets, blobs = ask(*np.unique(grams.of(k)[0], return_counts=True), _BITS // 8, bits)
                    n = len(blobs)
                    yield batch({"k": ([k] * n, pa.int32()), "bucket": (buckets, pa.int64()), "block": ([block] * n, pa.int64()), "blob": (blobs, pa.binary())})

    return run


def _answer(bits: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blobs = answer([x.as_py() for x in table.column("blob")], bucket, _BITS // 8, bits, 6)
        return pa.table({"k": table.column("k"), "bucket": table.column("bucket"), "block": table.column("block"), "blob": pa.array(blobs, pa.binary())})

    return run


# --- scoring -----------------------------------------------------------------------------------------


def backoff_scores(grams: BlockGrams, totals: list[np.ndarray], n_all: int, alpha: float) -> np.ndarray:
    """The sum of word scores per document; totals[k - 1] has the corpus count of each distinct k-gram."""
    n = len(grams.words)
    score, open_, steps = np.zeros(n), np.ones(n, bool), np.zeros(n)
    others = {}  # counts without the document's own, by the index of the last word
    for k in range(1, grams.order + 1):
        names, ends = grams.of(k)
        which = np.unique(names, return_inverse=True)[1]
        _, pair, own = np.unique(grams.doc[ends] * (len(totals[k - 1]) + 1) + which, return_inverse=True, return_counts=True)
        others[k] = np.zeros(n, np.int64)
        others[k][ends] = totals[k - 1][which] - own[pair]
    rest = (n_all - grams.sizes)[grams.doc].astype(np.float64)
    for k in range(grams.order, 0, -1):
        possible = open_ & (grams.place >= k - 1)
        hit = np.flatnonzero(possible & (others[k] > 0))
        below = others[k - 1][hit - 1] if k > 1 else rest[hit]
        score[hit] = np.log(others[k][hit] / below) + steps[hit] * math.log(alpha)
        open_[hit] = False
        steps[possible & open_] += 1
    left = np.flatnonzero(open_)
    score[left] = -np.log(rest[left] + 1) + (steps[left] - 1) * math.log(alpha)
    return np.bincount(grams.doc, score, len(grams.sizes))


def _score(order: int, alpha: float, n_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for ids, sizes, packed, answers in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "packed", "answers")), strict=True):
                grams = BlockGrams(block_texts(sizes, packed), order)
                totals = []
                for k in range(1, order + 1):
                    parts = [unpack(x["blob"]) for x in sorted(answers or [], key=lambda x: x["bucket"]) if x["k"] == k]
                    totals.append(np.concatenate([unplanes(x, len(x) // 6, 6).astype(np.int64) for x in parts]) if parts else np.zeros(0, np.int64))
                total = backoff_scores(grams, totals, n_all, alpha)
                mean = [t / n if n else None for t, n in zip(total.tolist(), grams.sizes.tolist(), strict=True)]
                yield batch({"doc_id": (ids, pa.int64()), "n_words": (grams.sizes, pa.int64()), "score": (mean, pa.float64()), "total_score": (total, pa.float64())})

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = (x for sizes, packed in zip(b.column("sizes").to_pylist(), b.column("packed").to_pylist(), strict=True) for x in block_texts(sizes, packed))
        yield batch({"n": ([sum(len(word_names(x, True)) for x in texts)], pa.int64())})


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_words, score, total_score) of ``docs(doc_id, text)``; score is the mean over a document's words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = document_blocks(docs, BLOCK_BYTES, BLOCK_LEVEL)
    size = blocks.mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    bits = max(4, (size >> 20).bit_length())  # about a million words in a range
    asked = blocks.mapInArrow(_ask(order, bits), "k int, bucket long, block long, blob binary")
    answers = asked.groupBy("k", "bucket").applyInArrow(_answer(bits), "k int, bucket long, block long, blob binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("k", "bucket", "blob")).alias("answers"))
    return blocks.join(answers, "block", "left").mapInArrow(_score(order, alpha, size), "doc_id long, n_words long, score double, total_score double")
