"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases whose borders depend only on nearby symbols (deterministic coin tossing, Cole and
Vishkin, 1986; Mehlhorn et al., 1997): equal neighbours are collapsed, each symbol is replaced by the place and
value of the lowest bit in which it differs from its left neighbour until the alphabet has six letters, and local
maxima begin phrases. Phrases are named by their content, the names form the next level's text, and so on; so equal
substrings get equal names in their interior, wherever they stand. A phrase of level 2 spans about 10 bytes and
one of level 3 about 40; the distinct names of both levels are the document's features.

The fingerprint is the ``k`` smallest 32-bit hashes of the features (a bottom-k sketch) in hexadecimal; likeness
estimates the Jaccard similarity of two feature sets.

Defined cases: null text is empty; an empty text has an empty fingerprint, which is like another empty one (1.0)
and unlike all others (0.0); of rows with equal doc_id the order is by text; null doc_ids
come last; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, mix, powers

LEVELS = (2, 3)
_NO_ID = -(2**63)


def _toss_table(size: int) -> np.ndarray:
    """2 * (lowest differing bit) + (its value in the right symbol), for symbols below ``size``."""
    left, right = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    diff = left ^ right
    bit = np.bitwise_count((diff & -diff) - 1) * (diff > 0)
    return (2 * bit + ((right >> bit) & 1)).astype(np.uint8).ravel()


_TOSS = {size: _toss_table(size) for size in (256, 128)}


def phrase_starts(symbols: np.ndarray) -> np.ndarray:
    """Where phrases begin; ``symbols`` are bytes or 64-bit names."""
    heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    x = symbols[heads]
    if len(x) < 3:
        return np.zeros(1, np.int64)
    if x.dtype != np.uint8:
        diff = x[1:] ^ x[:-1]
        bit = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        first = (x[0] & np.uint64(1)).astype(np.uint8)
        x = np.append(first, (np.uint64(2) * bit + ((x[1:] >> bit) & np.uint64(1))).astype(np.uint8))
        size = 128
    else:
        size = 256
    for _ in range(3):
        table = _TOSS[size]
        x = np.append(x[0] & 1, table[x[:-1].astype(np.uint16) * size + x[1:]])
        size = 128
    tops = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
    return heads[np.append(0, tops)] if not len(tops) or tops[0] else heads[tops]


def phrase_names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(0x51ED2701)) * up[: len(symbols)], out=sums[1:])
    ends = np.append(starts[1:], len(symbols))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def features(text: bytes) -> np.ndarray:
    """Names of the phrases of ``LEVELS``; a text too short for a level counts as one phrase of it."""
    level, out = np.frombuffer(text, np.uint8), []
    for depth in range(1, max(LEVELS) + 1):
        level = phrase_names(level, phrase_starts(level))
        if depth in LEVELS:
            out.append(mix(level + np.uint64(depth)))
    return np.concatenate(out)


def sketch(text: str, k: int) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    return np.unique((features(text.encode()) >> np.uint64(32)).astype(np.uint32))[:k]


def to_hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, k: int) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the row whose next is awaited
        for b in batches:
            out: list[tuple] = []
            for part, doc, text, guest in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text", "guest")), strict=True):
                text = text or ""
                print_ = sketch(text, k)
                if before and before[0] == part:
                    _, own_doc, own, own_print = before
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_print = sketch(edited, k)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((None if own_doc == _NO_ID else own_doc, len(own), digest, to_hex(own_print), to_hex(edited_print), likeness(own_print, edited_print, k), likeness(own_print, print_, k)))
                before = None if guest else (part, doc, text, print_)
            if out:
                names = [x.split()[0] for x in _OUT.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield batch({n: (list(v), t) for n, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return run


def fingerprints(docs: DataFrame, k: int = 64, part_rows: int = 1000) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness; see the module for the columns.

    The next document stands in descending doc_id, the first after the last. Documents are dealt to ranges of ids
    whose borders are ids that occur; the document at a border also goes, as a guest, to the range before, so every
    document meets its next in its own range, with one shuffle of the texts.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("hi")).first()
    parts = min(50_000, max(1, size.n // part_rows))
    borders = docs.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts)], 100 * parts).alias("q")).first().q or []
    borders = np.array(sorted({*borders, size.hi} - {None}), np.int64)
    # The part of an id is the number of borders from it on, less one; there are at most 50,000 borders.
    place = docs.sparkSession.sparkContext.broadcast(borders)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = place.value
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            part = len(edges) - 1 - np.searchsorted(edges, ids)
            guest = np.flatnonzero(np.isin(ids, edges))  # the first of its part, so the next of the last before
            index = np.append(np.arange(len(ids)), guest)
            home = np.append(part, (part[guest] - 1) % len(edges))
            columns = [pa.array(home, pa.int64()), pa.array(np.arange(len(index)) >= len(ids)), *(b.column(c).take(pa.array(index)) for c in ("doc_id", "text"))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "guest", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "part long, guest boolean, doc_id long, text string").repartition("part")
    return dealt.sortWithinPartitions("part", "guest", F.desc("doc_id"), "text").mapInArrow(_compare(k), _OUT)
