"""Best-fit packing of token sequences by the sum-of-squares rule.

A document becomes its token ids and one end token; only documents longer than a sequence are cut, into whole
sequences, with a shorter first piece. Whole pieces fill a sequence alone. The rest are packed by the
sum-of-squares rule (Csirik et al., 2006): with N(g) open sequences of gap g, a piece goes where the sum of
N(g)**2 becomes smallest, ties to the smallest gap. Pieces come in descending length.

Packing needs lengths only, so ids never move: tokenising yields one short row per piece, pieces are dealt to
groups of about ``group_pieces`` by a hash of their document, and each group is packed in one task. A group's
size is bounded, so its open sequences at the end are a fixed share of the total, whatever the input size.

Defined cases: null or empty text gives one piece that holds the end token; null and repeated doc_ids are packed like
others, a row's pieces for each row; ties in length go by doc_id, piece and content; long texts are cut into sequences;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import batch, cut

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc_ids, piece, start, length, crc = [], [], [], [], []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc_ids.append(doc)
                    piece.append(i)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
            yield batch({"doc_id": (doc_ids, pa.int64()), "piece": (piece, pa.int32()), "start": (start, pa.int64()), "length": (length, pa.int64()), "ids_crc32": (crc, pa.int64())})

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        # change of the sum when a sequence of gap g becomes one of gap g - n; a full one no longer counts
        change = 2 * (count[: capacity + 1 - n] - count[n:] + 1)
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        fresh = 2 * count[capacity - n] + 1 if n < capacity else 0
        if change[best] <= fresh:
            gap = best + n
            s = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, s = capacity, made
            made += 1
        sequence[i], offset[i] = s, capacity - gap
        if gap > n:
            open_by_gap[gap - n].append(s)
            count[gap - n] += 1
    return sequence, offset


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable")
        sequence, offset = sum_of_squares(group.length.to_numpy(), capacity)
        return group.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(_pieces(path, capacity, end_id), _PIECE))
    open_pieces = pieces.where(F.col("length") < capacity)
    groups = max(1, round(open_pieces.count() / group_pieces))
    packed = open_pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(groups)))
    packed = packed.groupBy("grp").applyInPandas(_pack(capacity), _PIECE + ", grp long, sequence_id long, offset long")
    packed = packed.withColumn("sequence_id", F.col("sequence_id") * groups + F.col("grp")).drop("grp")
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)
