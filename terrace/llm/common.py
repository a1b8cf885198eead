"""What the operators of this subpackage share: shared storage, 64-bit rolling names and word splitting.

A *name* is a 64-bit value that stands for a string: equal strings have equal names. Names of all
substrings of one length come from one prefix-sum pass (``Names``), vectorised with numpy inside a task.
"""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-terrace-")
    return _OWN_DIR["dir"]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, read one after the other without a shuffle: at most eight for one, and not under four a core.

    Where many partitions hold little each, a file for each costs more than its rows: a request in any store, and a process
    on executors whose file system sets permissions by a command.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def cut_few(df: DataFrame) -> DataFrame:
    """``cut`` for tables of short rows."""
    return cut(few_files(df))


# --- blocks of documents -----------------------------------------------------------------------------


def _pack(size: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, part = zstandard.ZstdCompressor(level=level).compress, TaskContext.get().partitionId() << 32
        ids, texts, held, made = [], [], 0, 0

        def block() -> pa.RecordBatch:
            lengths = [len(x) for x in texts]
            return batch({"block": ([part + made], pa.int64()), "ids": ([ids], pa.list_(pa.int64())), "sizes": ([lengths], pa.list_(pa.int64())), "packed": ([squeeze(b"".join(texts))], pa.binary())})

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= size:
                    yield block()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield block()

    return run


def document_blocks(docs: DataFrame, size: int, level: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` as a written table of blocks of about ``size`` bytes of text: (block, ids, sizes, packed).

    A block's number is stored with its documents, so every later pass, and every task that is run again after an
    executor is lost, finds the same documents under it, whatever order the input's rows come in. ``level`` is zstd's:
    blocks that are shuffled again are worth a higher one.
    """
    return cut(docs.select("doc_id", "text").mapInArrow(_pack(size, level), "block long, ids array<long>, sizes array<long>, packed binary"))


def block_texts(sizes: list[int], packed: bytes) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum([0, *sizes]).tolist()
    return [raw[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, byte by byte, so that equal high bytes stand together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unplanes(raw: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
    return out.view("<u8").ravel()


def ask(names: np.ndarray, counts: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """Sorted distinct names below 2**(8 * width) with their counts as one compressed value for each range of names."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    shift = np.uint64(8 * width - bits)
    buckets, first = np.unique(names >> shift, return_index=True)
    blobs = []
    for bucket, lo, hi in zip(buckets, first.tolist(), [*first[1:].tolist(), len(names)], strict=True):
        gaps = np.diff(names[lo:hi], prepend=bucket << shift)
        blobs.append(squeeze(np.int64(hi - lo).tobytes() + planes(gaps, width) + planes(counts[lo:hi], 4)))
    return buckets.astype(np.int64), blobs


def answer(blobs: list[bytes], bucket: int, width: int, bits: int, out_width: int) -> list[bytes]:
    """For each value of ``ask`` of one range the totals over all of them, clipped to ``out_width`` bytes."""
    unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    names, counts = [], []
    for blob in blobs:
        raw = unpack(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        names.append(np.cumsum(unplanes(raw, n, width, 8), dtype=np.uint64).astype(np.uint64) + (np.uint64(bucket) << np.uint64(8 * width - bits)))
        counts.append(unplanes(raw, n, 4, 8 + n * width).astype(np.int64))
    ends = np.cumsum([len(x) for x in names])[:-1]
    which = np.unique(np.concatenate(names), return_inverse=True)[1]
    totals = np.minimum(np.bincount(which, np.concatenate(counts)), 2.0 ** (8 * out_width) - 1).astype(np.int64)
    return [squeeze(planes(x, out_width)) for x in np.split(totals[which], ends)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks it runs, until they need one of another name: a
    worker that goes on to another operator keeps nothing of the last one."""
    module = sys.modules.setdefault("_terrace_worker_state", types.ModuleType("_terrace_worker_state"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
    return held.setdefault(name, {})


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null gives empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


# --- names -------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LENGTH = 0xD6E8FEB86659FD93
_SPREAD = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept by the worker."""
    state = worker_state("powers")
    if state.get("n", 0) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            state[key] = np.multiply.accumulate(x)
        state["n"] = size
    return state["up"], state["down"]


class Names:
    """Names of substrings of one byte string."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_SPREAD[data] * up[: self.n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(_LENGTH))

    def all_of(self, length: int) -> np.ndarray:
        """The name at each start 0 .. n - length."""
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m] + np.uint64(length * _LENGTH % 2**64))


# --- words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_names(text: bytes, lower: bool) -> np.ndarray:
    """Names of the words ``[^\\x20\\x09-\\x0D]+`` in order; ``lower`` folds A-Z."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    edge = np.empty(len(data) + 2, bool)
    edge[0] = edge[-1] = True
    np.take(_SPACE, data, out=edge[1:-1])
    flips = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = flips[::2], flips[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    return Names(_LOWER[data] if lower else data).between(start, end)


_ORDER = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_names(words: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-word windows in order."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, k, np.uint64)
    for i in range(k):
        total += words[i : i + m] * _ORDER[i]
    return mix(total)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct names of k-word shingles, words folded to lower case; a shorter text is one shingle."""
    words = word_names(text, True)
    if not len(words):
        return words
    return np.unique(gram_names(words, min(k, len(words))))


# --- connected components ----------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``: the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links stop changing; each
    step is a grouped minimum and an equi-join, so nothing is gathered on the driver and a node with very
    many neighbours is pre-aggregated and then split by the adaptive skew join.
    """
    links = cut_few(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = cut_few(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return roots.union(roots.select(F.col("component").alias("id"), "component").distinct())


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)
