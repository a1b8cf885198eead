"""Exact removal of repeated long substrings by names of sparse positions, in place of prefix doubling.

Every byte of a text that lies in a ``length``-byte string which also starts earlier (smaller doc_id, or the
same document at an earlier byte) is removed; strings are judged on the input and never cross documents.

Method. Modelled on prefix doubling, but no rank comes from ranks of the round before: positions are grouped by the
name of a prefix, positions that are alone leave, and the survivors are named again by longer strings, in three fixed
rounds. Only equality of ranks matters here, so a rank is a 64-bit name, computed from the text by a rolling hash,
instead of an ordinal. Rounds 2 and 3 do not spread a hot core. The table of positions stays far below one row per byte:

* *Round 0* ranks ``seed``-byte prefixes of anchors only. In every window of ``length`` bytes the anchor is the
  rightmost smallest seed name, so equal windows have equal anchors at equal offsets, and a window whose
  anchor's rank is unique is itself unique. About one position in ``(length - seed) / 2`` is an anchor.
* *Round 1* ranks *spans*, the runs of windows with the same anchor. Of spans with equal content all but the first
  are removed whole. Where one anchor rank has several span ranks (the ends of a repeated passage, an edited
  word), the first span of each rank goes on.
* *Round 2* ranks blocks of ``STEP`` windows at equal offsets from the anchor, twice: by all their bytes (equal to
  an earlier block: all windows go) and by the bytes that all their windows share (unique: none goes).
* *Round 3* ranks the windows of what is left, by pairs (rank of length/2 at p, rank at p + length/2).

A task ranks the rows it has read before they are shuffled: of equal spans it sends only the first, so a passage
that a third of all documents hold costs a row per task. An anchor with many span ranks in one task sends them by
span rank, plus one row that tells the anchor's own group of them.

Defined cases: null text is empty; a text under ``length`` bytes keeps all; a long text is one row of its own positions;
a repeated row is the same document, not an earlier one, so both get the same result; different texts under one doc_id are
documents of their own, in the order of a hash of their text; documents with a null doc_id come after the others, in that
order too; ties between equal strings go to the smaller doc_id, then that order, then the start; an empty table gives an
empty one; extra columns are ignored, also where they have names that are used here; a column to carry that has the name of
a result is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Names, batch, cut, cut_few, mix, utf8
from .merkle import numbered

SEED = 32

#: Windows in a block of round 2.
STEP = 8
#: Span ranks of one anchor in a task above which they are sent by span rank.
SPREAD = 64
#: Rows that a task ranks at a time before it sends them.
HOLD = 1_500_000

# Rows between rounds. key: where they meet; rank: equal content; core: round 2, content that all windows share;
# id, start: the position; shape: n * length + (anchor - first window). kind: what is known.
_ROW = "kind byte, key long, rank long, core long, id long, start int, shape int"
SEND, GONE, OPEN, MARK = 0, 1, 2, 3


def position_id(doc_id: int | None, text: bytes) -> int:
    """The id that orders a document; one without doc_id comes after those below 2**62, by a hash of its text."""
    return (1 << 62) + (xxhash.xxh64_intdigest(text) >> 2) if doc_id is None else doc_id


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def spans(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...] | None:
    """(anchor name, span name, first window, number of windows, anchor) of each span of one text."""
    if len(data) < length:
        return None
    names = Names(data)
    grams = names.all_of(seed)
    w = length - seed + 1
    low = sliding_min(grams, w)
    enters = grams[w - 1 :] == low
    turn = enters.copy()
    turn[0] = True
    turn[1:] |= low[1:] != low[:-1]
    first = np.flatnonzero(turn)
    anchor = first + w - 1
    old = np.flatnonzero(~enters[first])
    for at in range(0, len(old), 1 << 14):
        part = old[at : at + (1 << 14)]
        begin = first[part]
        hit = grams[begin[:, None] + np.arange(w - 1, -1, -1)] == low[begin][:, None]
        anchor[part] = begin + w - 1 - hit.argmax(1)
    count = np.diff(first, append=len(low))
    content = names.between(first, first + count - 1 + length)
    content ^= (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return grams[anchor], content, first, count, anchor


class Rows:
    """Columns of positions, one numpy array each."""

    names = ("kind", "key", "rank", "core", "id", "start", "shape")

    def __init__(self, **columns):
        n = len(columns["id"])
        zero = np.zeros(n, np.int64)
        self.of = {c: np.asarray(columns.get(c, zero)) for c in self.names}
        for c in ("key", "rank", "core"):
            self.of[c] = self.of[c].view(np.int64) if self.of[c].dtype == np.uint64 else self.of[c]

    def __len__(self) -> int:
        return len(self.of["id"])

    def take(self, index: np.ndarray, **change) -> Rows:
        return Rows(**({c: v[index] for c, v in self.of.items()} | {c: np.full(len(self.of["id"][index]), v) for c, v in change.items()}))

    @staticmethod
    def join(parts: list[Rows]) -> Rows:
        return Rows(**{c: np.concatenate([p.of[c] for p in parts]) for c in Rows.names})

    @staticmethod
    def read(batches: list[pa.RecordBatch]) -> Rows:
        return Rows(**{c: np.concatenate([b.column(c).to_numpy() for b in batches]) for c in Rows.names})

    def to_batch(self) -> pa.RecordBatch:
        kinds = (pa.int8(), *[pa.int64()] * 4, pa.int32(), pa.int32())
        return batch({c: (self.of[c].astype(t.to_pandas_dtype()), t) for c, t in zip(self.names, kinds, strict=True)})

    def first_of_rank(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order by key, core, rank, id, start; is the first of its rank; stands after it)."""
        o = np.lexsort([self.of[c] for c in ("start", "id", "rank", "core", "key")])
        new = np.ones(len(o), bool)
        new[1:] = False
        for c in ("key", "core", "rank"):
            v = self.of[c][o]
            new[1:] |= v[1:] != v[:-1]
        first = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else o
        later = (self.of["id"][o] != self.of["id"][first]) | (self.of["start"][o] != self.of["start"][first])
        return o, new, later  # a repeated row is neither


def _starts(values: np.ndarray) -> np.ndarray:
    return np.append(True, values[1:] != values[:-1])


def gone_runs(rows: Rows, length: int) -> Rows:
    """Removed windows as maximal runs of windows per document."""
    if not len(rows):
        return rows
    o = np.lexsort([rows.of["start"], rows.of["id"]])
    ids, start = rows.of["id"][o], rows.of["start"][o].astype(np.int64)
    end = start + rows.of["shape"][o] // length
    doc = np.cumsum(_starts(ids)) - 1
    reach = np.maximum.accumulate(end + doc * (1 << 32)) - doc * (1 << 32)
    new = _starts(ids)
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    zero = np.zeros(len(first), np.int64)
    return Rows(kind=zero + GONE, key=mix((ids[first] + zero).view(np.uint64)), id=ids[first], start=start[first], shape=(reach[last] - start[first]) * length)


def ranked_in_task(rows: Rows, length: int, spread: bool) -> pa.RecordBatch:
    """What a task sends of the rows it has read: the first of each rank, and runs that are gone already."""
    o, first, later = rows.first_of_rank()
    sent = rows.take(o[first])
    out = [gone_runs(rows.take(o[later]), length)]
    if spread and len(sent):
        new = np.flatnonzero(_starts(sent.of["key"]))
        many = np.diff(new, append=len(sent)) > SPREAD
        if many.any():
            wide = np.repeat(many, np.diff(new, append=len(sent)))
            out.append(sent.take(new[many], kind=MARK))
            sent.of["kind"] = np.where(wide, OPEN, sent.of["kind"])
            sent.of["key"] = np.where(wide, mix((sent.of["key"] ^ sent.of["rank"]).view(np.uint64)).view(np.int64), sent.of["key"])
    return Rows.join([sent, *out]).to_batch()


def _held(parts: Iterator[Rows], length: int, spread: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows in parts:
        held.append(rows)
        size += len(rows)
        if size >= HOLD:
            yield ranked_in_task(Rows.join(held), length, spread)
            held, size = [], 0
    if held:
        yield ranked_in_task(Rows.join(held), length, spread)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for i, x in zip(b.column("id").to_pylist(), b.column("packed").to_pylist(), strict=True):
        yield i, np.frombuffer(unpack(x), np.uint8)


def _emit_spans(length: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for b in batches:
            for doc, place, text in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), utf8(b.column("text")), strict=True):
                found = spans(np.frombuffer(text, np.uint8), length, seed)
                if found is not None:
                    grp, span, first, count, anchor = found
                    yield Rows(key=grp, rank=span, id=np.full(len(grp), position_id(doc, text) if place is None else place, np.int64), start=first, shape=count * length + anchor - first)

    return lambda batches: _held(rows(batches), length, True)


def _resolve_spans(length: int):
    """Round 1 on the rows of a partition of anchor ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = Rows.read(batches)
        kind = rows.of["kind"]
        out = [rows.take(kind == GONE)]
        marked = rows.take(kind == MARK)
        rows = rows.take((kind == SEND) | (kind == OPEN))
        o, first, later = rows.first_of_rank()
        out.append(gone_runs(rows.take(o[later]), length))
        lead = rows.take(o[first])
        new = _starts(lead.of["key"]) if len(lead) else np.zeros(0, bool)
        size = np.diff(np.flatnonzero(new), append=len(lead))
        several = np.repeat(size, size) > 1
        several |= np.isin(lead.of["key"], marked.of["key"]) | (lead.of["kind"] == OPEN)
        out.append(lead.take(several, kind=OPEN))
        yield Rows.join(out).to_batch()

    return run


def _emit_blocks(length: int):
    """Round 2: the blocks of spans that are still open."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for b in batches:
            for (doc, data), todo in zip(_texts(b), b.column("todo"), strict=True):
                start, shape = (todo.values.field(c).to_numpy().astype(np.int64) for c in ("start", "shape"))
                n, off = shape // length, shape % length
                names, anchor = Names(data), start + off
                low, high = (off - n + 1) // STEP, off // STEP
                which = np.concatenate([np.arange(a, z + 1) for a, z in zip(low, high, strict=True)])
                anchor = np.repeat(anchor, high - low + 1)
                p = anchor - STEP * which - STEP + 1
                inside = (p >= 0) & (p + STEP - 1 + length <= len(data))
                core = names.between(p + STEP - 1, p + length) ^ mix(which.astype(np.uint64))
                # a block that sticks out of the text equals no other as a whole, but may share its core
                own = mix(p.astype(np.uint64) + np.uint64(doc % 2**64))
                rank = np.where(inside, names.between(np.maximum(p, 0), np.minimum(p + STEP - 1 + length, len(data))), own)
                yield Rows(key=core, core=core, rank=rank, id=np.full(len(p), doc, np.int64), start=p, shape=np.full(len(p), STEP * length))

    return lambda batches: _held(rows(batches), length, False)


def _emit_windows(length: int):
    """Round 3: windows of open blocks by pairs of ranks."""
    half = length // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for b in batches:
            for (doc, data), todo in zip(_texts(b), b.column("todo"), strict=True):
                start, shape = (todo.values.field(c).to_numpy().astype(np.int64) for c in ("start", "shape"))
                names = Names(data)
                at = np.unique(np.concatenate([np.arange(s, s + k) for s, k in zip(start, shape // length, strict=True)]))
                at = at[(at >= 0) & (at + length <= len(data))]
                left, right = names.between(at, at + half), names.between(at + half, at + length)
                yield Rows(key=left, rank=right, id=np.full(len(at), doc, np.int64), start=at, shape=np.full(len(at), length))

    return lambda batches: _held(rows(batches), length, False)


def _resolve_last(length: int):
    """What is gone in a partition of the last round: all but the first of each pair of ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            rows = Rows.read(batches)
            sent = rows.take(rows.of["kind"] == SEND)
            o, first, later = sent.first_of_rank()
            yield Rows.join([rows.take(rows.of["kind"] == GONE), gone_runs(sent.take(o[later]), length)]).to_batch()

    return run


def _resolve_blocks(length: int):
    """Equal blocks go but for the first; blocks whose core another content shares stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = Rows.read(batches)
        kind = rows.of["kind"]
        out = [rows.take((kind == GONE) | (kind == OPEN))]
        rows = rows.take(kind == SEND)
        o, first, later = rows.first_of_rank()
        out.append(gone_runs(rows.take(o[later]), length))
        lead = rows.take(o[first])
        if len(lead):
            size = np.diff(np.flatnonzero(_starts(lead.of["key"])), append=len(lead))
            out.append(lead.take(np.repeat(size, size) > 1, kind=OPEN))
        yield Rows.join(out).to_batch()

    return run


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        texts = utf8(b.column("text"))
        ids = [position_id(i, x) if p is None else p for i, p, x in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), texts, strict=True)]
        also = {c: (b.column(c), b.column(c).type) for c in b.schema.names if c not in ("text", "place")}
        yield batch({"id": (ids, pa.int64()), "packed": ([pack(x) for x in texts], pa.binary())} | also)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ascending runs; touching intervals join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _apply(length: int, with_text: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ids, n_bytes, removed, runs, digest, texts = [], [], [], [], [], []
            for i, packed, todo in zip(b.column("doc_id").to_pylist(), b.column("packed").to_pylist(), b.column("todo").to_pylist(), strict=True):
                kept = text = unpack(packed)
                gone = count = 0
                if todo:
                    start = np.array([x["start"] for x in todo], np.int64)
                    lo, hi = covered(start, start + np.array([x["shape"] for x in todo], np.int64) // length - 1 + length)
                    gone, count = int((hi - lo).sum()), len(lo)
                    edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                ids.append(i)
                n_bytes.append(len(text))
                removed.append(gone)
                runs.append(count)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            out = {"doc_id": (ids, pa.int64()), "n_bytes": (n_bytes, pa.int64()), "n_removed": (removed, pa.int64()), "n_spans": (runs, pa.int64()), "kept_sha256": (digest, pa.string())}
            out = {c: (b.column(c), b.column(c).type) for c in carry} | out
            yield batch(out | ({"kept_text": (texts, pa.string())} if with_text else {}))

    return run


def _todo(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.collect_list(F.struct("start", "shape")).alias("todo"))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``, the number of a document in the order of ids and texts, where some doc_id has different texts.

    Where none has, ids order documents as they are, and place is null. Only ids and hashes of texts are compared.
    """
    known = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    clash = known.where("doc_id is not null").distinct().groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not clash:
        return docs.withColumn("place", F.lit(None).cast("long"))
    pairs = known.distinct().select(F.lit("").alias("tree"), F.isnull("doc_id").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "_text", F.lit("").alias("digest"))
    places = cut(numbered(pairs, ["_none", "_id", "_text"]).select("_none", "_id", "_text", F.col("at").alias("place")))
    keyed = docs.withColumns({"_none": F.isnull("doc_id"), "_id": F.coalesce("doc_id", F.lit(0)), "_text": F.xxhash64(F.coalesce("text", F.lit("")))})
    return cut(keyed.join(places, ["_none", "_id", "_text"]).drop("_none", "_id", "_text"))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 100, seed: int = SEED, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]), and the columns of ``carry`` as they are.

    kept_text drops characters that a removed run cuts in two.
    """
    result = T._parse_datatype_string(_RESULT + ", kept_text string" * with_text)
    # carried columns go by names of their own on the way
    also = {f"_carried{i}": c for i, c in enumerate(c for c in carry or [] if c not in (*result.names, "text"))}
    docs = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for n, c in also.items()]))
    # The packed texts are shuffled once, by id; the three joins below share that exchange.
    fields = [f for f in docs.schema.fields if f.name in also]
    texts = docs.mapInArrow(_pack_texts, T.StructType([T.StructField("id", T.LongType(), False), T.StructField("packed", T.BinaryType(), False), T.StructField("doc_id", T.LongType()), *fields]))
    docs = docs.select("doc_id", "text", "place")
    spans_ = docs.mapInArrow(_emit_spans(length, seed), _ROW).repartition("key").mapInArrow(_resolve_spans(length), _ROW)
    spans_ = cut_few(spans_.select("kind", "id", "start", "shape"))
    blocks = texts.join(_todo(spans_.where(F.col("kind") == OPEN)), "id").mapInArrow(_emit_blocks(length), _ROW)
    blocks = cut_few(blocks.repartition("key").mapInArrow(_resolve_blocks(length), _ROW).select("kind", "id", "start", "shape"))
    windows = texts.join(_todo(blocks.where(F.col("kind") == OPEN)), "id").mapInArrow(_emit_windows(length), _ROW)
    windows = windows.repartition("key").mapInArrow(_resolve_last(length), _ROW).select("kind", "id", "start", "shape")
    gone = _todo(spans_.union(blocks).where(F.col("kind") == GONE).union(windows))
    out = texts.join(gone, "id", "left").mapInArrow(_apply(length, with_text, list(also)), T.StructType([*fields, *result.fields]))
    return out.withColumnsRenamed(also)
