"""Approximate nearest vectors by inverted lists, beside the exact comparison of ``retrieval.dense``.

``fit`` places list centres by spherical k-means on a bounded sample (the ``sample`` rows of least hash); ``build`` deals
every vector to its nearest centre and writes the lists in order, a list of any size over as many files as it needs.
``calibrate`` compares a bounded set of vectors with all others once and returns how many lists must be probed for a stated
recall: few where vectors cluster, many where they do not. ``search`` reads the probed lists only; each task keeps the best
so far of each question, so what is shuffled does not grow with the lists.

Vectors of other lengths than the centres' are an error; null vectors are left out; zero vectors have cosine 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import store
from . import retrieval

#: Vectors that centres are fitted on, and that calibration asks with.
SAMPLE, CALIBRATED = 20_000, 200


def _matrix(column: pa.Array, as_given: bool = False) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return rows if as_given else rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-300)[:, None]


def _sampled(vectors: DataFrame, size: int, seed: int) -> tuple[list, np.ndarray]:
    rows = vectors.select("ord", F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("ord", F.lit(seed)), "ord").limit(size).toArrow()  # bounded
    return rows.column("ord").to_pylist(), _matrix(rows.column("vec").combine_chunks()) if rows.num_rows else np.zeros((0, 0))


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centres from at most ``sample`` of ``vectors(ord, vec)``; by default the root of the rows, at most 4096."""
    vectors = vectors.where("vec is not null")
    _, rows = _sampled(vectors, sample, 1)
    if not len(rows):
        return np.zeros((0, 0))
    wanted = max(1, min(lists or min(4096, round(vectors.count() ** 0.5)), len(rows)))
    centres = rows[:: len(rows) // wanted][:wanted]  # they come in the order of a hash
    for _ in range(rounds):
        at = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


@dataclass
class Lists:
    """Unit centres, and the written vectors (list, ord, vec)."""

    centres: np.ndarray
    vectors: DataFrame


def build(vectors: DataFrame, centres: np.ndarray) -> Lists:
    kind = vectors.schema["ord"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _matrix(b.column("vec"))
                flat = pa.array(unit.ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, unit.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array((unit @ centres.T).argmax(1), pa.int32()), b.column("ord"), vec], ["list", "ord", "vec"])

    rows = vectors.where("vec is not null").select("ord", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"list int, ord {kind.simpleString()}, vec array<double>")
    # by list and, within a list, by a hash: neighbours in a list stand together, and a large list is split
    keys = ("list", F.xxhash64("ord"))
    return Lists(centres, store.written(rows.repartitionByRange(*keys).sortWithinPartitions("list"), "lists"))


def _probing(index: Lists, ids: list, unit: np.ndarray, probes: int, k: int, q_kind, with_list: bool = False, as_given: bool = False):
    order = np.argsort(-(unit @ index.centres.T), axis=1, kind="stable")
    chosen = np.zeros((len(ids), len(index.centres)), bool)
    np.put_along_axis(chosen, order[:, :probes], True, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        kind = None
        for b in batches:
            at, rows, kind = b.column("list").to_numpy(), _matrix(b.column("vec"), as_given) if b.num_rows else None, b.column("ord").type
            ords = b.column("ord").to_numpy(zero_copy_only=False)
            for one in np.unique(at):
                asking, here = np.flatnonzero(chosen[:, one]), np.flatnonzero(at == one)
                if not len(asking):
                    continue
                cosine = rows[here] @ unit[asking].T
                for j, i in enumerate(asking):
                    c, o, w = np.concatenate([kept[i][0], cosine[:, j]]), np.concatenate([kept[i][1], ords[here]]), np.concatenate([kept[i][2], np.full(len(here), one)])
                    best = np.lexsort((o, -np.round(c, 9)))[:k]
                    kept[i] = (c[best], o[best], w[best])
        total = sum(len(c) for c, _, _ in kept)
        if total:
            q = pa.array(ids, q_kind).take(pa.array(np.repeat(np.arange(n), [len(c) for c, _, _ in kept])))
            columns = [q, pa.array(np.concatenate([o for _, o, _ in kept]), kind), pa.array(np.concatenate([c for c, _, _ in kept]))]
            columns += [pa.array(np.concatenate([w for _, _, w in kept]), pa.int32())] if with_list else []
            yield pa.RecordBatch.from_arrays(columns, ["q", "ord", "cosine", "list"][: len(columns)])

    return run, order, chosen


def calibrate(index: Lists, k: int = 8, recall: float = 0.95, asked: int = CALIBRATED) -> int:
    """The least number of probed lists at which at most ``asked`` of the vectors find this share of their k nearest."""
    if not len(index.centres):
        return 0
    ids, unit = _sampled(index.vectors, asked, 2)
    kind = index.vectors.schema["ord"].dataType
    run, order, _ = _probing(index, ids, unit, len(index.centres), k, to_arrow_type(kind), True)
    found = index.vectors.mapInArrow(run, f"q {kind.simpleString()}, ord {kind.simpleString()}, cosine double, list int")
    best = retrieval.top_k(found.withColumnRenamed("cosine", "score"), k).select("q", "list").collect()  # asked * k rows
    place = {q: np.argsort(order[i]) for i, q in enumerate(ids)}
    needed = np.sort([int(place[r.q][r.list]) + 1 for r in best])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 0


def search(index: Lists, questions: DataFrame, probes: int, k: int = 8, limit_mb: int = 64, as_given: bool = False) -> DataFrame:
    """(q, ord, rank, score): the k nearest of questions(q, vec) in their ``probes`` nearest lists.

    The questions are a stated set; they go to the tasks in blocks of at most ``limit_mb``. ``as_given`` takes vectors as
    they are, so the score is their dot product.
    """
    kind, q_kind = index.vectors.schema["ord"].dataType, questions.schema["q"].dataType
    rows = questions.where("vec is not null").select("q", F.col("vec").cast("array<double>").alias("vec")).toArrow()
    ids = rows.column("q").to_pylist()
    unit = _matrix(rows.column("vec").combine_chunks(), as_given) if ids and len(index.centres) else np.zeros((0, 0))
    step, found = max(1, (limit_mb << 20) // (8 * (unit.shape[1] + len(index.centres)) or 1)), None
    schema = f"q {q_kind.simpleString()}, ord {kind.simpleString()}, cosine double"
    for at in range(0, len(unit), step):
        run, _, chosen = _probing(index, ids[at : at + step], unit[at : at + step], probes, k, to_arrow_type(q_kind), as_given=as_given)
        lists = np.flatnonzero(chosen.any(0)).tolist()
        wanted = index.vectors if len(lists) == len(index.centres) else index.vectors.where(F.col("list").isin(lists))
        part = wanted.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = index.vectors.sparkSession.createDataFrame([], schema)
    return retrieval.top_k(found.withColumnRenamed("cosine", "score"), k)


def exact(vectors: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """(q, ord, rank, score): the k greatest dot products of each question with all ``vectors(ord, vec)``: one list, so each
    batch of vectors is one matrix product with the questions, and nothing but each task's best is shuffled."""
    size = questions.where("vec is not null").agg(F.max(F.size("vec"))).first()[0] or 0
    rows = vectors.where("vec is not null").select(F.lit(0).alias("list"), "ord", F.col("vec").cast("array<double>").alias("vec"))
    return search(Lists(np.ones((1, size)), rows), questions, 1, k, as_given=True)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(questions, wanted, found, recall) of two tables (q, ord): the share of the exact rows that the other has."""
    hits = exact.select("q", "ord").join(approximate.select("q", "ord").withColumn("_hit", F.lit(1)), ["q", "ord"], "left")
    return hits.agg(F.count_distinct("q").alias("questions"), F.count("*").alias("wanted"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.greatest("wanted", F.lit(1)))
