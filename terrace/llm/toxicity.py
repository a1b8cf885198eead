"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index of all their terms.

Fit. Labels are read only for rows whose crc32(doc_id as text) mod ``folds`` is not 0. Of each class at most
``max_examples`` labelled documents (chosen by a hash of doc_id) become examples. Terms are words folded to lower
case, without punctuation at their ends; every term of an example is in the vocabulary. Document frequencies of the
vocabulary are counted over all documents. So the index is bounded by the examples' texts.

Weights. A text's vector has (1 + log tf) * idf * relevance for each of its terms that some example has. Relevance is
supervised term weighting (Debole and Sebastiani, 2003): the log-likelihood ratio statistic of the term's document
frequencies in the two classes of examples, plus one, so that no term is left out. Without it
the cosine of texts of some hundred words follows their topic, whatever the label.

Index. Postings by term, examples dealt to blocks of ``BLOCK`` in the order of their heaviest term; the greatest weight
of each term in each block bounds what an example of the block can score. The blocks with the largest bounds are scored
first; then those whose bound reaches the k-th best score. So the ``k`` nearest are exact (ties to the smaller id).

Vote. The nearest vote with weights 1 / (1 - cosine + 0.05), corrected for the classes' sampling rates. Scores are an
isotonic fit on the votes of the examples, each with itself left out, which tasks compute. If some of the nearest have a
cosine of ``SAME`` or more, which makes the text a copy of them, the share of toxic ones among these is the score. A
text without terms of the examples gets the share of toxic ones among examples without terms, else 0.

Defined cases: null text is empty; labels with null doc_id or toxic are ignored, of repeated labels the highest counts;
labels of one class only, or none, give every text the score 0; repeated rows are scored alike, null ids too (held_out
is null then); an empty table gives an empty one; long texts are one vector each; ``carry`` leaves out columns named
like those of the result; lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, cut_few, utf8, worker_state

#: Examples in a block, and blocks that are scored before bounds are compared.
BLOCK, FIRST = 64, 1
#: The cosine from which a text counts as a copy of an example.
SAME = 0.95
_EDGE = b".,;:!?\"'()[]{}<>"


def terms_of(text: bytes) -> list[bytes]:
    return [t for w in text.lower().split() if (t := w.strip(_EDGE))]


# --- index -------------------------------------------------------------------------------------------


def _unit(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return terms, weights / math.sqrt((weights * weights).sum())


class Index:
    """Unit vectors of examples, none of them empty: postings by term, and per block the greatest weight of each term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(vectors)
        vectors = [_unit(*v) for v in vectors]
        # neighbours in this order share their heaviest term, which keeps the bounds of a block close
        heaviest = [(int(t[w.argmax()]), i) for i, (t, w) in enumerate(vectors)]
        self.order = np.array([i for _, i in sorted(heaviest)], np.int64)
        terms = np.concatenate([vectors[i][0] for i in self.order]) if self.n else np.zeros(0, np.int64)
        weights = np.concatenate([vectors[i][1] for i in self.order]) if self.n else np.zeros(0)
        who = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in self.order])
        by_term = np.argsort(terms, kind="stable")
        self.terms, self.who, self.weights = terms[by_term], who[by_term].astype(np.int32), weights[by_term]
        self.size = int(self.terms[-1]) + 1 if len(terms) else 0
        self.blocks = -(-self.n // BLOCK)
        self._made: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(where each term's postings of each block begin, the greatest weight among them, rounded up)."""
        if self._made is None:
            cell = self.terms * self.blocks + self.who // BLOCK  # ascending, for so are the examples of a term
            starts = np.zeros(self.size * self.blocks + 1, np.int32)
            found, count = np.unique(cell, return_counts=True)
            starts[found + 1] = count
            np.cumsum(starts, out=starts)
            most = np.zeros(self.size * self.blocks, np.float32)
            full = np.flatnonzero(starts[1:] > starts[:-1])
            if len(full):
                most[full] = np.nextafter(np.maximum.reduceat(self.weights, starts[full]).astype(np.float32), np.float32(2))
            self._made = starts, most.reshape(self.size, self.blocks)
        return self._made

    def _scores(self, score: np.ndarray, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> None:
        """Add the scores of all examples of some blocks."""
        starts = self.lists()[0]
        cells = (terms[:, None] * self.blocks + blocks).ravel()
        lo = starts[cells].astype(np.int64)
        n = starts[cells + 1] - lo
        full = np.flatnonzero(n)
        lo, n = lo[full], n[full]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        score += np.bincount(self.who[at], self.weights[at] * np.repeat(np.repeat(q, len(blocks))[full], n), self.n)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest that share a term, best first."""
        terms, q = vector
        if not len(terms) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, q = _unit(terms, q)
        bounds = q.astype(np.float32) @ self.lists()[1][terms] * np.float32(1.0001)
        order = np.argsort(-bounds, kind="stable")
        score = np.zeros(self.n)
        hidden = np.flatnonzero(self.order == without)
        first, rest = order[: FIRST + k // BLOCK], order[FIRST + k // BLOCK :]
        self._scores(score, terms, q, first)
        score[hidden] = 0
        if len(rest):
            least = np.partition(score, self.n - k)[self.n - k] if self.n > k else 0.0
            rest = rest[(bounds[rest] >= least) & (bounds[rest] > 0)]
            if len(rest):
                self._scores(score, terms, q, rest)
                score[hidden] = 0
        found = np.flatnonzero(score > 0)
        cosine = np.round(score[found], 12)
        if len(found) > k:
            near = cosine >= np.partition(cosine, len(found) - k)[len(found) - k]
            found, cosine = found[near], cosine[near]
        found = self.order[found]
        best = np.lexsort((found, -cosine))[:k]
        return found[best], cosine[best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, mean y) of a non-decreasing step fit."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][0] == xi:
            pools[-1][1] += yi * wi
            pools[-1][2] += wi
        else:
            pools.append([xi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Everything a task needs, bounded by the texts of 2 * max_examples examples."""

    def __init__(self, vocabulary: dict[bytes, int], weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], stands: tuple[float, float], k: int):
        self.vocabulary, self.weight, self.k = vocabulary, weight, k
        self.stands = np.array(stands)  # how many labelled rows an example of a class stands for
        held = [(i, y, self.weigh(terms, tf)) for i, y, terms, tf in examples]
        known = [x for x in held if len(x[2][0])]
        self.ids, self.toxic = [i for i, _, _ in known], np.array([y for _, y, _ in known], np.int64)
        self.index = Index([v for _, _, v in known])
        rest = np.bincount([y for _, y, v in held if not len(v[0])], minlength=2) * self.stands
        self.without_terms = float(rest[1] / rest.sum()) if rest.sum() else 0.0
        self.knots = np.zeros(1), np.zeros(1)

    def weigh(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(tf)) * self.weight[terms]
        return terms[weight > 0], weight[weight > 0]

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocabulary.get
        found = np.array([t for w in terms_of(text) if (t := get(w)) is not None], np.int64)
        return self.weigh(*np.unique(found, return_counts=True))

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        y = self.toxic[who]
        weight = self.stands[y] / (1.05 - cosine)
        return float(round((weight * y).sum() / weight.sum(), 9)) if len(who) else 0.0

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        self.knots = isotonic(votes, toxic.astype(np.float64), self.stands[toxic])

    def score(self, text: bytes) -> tuple[float, list[dict]]:
        who, cosine = self.index.nearest(self.vector(text), self.k)
        if not len(who):
            return self.without_terms, []
        x, y = self.knots
        p = float(y[max(0, int(np.searchsorted(x, self.vote(who, cosine), "right")) - 1)])
        toxic = self.toxic[who]
        if (same := cosine >= SAME).any():
            p = float(toxic[same].mean())
        return p, [{"doc_id": self.ids[i], "similarity": float(c), "toxic": int(t)} for i, c, t in zip(who.tolist(), cosine.tolist(), toxic.tolist(), strict=True)]


def of_worker(shipped) -> Model:
    """The model of a broadcast, unpacked once in a worker."""
    name, data = shipped.value
    state = worker_state("toxicity")
    if state.get("name") != name:
        state.update(name=name, model=pickle.loads(data))
    return state["model"]


def ship(spark, model: Model):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, cloudpickle.dumps(model)))


# --- fit ---------------------------------------------------------------------------------------------


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each example and how often it has them."""
    for b in batches:
        found = [Counter(terms_of(text)) for text in utf8(b.column("text"))]
        terms, tf = [sorted(c) for c in found], [[c[t] for t in sorted(c)] for c in found]
        yield batch({"doc_id": (b.column("doc_id"), pa.int64()), "toxic": (b.column("toxic"), pa.int32()), "terms": (terms, pa.list_(pa.binary())), "tf": (tf, pa.list_(pa.int32()))})


def _frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        count, n, get = np.zeros(len(place) + 1, np.int64), 0, place.get
        for b in batches:
            for text in utf8(b.column("text")):
                n += 1
                found = {get(w) for w in set(terms_of(text))}
                found.discard(None)
                count[list(found)] += 1
        count[-1] = n
        seen = np.flatnonzero(count)
        yield batch({"term": (seen, pa.int32()), "df": (count[seen], pa.int64())})

    return run


def _own_votes(shipped):
    """The vote on each example, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = of_worker(shipped)
        place = {i: p for p, i in enumerate(model.ids)}
        for b in batches:
            toxic, votes = [], []
            for i, y, terms, tf in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "terms", "tf")), strict=True):
                if i in place:
                    codes = np.array([model.vocabulary[t] for t in terms], np.int64)
                    codes, tf = codes[order := np.argsort(codes)], np.array(tf)[order]
                    toxic.append(y)
                    votes.append(model.vote(*model.index.nearest(model.weigh(codes, tf), model.k, without=place[i])))
            yield batch({"toxic": (toxic, pa.int32()), "vote": (votes, pa.float64())})

    return run


def relevance(terms: np.ndarray, of_toxic: np.ndarray, toxic: list[int], size: int) -> np.ndarray:
    """One more than the log-likelihood ratio statistic of each term's document frequencies in the two classes of examples."""
    found = [np.bincount(terms[of_toxic == y], minlength=size) for y in (1, 0)]
    ratio = np.zeros(size)
    for x, part in zip(found, (sum(toxic), len(toxic) - sum(toxic)), strict=True):
        some = x > 0
        ratio[some] += x[some] * np.log(x[some] * len(toxic) / ((found[0] + found[1])[some] * part))
    return 1 + np.maximum(0, 2 * ratio)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_examples: int = 1000, k: int = 9) -> Model:
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0) & F.col("toxic").isin(0, 1))
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not all(sizes.get(y, 0) for y in (0, 1)):
        return Model({}, np.zeros(0), [], (1.0, 1.0), k)
    chosen = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * max_examples rows
    examples = docs.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")
    examples = cut_few(examples.mapInArrow(_terms, "doc_id long, toxic int, terms array<binary>, tf array<int>"))
    # distinct terms of the examples, as Arrow columns; the driver holds them once
    held = examples.toArrow().sort_by("doc_id").combine_chunks()
    coded = pc.list_flatten(held.column("terms")).combine_chunks()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    vocabulary = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
    terms, tf = coded.indices.to_numpy().astype(np.int64), pc.list_flatten(held.column("tf")).to_numpy()
    lengths = pc.list_value_length(held.column("terms")).to_numpy()
    counted = docs.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    toxic = held.column("toxic").to_pylist()
    weight = np.log((1 + df[-1]) / (1 + df[:-1])) * relevance(terms, np.repeat(np.array(toxic, np.int64), lengths), toxic, len(vocabulary))
    made = []
    for i, y, t, n in zip(held.column("doc_id").to_pylist(), toxic, np.split(terms, np.cumsum(lengths)[:-1]), np.split(tf, np.cumsum(lengths)[:-1]), strict=True) if toxic else []:
        order = np.argsort(t)
        made.append((i, y, t[order], n[order]))
    n = [toxic.count(y) or 1 for y in (0, 1)]
    model = Model(vocabulary, weight, made, (sizes[0] / n[0], sizes[1] / n[1]), k)
    votes = examples.repartition(16, "doc_id").mapInArrow(_own_votes(ship(spark, model)), "toxic int, vote double").toArrow()  # two numbers for each example
    if votes.num_rows:
        model.calibrate(votes.column("vote").to_numpy(), votes.column("toxic").to_numpy().astype(np.int64))
    return model


# --- operator ----------------------------------------------------------------------------------------

_OUT = "doc_id long, held_out boolean, score double, predicted int"


def _score(shipped, folds: int, with_evidence: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = of_worker(shipped)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = [model.score(x) for x in utf8(b.column("text"))]
            p = [s for s, _ in found]
            held = [None if i is None else zlib.crc32(str(i).encode()) % folds == 0 for i in ids]
            columns = {"doc_id": (ids, pa.int64()), "held_out": (held, pa.bool_()), "score": (p, pa.float64()), "predicted": ([int(x >= 0.5) for x in p], pa.int32())}
            if with_evidence:
                columns["evidence"] = ([e for _, e in found], pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])))
            yield batch({c: (b.column(c), b.column(c).type) for c in carry} | columns)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, with_evidence: bool = False, carry: list[str] | None = None, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted[, evidence]) of ``docs(doc_id, text)``, and the columns of ``carry`` as they are."""
    schema = T._parse_datatype_string(_OUT + ", evidence array<struct<doc_id long, similarity double, toxic int>>" * with_evidence)
    also = [c for c in dict.fromkeys(carry or []) if c not in schema.names]
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).select("doc_id", "text", *(c for c in also if c != "text"))
    shipped = ship(docs.sparkSession, fit(docs.select("doc_id", "text"), labels, folds, **fitting))
    schema = T.StructType([*(docs.schema[c] for c in also), *schema.fields])
    return docs.mapInArrow(_score(shipped, folds, with_evidence, also), schema)
