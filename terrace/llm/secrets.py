"""Secret scans: fixed patterns, and spans found by probabilistic automata inferred from labelled credentials.

The fixed patterns give three kinds of spans, which always stay. Their values are also the labelled credentials:
per kind, at most ``max_examples`` distinct values of up to ``max_length`` characters, chosen by a hash, go to the driver
(the two bound the fit; longer values are still found and scored), where ALERGIA (Carrasco and
Oncina, 1994) builds their prefix tree over character classes and merges states whose outcome frequencies are
compatible by Hoeffding's bound. The result is one automaton per kind, of bounded size.

Every run of 12 or more characters ``[A-Za-z0-9+/_=-]`` (dots end it, so host names and sentences are no
candidates) that mixes letters and digits is a candidate. Its score under an automaton is the mean log-likelihood
per character against a background: the pairs of neighbouring classes in all runs of all texts outside base spans,
counted by Spark. An automaton's threshold is the score that all but a share ``miss`` of its own examples reach under
automata learned without them, and at least 0. A candidate is a secret of format ``f_<kind>`` for the automaton that
scores best of those whose threshold it reaches. A run that base spans cover in part is a secret if it
or the parts that they leave, joined, are one; if not, each of these parts is scored by itself.

Defined cases: null text is empty and has no spans; without labelled credentials only base spans are found; null and
repeated doc_ids stay as they are, rows with equal texts have equal spans; an empty table gives an empty one; time is in
proportion to a text's length; ``carry`` leaves out columns named like those of the result. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, cut

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
# One of these is in every match of _ASSIGN, folded to lower case.
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_LENGTH = 12
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of the fixed patterns, by start and kind."""
    out, low = [], text.lower()
    if any(x in low for x in _HINTS):
        out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


# --- automata ----------------------------------------------------------------------------------------

#: Characters of each class and how many there are.
_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/_.=-"}
_CLASS_OF = {c: k for k, chars in _CLASSES.items() for c in chars}
_SPREAD = {k: math.log(len(v)) for k, v in _CLASSES.items()}
_TABLE = str.maketrans(_CLASS_OF)


class Automaton:
    """A probabilistic deterministic automaton: per state the counts of ends and of each class with its target."""

    def __init__(self):
        self.ends: list[int] = [0]
        self.next: list[dict[str, list[int]]] = [{}]  # class -> [count, target]

    def add(self, word: str) -> None:
        state = 0
        for c in word:
            edge = self.next[state].get(c)
            if edge is None:
                self.ends.append(0)
                self.next.append({})
                edge = self.next[state][c] = [0, len(self.ends) - 1]
            edge[0] += 1
            state = edge[1]
        self.ends[state] += 1

    def total(self, state: int) -> int:
        return self.ends[state] + sum(n for n, _ in self.next[state].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if not na or not nb:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb, bound):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                ea, eb = self.next[a].get(c, (0, -1)), self.next[b].get(c, (0, -1))
                if self._differ(ea[0], na, eb[0], nb, bound):
                    return False
                if ea[1] >= 0 and eb[1] >= 0:
                    todo.append((ea[1], eb[1]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add the tree below ``state`` to ``into``."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.ends[into] += self.ends[state]
            for c, (n, target) in self.next[state].items():
                edge = self.next[into].get(c)
                if edge is None:
                    self.next[into][c] = [n, target]
                else:
                    edge[0] += n
                    todo.append((edge[1], target))

    def merge_states(self, alpha: float) -> None:
        """ALERGIA: red states are settled, blue ones hang below them and are merged into a red one or become red."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            blue = sorted(((self.total(t), s, c, t) for s in red for c, (_, t) in self.next[s].items() if t not in red), key=lambda x: (-x[0], x[1], x[2]))
            if not blue:
                break
            _, source, c, state = blue[0]
            home = next((r for r in red if self.compatible(r, state, bound)), None)
            if home is None:
                red.append(state)
            else:
                self.next[source][c][1] = home
                self.fold(home, state)
        place = {s: i for i, s in enumerate(red)}
        self.ends, self.next = [self.ends[s] for s in red], [{c: [n, place[t]] for c, (n, t) in self.next[s].items()} for s in red]

    def logs(self) -> tuple[list[float], list[dict[str, tuple[float, int]]]]:
        """Log-probabilities, smoothed by half a count for each outcome."""
        ends, edges = [], []
        for i, out in enumerate(self.next):
            total = self.total(i) + 0.5 * (len(_CLASSES) + 1)
            ends.append(math.log((self.ends[i] + 0.5) / total))
            edges.append({c: (math.log((out.get(c, (0,))[0] + 0.5) / total) - _SPREAD[c], out[c][1] if c in out else 0) for c in _CLASSES})
        return ends, edges


def learn(words: list[str], alpha: float = 0.05) -> Automaton:
    made = Automaton()
    for w in sorted(words):
        made.add(w.translate(_TABLE))
    made.merge_states(alpha)
    return made


def likelihood(logs: tuple, word: str) -> float:
    """Mean log-likelihood per character."""
    ends, edges = logs
    total, state = 0.0, 0
    for c in word.translate(_TABLE):
        p, state = edges[state][c]
        total += p
    return (total + ends[state]) / len(word)


# --- background --------------------------------------------------------------------------------------

_ORDER = "".join(_CLASSES)
_EDGE = len(_ORDER)
#: The class of each byte; all that no candidate has is an edge.
_CODES = np.full(256, _EDGE, np.uint8)
for _c, _k in _CLASS_OF.items():
    if _c != ".":
        _CODES[ord(_c)] = _ORDER.index(_k)


def pair_counts(text: str, base: list[tuple[int, int, int, str]]) -> np.ndarray:
    """How often each class follows each in the runs outside base spans; runs begin and end with an edge."""
    parts, at = [], 0
    for s, _, e, _ in base:
        parts.append(text[at : max(at, s)])
        at = max(at, e)
    codes = _CODES[np.frombuffer(f" {' '.join([*parts, text[at:]])} ".encode("utf-8", "replace"), np.uint8)].astype(np.int64)
    return np.bincount(codes[:-1] * (_EDGE + 1) + codes[1:], minlength=(_EDGE + 1) ** 2)


class Background:
    """Log-probabilities of a class, or the end, after another, smoothed by ``prior`` evenly dealt characters."""

    def __init__(self, counts: np.ndarray, prior: float = 50.0):
        sizes = np.array([*(len(v) for v in _CLASSES.values()), 0], np.float64)
        counts = counts.reshape(_EDGE + 1, _EDGE + 1).astype(np.float64)
        counts[_EDGE, _EDGE] = 0
        counts += prior * sizes / sizes.sum()
        counts[:_EDGE, _EDGE] += prior / 20
        spread = np.array([*_SPREAD.values(), 0.0])
        with np.errstate(divide="ignore"):
            logs = np.log(counts / counts.sum(1, keepdims=True)) - spread
        names = [*_ORDER, ""]
        self.logs = {a: dict(zip(names, row, strict=True)) for a, row in zip(names, logs.tolist(), strict=True)}

    def likelihood(self, word: str) -> float:
        """Mean log-likelihood per character."""
        total, before = 0.0, ""
        for c in word.translate(_TABLE):
            total += self.logs[before][c]
            before = c
        return (total + self.logs[before][""]) / len(word)


class Model:
    """Per kind its automaton's log-probabilities and the score that its own examples reach."""

    def __init__(self, values: dict[str, list[str]], counts: np.ndarray, alpha: float, miss: float):
        self.background = Background(counts)
        self.logs = {kind: learn(v, alpha).logs() for kind, v in values.items()}
        self.least = {kind: max(0.0, float(np.quantile(self.own_scores(kind, v, alpha), miss, method="lower"))) for kind, v in values.items()}

    def gain(self, logs: tuple, word: str) -> float:
        return likelihood(logs, word) - self.background.likelihood(word)

    def own_scores(self, kind: str, values: list[str], alpha: float) -> list[float]:
        """Scores of examples under the automaton of the other half; of few examples under their own."""
        if len(values) < 20:
            return [self.gain(self.logs[kind], v) for v in values]
        halves = values[::2], values[1::2]
        return [self.gain(logs, v) for half, other in (halves, halves[::-1]) for logs in [learn(other, alpha).logs()] for v in half]

    def kind(self, word: str) -> str | None:
        """The format of a candidate that is a secret."""
        if not (_DIGIT.search(word) and _LETTER.search(word)):
            return None
        found = [(g, kind) for kind, logs in self.logs.items() if (g := self.gain(logs, word)) >= self.least[kind]]
        return max(found)[1] if found else None

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str, int]]:
        """(start, kind, end) of the secrets that base spans do not cover."""
        held: list[list[int]] = []  # what base spans cover, as disjoint runs
        for s, _, e, _ in base:
            if held and s <= held[-1][1]:
                held[-1][1] = max(held[-1][1], e)
            else:
                held.append([s, e])
        first = 0
        for m in _CANDIDATE.finditer(text):
            start, end = m.span()
            while first < len(held) and held[first][1] <= start:
                first += 1
            left, at, i = [], start, first
            while i < len(held) and held[i][0] < end:
                left += [(at, held[i][0])] if held[i][0] > at else []
                at, i = held[i][1], i + 1
            left += [(at, end)] if at < end else []
            if not left:
                continue
            rest = "".join(text[s:e] for s, e in left)
            if kind := self.kind(m[0]) or (len(rest) >= LEAST_LENGTH and self.kind(rest)) or None:
                yield start, kind, end
            elif rest != m[0]:
                for s, e in left:
                    if e - s >= LEAST_LENGTH and (kind := self.kind(text[s:e])):
                        yield s, kind, e


# --- operator ----------------------------------------------------------------------------------------


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base values, and of each batch the pairs of classes (kind -1, value the pair's number)."""
    for b in batches:
        kinds, values, counts = [], [], np.zeros((_EDGE + 1) ** 2, np.int64)
        for text in b.column("text").to_pylist():
            base = base_spans(text or "")
            counts += pair_counts(text or "", base)
            for _, kind, _, value in base:
                kinds.append(kind)
                values.append(value)
        pairs = np.flatnonzero(counts)
        n = [1] * len(kinds) + counts[pairs].tolist()
        yield batch({"kind": (kinds + [-1] * len(pairs), pa.int32()), "value": (values + [str(i) for i in pairs.tolist()], pa.string()), "n": (n, pa.int64())})


def fit(docs: DataFrame, max_examples: int = 400, alpha: float = 0.05, miss: float = 0.02, max_length: int = 200) -> Model:
    """The automata of the kinds that have examples, and the background of all texts; one pass over the texts."""
    found = docs.mapInArrow(_examples, "kind int, value string, n long").where(F.length("value") <= max_length)
    found = cut(found.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    made, counts = {}, np.zeros((_EDGE + 1) ** 2, np.int64)
    for r in found.where("kind = -1").collect():  # at most 49 pairs
        counts[int(r.value)] = r.n
    for k, kind in enumerate(KINDS):
        values = [r.value for r in found.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(max_examples).collect()]
        if values:
            made[kind] = values
    return Model(made, counts, alpha, miss)


def _scan(model: Model, redact: str | None, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, texts = [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(s, k, KINDS[k], e) for s, k, e, _ in base]
                if model.logs:
                    spans += [(s, len(KINDS) + KINDS.index(kind), f"f_{kind}", e) for s, kind, e in model.spans(text, base)]
                    spans.sort()
                counts = [sum(k == i for _, k, _, _ in base) for i in range(len(KINDS))]
                own = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                out.append((*counts, hashlib.sha256(own.encode()).hexdigest(), ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)))
                if redact is not None:
                    parts, at = [], 0
                    for s, _, _, e in spans:
                        if s >= at:
                            parts += [text[at:s], redact]
                        at = max(at, e)
                    texts.append("".join(parts) + text[at:])
            a, c, h, digest, spans_ = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [], [])
            columns = {"doc_id": (b.column("doc_id"), pa.int64()), "n_assign": (a, pa.int64()), "n_access": (c, pa.int64()), "n_hex": (h, pa.int64()), "base_sha256": (digest, pa.string()), "spans": (spans_, pa.string())}
            columns = {c: (b.column(c), b.column(c).type) for c in carry} | columns
            yield batch(columns | ({"clean_text": (texts, pa.string())} if redact is not None else {}))

    return run


def scan(docs: DataFrame, max_examples: int = 400, alpha: float = 0.05, miss: float = 0.02, redact: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans[, clean_text]), and the columns of ``carry`` as they are.

    ``redact`` is put in place of each span in clean_text; of overlapping spans the union is replaced once.
    """
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).select("doc_id", "text", *(c for c in carry or [] if c not in ("doc_id", "text")))
    model = fit(docs.select("text"), max_examples, alpha, miss)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", clean_text string" * (redact is not None)
    schema = T._parse_datatype_string(schema)
    also = [f for f in docs.schema.fields if f.name not in schema.names and f.name in (carry or [])]
    schema = T.StructType([*also, *schema.fields])
    return docs.mapInArrow(_scan(model, redact, [f.name for f in also]), schema)
