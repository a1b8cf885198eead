"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.llm import chat, merkle, whitening

# --- op11 --------------------------------------------------------------------------------------------

ROWS = "conv_id long, turn long, role string, text string"
LOG = "conv_id long, turn long, message string, seq long, kind string, role string, text string"


@given(st.lists(st.tuples(st.text("ab: #\\</turn>h\n", max_size=12), st.text("#\\</turn> :ctho\né🎉", max_size=40)), max_size=5))
def test_rendering_is_reversible(turns):
    out = "".join(chat.render(r, t)[0] for r, t in turns)
    assert list(chat.parse(out)) == turns
    for role, text in turns:
        whole, start, end = chat.render(role, text)
        assert chat.unescape(whole[start:end]) == text and whole.count("###") == 1 and whole.count("</turn>") == 1


def digests(turns):
    learned = [t for r, t in turns if r == "assistant"]
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    chars = sum(len(chat.render(r, t)[0]) for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len("".join(learned)), hashlib.sha256("".join(learned).encode()).hexdigest(), chars)


def by_conversation(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("part", [4_000_000, 50])
def test_chats_of_rows(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rng = random.Random(part)
    rows = [(c, t, "assistant" if t % 2 else "user", "".join(rng.choices("ab #\\</turn>é🎉\n", k=rng.randint(0, 300)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, None, None), (100, 1, "assistant", ""), (101, 0, "user", "### x" * 40_000), (101, 1, "assistant", "</turn>" * 40_000)]
    want = defaultdict(list)
    for c, _, r, t in rows:
        want[c].append((r or "", t or ""))
    log = chat.log_of(spark.createDataFrame(rows, ROWS).repartition(5).withColumn("seq", F.lit("clash")).withColumn("kind", F.lit(1)), piece=50)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {"delta", "edit", "message", "regenerate"}
    out = chat.formatted(log)
    assert by_conversation(chat.read_back(out).collect()) == by_conversation(chat.read_back(out, in_order=True).collect()) == {c: digests(t) for c, t in want.items()}
    if part == 50:
        assert out.where("part > 0").count() > 100


def test_chats_of_repeated_rows_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (None, None, "user", "c"), (None, 5, "assistant", "d"), (2, 2**62, "user", "e")]
    got = by_conversation(chat.read_back(chat.formatted(chat.log_of(spark.createDataFrame(rows, ROWS)))).collect())
    assert got == {1: digests([("assistant", "b"), ("user", "a"), ("user", "a")]), None: digests([("user", "c"), ("assistant", "d")]), 2: digests([("user", "e")])}
    assert chat.read_back(chat.formatted(chat.log_of(spark.createDataFrame([], ROWS)))).count() == 0


def replay(events):
    """Events of one conversation by their sequence, on a dict of messages."""
    said = {}
    for turn, message, _, kind, role, text in sorted(events, key=lambda e: e[2]):
        key = (turn, message)
        if kind == "regenerate":
            said = {k: v for k, v in said.items() if k[0] <= turn and k != key}
        elif kind == "delta":
            said[key] = said.get(key, "") + text
        else:
            said[key] = text
    return [("assistant" if k[0] % 2 else "user", v) for k, v in sorted(said.items())]


def test_logs_fold_as_they_replay(spark):
    rng = random.Random(3)
    logs = {}
    for c in range(60):
        events = []
        for seq in range(rng.randint(1, 40)):
            turn = rng.randint(0, 4)
            events.append((turn, rng.choice("mn"), seq, rng.choices(["message", "delta", "edit", "regenerate"], [2, 6, 2, 1])[0], "assistant" if turn % 2 else "user", rng.choice("pqr") * rng.randint(0, 3)))
        logs[c] = events
    rows = [(c, *e) for c, events in logs.items() for e in events]
    rng.shuffle(rows)
    got = by_conversation(chat.read_back(chat.formatted(spark.createDataFrame(rows, LOG).repartition(4))).collect())
    assert got == {c: digests(replay(e)) for c, e in logs.items()}


# --- op12 --------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 513, 600])
def test_positions_are_postorder(n):
    order = []

    def visit(level, at, shape):
        if level:
            for j in range(at * 8, min(at * 8 + 8, shape[level - 1])):
                visit(level - 1, j, shape)
        order.append((level, at))

    shape = merkle.widths(n)
    visit(len(shape) - 1, 0, shape)
    assert [int(merkle.postorder(n, k, i)) for k, i in order] == list(range(len(order)))


def plain_manifest(docs):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = defaultdict(list)
    for d, text, lang, source, n in docs:
        head = "".join(map(enc, (d, source, lang, n)))
        bad = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        trees[("",) if lang is None else ("=", lang.encode())].append((d is not None, d or 0, sha(head + enc(text)), sha(head + enc(low(text) if bad and text is not None else text)), d))
    names = sorted(trees)
    levels = {t: plain_levels([x[2] for x in sorted(trees[t])]) for t in names}
    top = plain_levels([levels[t][-1][0] for t in names])
    out = []
    for i, t in enumerate(names):
        for j, x in enumerate(sorted(trees[t])):
            others, acc = [], x[3]
            for shape, at in ((levels[t], j), (top, i)):
                for level in shape[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = run[: at % 8], run[at % 8 + 1 :]
                    others += left + right
                    acc = sha("".join([*left, acc, *right]))
                    at //= 8
            out.append((x[4], x[2], levels[t][-1][0], top[-1][0], sha("".join(others)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def some_documents():
    rng = random.Random(5)
    docs = [(i, rng.choice(["Ab c", "xyz", "É 🎉 Q", "", None]), rng.choice(["en"] * 6 + ["de", None, "日"]), rng.choice(["s", None, ""]), rng.choice([1, None])) for i in range(700)]
    docs += [(None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (3, "other", "en", "s", 1), *[(5, "twice", "en", "s", 1)] * 30, (9000, "Long " * 200_000, "xx", None, 3), (9001, "a", "", None, 1)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "ALIGNED", 8**levels)
    docs = some_documents()
    frame = spark.createDataFrame(docs, DOCS).repartition(6).withColumns({"tree": F.lit(1), "at": F.lit("x"), "digest": F.lit(2), "n": F.lit(0)})
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    got = merkle.verified(merkle.manifest(frame, tampered)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(docs)


@pytest.mark.parametrize("levels", [4, 1])
def test_log_is_in_completion_order(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "ALIGNED", 8**levels)
    docs = some_documents()
    rows = merkle.numbered(merkle.leaves(spark.createDataFrame(docs, DOCS)), ["doc_id"])
    segments = merkle.build(rows)
    nodes = merkle.log(segments)
    found = defaultdict(dict)
    for r in nodes.collect():
        assert r.position not in found[r.tree]
        found[r.tree][r.position] = (r.level, r.at, r.digest)
    for tree, held in found.items():
        n = sum(1 for x in held.values() if x[0] == 0)
        whole = plain_levels([x[2] for x in sorted(held.values()) if x[0] == 0])
        assert sorted(held) == list(range(len(held))) and len(held) == sum(map(len, whole))
        assert all(whole[k][i] == digest and merkle.postorder(n, k, i) == p for p, (k, i, digest) in held.items())
    want = {(r.tree, r.at): "".join(p["left"] + p["right"] for p in r.path) for r in merkle.proofs(segments).collect()}
    got = {(r.tree, r.at): "".join(r.siblings) for r in merkle.proof_at(nodes, rows.where("at % 50 = 0").select("tree", "at", "n")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_manifest_of_one_and_of_nothing(spark):
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0
    one = [(None, None, None, None, None)]
    assert sorted(map(tuple, merkle.verified(merkle.manifest(spark.createDataFrame(one, DOCS))).collect()), key=str) == plain_manifest(one)


# --- op13 --------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def plain_whitening(vectors, k):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    y = fit * n - sums
    exact = np.array([[int(sum(y[:, a] * y[:, b])) / n**3 for b in range(y.shape[1])] for a in range(y.shape[1])])
    values, columns = np.linalg.eigh(exact)
    order = np.argsort(-values)[:k]
    return n, {i: int(sum((v * n - s) ** 2 for v, s in zip(x, sums, strict=True))) for i, x in kept}, values[order], values[order] / np.trace(exact), columns[:, order], {i: np.array([float(v * n - s) / n for v, s in zip(x, sums, strict=True)]) for i, x in kept}


def test_whitening(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(6, 6))
    vectors = [(i, list(map(float, rng.normal(size=6) @ mixing + [0, 3, -5, 0.01, 100, 0]))) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)]  # a hot vector
    odd = [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [math.nan] + [0.0] * 5), (5003, [math.inf] + [0.0] * 5), (5004, []), (5005, [1.0] * 3), (None, vectors[3][1]), (3, vectors[3][1])]
    frame = spark.createDataFrame(vectors + odd, VECTORS).repartition(5).withColumns({"x": F.lit("clash"), "n": F.lit(1), "component": F.lit(0)})
    rows = whitening.whiten(frame, components=4).collect()
    n, deviation, values, explained, columns, centred = plain_whitening(vectors, 4)
    assert len(rows) == 4 * (len(vectors) + 2) and {r.n for r in rows} == {n} and n == 400
    for r in rows:
        key = 3 if r.vec_id is None else r.vec_id
        assert int(r.deviation) == deviation[key]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(centred[key] @ columns[:, r.component - 1]) / math.sqrt(values[r.component - 1]), abs=1e-9)
        assert r.identity_error < 1e-9
    signs = defaultdict(set)
    for r in rows:
        mine = centred[3 if r.vec_id is None else r.vec_id] @ columns[:, r.component - 1]
        if abs(mine) > 1e-6:
            signs[r.component].add(mine * r.whitened > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_covariances_are_exact_for_large_entries(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) * 2.0**33, rng.uniform(-1, 1), rng.uniform(0, 2.0**20)]) for i in range(50)]
    rows = whitening.whiten(spark.createDataFrame(vectors, VECTORS)).collect()
    _, deviation, _, explained, _, _ = plain_whitening(vectors, 3)
    assert all(int(r.deviation) == deviation[r.vec_id] for r in rows)
    assert {r.component: r.explained for r in rows}[1] == pytest.approx(explained[0], rel=1e-12)


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
