"""Stored tables and indexes, ordered streams, automata and the whole chain of a question, on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from terrace.functions import terms
from terrace.operators import consultation, kg, knowledge, names, nearest, ordinals, retrieval, sessions, stored_index
from terrace.sources import store
from terrace.sources.versioned import Versioned
from terrace.streaming import streams

# --- ordinals ----------------------------------------------------------------------------------------


def test_numbers_by_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5), i) for i in range(500)]
    got = ordinals.numbered(spark.createDataFrame(rows, "g string, k int, i int").repartition(7), ["k", "i"], "g").collect()
    for g in ("a", "b", None):
        mine = sorted((r.k, r.i, r.number) for r in got if r.g == g)
        assert [x[2] for x in mine] == list(range(len(mine)))
    whole = ordinals.numbered(spark.createDataFrame(rows, "g string, k int, i int"), ["k", "i"]).collect()
    assert [r.number for r in sorted(whole, key=lambda r: (r.k, r.i))] == list(range(500))
    assert ordinals.numbered(spark.createDataFrame([], "g string, k int"), ["k"], "g").count() == 0
    same = ordinals.numbered(spark.createDataFrame([("x", 1)] * 40, "g string, k int"), ["k"], "g").collect()
    assert sorted(r.number for r in same) == list(range(40))


def test_variants_are_numbered_as_their_export(spark):
    cells = spark.createDataFrame([("d", "t", "first text", 1), ("d", "t", "second text", 2), ("d", "t", "first text", 3), ("d", "u", "only one", 4)], "drug string, title string, text string, row long")
    texts = knowledge.deduped_texts(cells)
    rows = {(r.title, r.variant_index): r.content for r in knowledge.section_variants(texts).collect()}
    whole = {r.title: r.content for r in knowledge.sections(texts).collect()}
    assert rows == {("t", 1): "1. first text", ("t", 2): "2. second text", ("u", 1): "only one"}
    assert whole == {"t": "1. first text\n2. second text", "u": "only one"}


# --- versioned tables --------------------------------------------------------------------------------

SCHEMA = StructType([StructField("id", LongType()), StructField("owner", StringType()), StructField("v", LongType())])


@pytest.fixture
def table(spark):
    return Versioned(spark, store.fresh(spark, "versioned"), SCHEMA, ["id"], groups=4)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_versions_appends_and_deletes(spark, table):
    assert table.version() == 0 and table.read().count() == 0 and table.versions().count() == 0
    assert table.append(rows_of(spark, [(i, "a", i) for i in range(10)]), "one") == 1
    assert table.append(rows_of(spark, [(i, "a", i) for i in range(10)]), "one") == 1  # the same write again
    assert table.append(rows_of(spark, [(i, "b", i) for i in range(5, 12)]), "two") == 2
    assert table.read().count() == 17 and table.read(1).count() == 10
    doomed = spark.createDataFrame([(5, "a"), (6, "c"), (11, "b"), (99, "a")], "id long, owner string")
    assert table.delete(doomed, "three") == 3 == table.delete(doomed, "three")
    left = sorted((r.id, r.owner) for r in table.read().collect())
    assert left == sorted([(i, "a") for i in range(10) if i != 5] + [(i, "b") for i in range(5, 11)])
    table.compact("four")
    assert sorted((r.id, r.owner) for r in table.read().collect()) == left
    assert table.reset("five") == 5 and table.read().count() == 0 and table.read(3).count() == len(left)
    assert table.append(rows_of(spark, []), "six") == 6 and table.read().count() == 0
    assert {r.version: r.token for r in table.versions().collect()} == dict(enumerate(["one", "two", "three", "four", "five", "six"], 1))


def test_a_delete_leaves_other_groups_alone(spark, table):
    table.append(rows_of(spark, [(i, "a", i) for i in range(40)]), "one")
    before = set(table._live(1))
    table.delete(spark.createDataFrame([(3,)], "id long"), "two")
    assert len(before & set(table._live(2))) == len(before) - 1


def test_two_writers_cannot_take_one_version(spark, table):
    table.append(rows_of(spark, [(1, "a", 1)]), "one")
    with pytest.raises(Exception, match="(?i)exists"):
        table._commit(1, "other", [])
    assert [r.id for r in table.read().collect()] == [1]


def test_history(spark):
    held = sessions.history_table(spark, store.fresh(spark, "history"))
    kind = StructType.fromDDL(sessions.HISTORY)
    for i in range(3):
        held.append(spark.createDataFrame([(i, f"u{i % 2}", f"q{i}", "{}", 100 + i)], kind), f"create {i}")
    assert [r.id for r in sessions.history(held.read(), 2).collect()] == [2, 1]
    held.delete(spark.createDataFrame([(2, "u1")], "id long, user_id string"), "delete by another")
    assert sessions.history_entry(held.read(), 2).count() == 1
    held.delete(spark.createDataFrame([(2, "u0")], "id long, user_id string"), "delete by the owner")
    assert sessions.history_entry(held.read(), 2).count() == 0 and held.read().count() == 2


# --- streams -----------------------------------------------------------------------------------------


def plain_metrics(events, size):
    out = {}
    for kind in {e[0] for e in events}:
        newest = sorted({e[1]: e[2] for e in events if e[0] == kind}.items())[-size:]
        values = sorted(v or 0.0 for _, v in newest)
        out[kind] = (len(values), round(sum(values) / len(values), 6), values[min(len(values) - 1, int(len(values) * 0.95))])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_metrics_do_not_depend_on_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.choice("ab"), i, rng.choice([None, rng.random()])) for i in range(120)]
    rng.shuffle(events)
    for i in range(4):  # batches of any order; the last one delivers some events again
        part = events[i * 30 : i * 30 + 30] + (events[:20] if i == 3 else [])
        spark.createDataFrame(part, "event_type string, event_id long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_type string, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.run_available(streams.rolling_metrics(stream, 25), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    last = {kind: max((r for r in rows if r.event_type == kind), key=lambda r: r._batch) for kind in "ab"}
    assert {k: (r.n, round(r.avg_value, 6), r.p95_value) for k, r in last.items()} == plain_metrics(events, 25)


def test_idle_types_are_reported_once(spark, tmp_path):
    import time

    spark.createDataFrame([("a", 1, 2.0)], "event_type string, event_id long, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_type string, event_id long, value double").parquet(str(tmp_path / "in"))
    seen = []
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams._ROCKSDB)
    query = streams.rolling_metrics(stream, 5, idle_hours=3 / 3600).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(120):
            if any(r.n == 0 for r in seen):
                break
            time.sleep(0.5)
    finally:
        query.stop()
        spark.conf.set(name, before)
    assert [r.n for r in seen] == [1, 0]


def test_a_file_delivered_twice_gives_its_chunks_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text of a page"), (2, "another " * 300), (3, None)], "doc_id long, text string")
    for i in range(3):
        docs.write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in" / "*")).withColumn("at", F.col("_metadata.file_modification_time"))
        streams.run_available(streams.ingested_chunks(stream, arrived="at"), str(tmp_path / "out" / str(i)), str(tmp_path / "state"))
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).select("doc_id", "chunk_index", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.ingested_chunks(docs).collect()))


def test_edges_by_batches(spark):
    rng = random.Random(4)
    found = [(rng.choice("xyz"), "R", "Drug", rng.choice("pq"), rng.choice(["High", "Low"]), 0.5, i) for i in range(60)]
    schema = "subject string, relation string, object_type string, object string, risk_level string, confidence double, ord long"
    held = streams.edge_table(spark, store.fresh(spark, "edges"), 4)
    sink = streams.edge_upserts(held)
    order = found[:]
    rng.shuffle(order)
    for i in range(3):
        sink(spark.createDataFrame(order[i * 20 : i * 20 + 20], schema), i)
    sink(spark.createDataFrame(order[:20], schema), 0)  # a batch that comes again
    got = sorted((r.subject, r.object, r.risk_level, r.n_candidates) for r in held.read().collect())
    want = sorted((r.s_name, r.o_name, r.risk_level, r.n_candidates) for r in kg.upsert_edges(spark.createDataFrame(found, schema)).collect())
    assert got == want and held.version() == 3


# --- session state -----------------------------------------------------------------------------------


def plain_states(turns):
    state, out = {c: set() for c in ("drugs", "population", "conditions", "risk_factors")}, {}
    for turn, drugs, people, conditions, risks in sorted(turns):
        if "young" in people and "old" not in people:
            state["population"].discard("old")
        if "old" in people and "young" not in people:
            state["population"].discard("young")
        for c, v in zip(state, (drugs, people, conditions, risks), strict=True):
            state[c] |= set(v)
        out[turn] = tuple(sorted(state[c]) for c in state)
    return out


TURNS = "session_id long, turn long, message string, drugs array<string>, population array<string>, conditions array<string>, risk_factors array<string>"


def test_states_like_a_plain_fold(spark):
    rng = random.Random(8)
    some = lambda words: rng.sample(words, rng.randint(0, len(words)))
    rows = {s: [(t, some(list("abc")), some(["old", "young", "other"]), some(list("xy")), some(list("r"))) for t in range(rng.randint(1, 25))] for s in range(20)}
    frame = spark.createDataFrame([(s, t[0], f"m{t[0]}", *t[1:]) for s, ts in rows.items() for t in ts], TURNS).repartition(5)
    got = {(r.session_id, r.turn): (r.drugs, r.population, r.conditions, r.risk_factors) for r in sessions.snapshots(frame, "old", "young").collect()}
    assert got == {(s, t): v for s, ts in rows.items() for t, v in plain_states(ts).items()}


def test_a_long_session(spark):
    rows = spark.range(10_000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("turn"), F.lit("m").alias("message"), F.array(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("drugs"), *[F.array().cast("array<string>").alias(c) for c in ("population", "conditions", "risk_factors")])
    assert sessions.snapshots(rows).agg(F.sum(F.size("drugs"))).first()[0] == sum(range(1, 51)) + 50 * 9950


# --- names -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [50_000, 1])
def test_hits_like_a_plain_search(spark, monkeypatch, small):
    monkeypatch.setattr(names, "SMALL", small)
    rng = random.Random(6)
    known = sorted({"".join(rng.choices("甲乙丙a", k=rng.randint(1, 9))) for _ in range(40)})
    texts = [(i, "".join(rng.choices("甲乙丙ab ", k=rng.randint(0, 60)))) for i in range(50)] + [(99, None)]
    got = names.hits(spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame([(n,) for n in known], "name string"), "id", "t").collect()
    want = sorted((i, n, p) for i, t in texts for n in known if len(n) >= 2 for p in range(len(t or "")) if (t or "").startswith(n, p))
    assert sorted((r.id, r.name, r.start) for r in got) == want


def test_one_character_names_only_in_lists(spark):
    known = spark.createDataFrame([("参", "人参"), ("布洛芬", "布洛芬片"), ("华法林", "华法林钠")], "name string, canonical string")
    asked = spark.createDataFrame([(1, "华法林和参"), (2, "人参汤怎么喝"), (3, "参、布洛芬 一起吃"), (4, "没有吃布洛芬，参"), (5, None)], "q long, message string")
    got = {r.q: r.drugs for r in names.extract(asked, known).collect()}
    assert got == {1: ["人参", "华法林钠"], 2: [], 3: ["人参", "布洛芬片"], 4: ["人参"], 5: []}


# --- indexes -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [256, 4])
def test_stored_index_ranks_as_a_scan_does(spark, monkeypatch, block):
    monkeypatch.setattr(stored_index, "BLOCK", block)
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40))), "s" + str(i % 3)) for i in range(200)] + [(200, None, "s0"), (201, "", "s1")]
    asked = [(i, " ".join(rng.choices(words, k=5))) for i in range(12)] + [(12, ""), (13, "unseen")]
    frame, questions = spark.createDataFrame(docs, "ord long, text string, section string"), spark.createDataFrame(asked, "q long, text string")
    outcome, index = stored_index.ensure(frame, F.col("text"), store.fresh(spark, "index"), near=["section"], buckets=4)
    assert outcome == "built"
    want = retrieval.top_k(retrieval.bm25(frame, questions, F.col("text"), F.col("text")).withColumnRenamed("base", "score"), 5)
    shown = lambda df: sorted((r.q, r["rank"], r.ord, round(r.score, 9)) for r in df.collect())
    assert shown(stored_index.top_k(index, questions, F.col("text"), 5)) == shown(want)
    again, kept = stored_index.ensure(frame, F.col("text"), index.path, buckets=4)
    assert again == "kept" and shown(stored_index.top_k(kept, questions, F.col("text"), 5)) == shown(want)
    with pytest.raises(stored_index.IncompleteIndex):
        stored_index.ensure(frame.where("ord < 100"), F.col("text"), index.path)


def test_lists_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    vectors = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(1200)] + [(5000 + i, centres[0].tolist()) for i in range(400)] + [(9999, None)]
    docs = spark.createDataFrame(vectors, "ord long, vec array<double>").repartition(6)
    asked = docs.where("ord % 100 = 0 and ord < 5000").select(F.col("ord").alias("q"), "vec")
    index = nearest.build(docs, nearest.fit(docs, lists=30))
    unit = docs.where("vec is not null").withColumn("vec", F.transform("vec", lambda x: x / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, y: s + y * y))))
    exact = retrieval.top_k(retrieval.dense(unit, unit.where("ord % 100 = 0 and ord < 5000").select(F.col("ord").alias("q"), "vec")).withColumnRenamed("cosine", "score"), 8)
    whole = nearest.exact(unit, unit.where("ord % 100 = 0 and ord < 5000").select(F.col("ord").alias("q"), "vec"), 8)
    assert nearest.recall(whole, exact).first().recall == 1.0
    probes = nearest.calibrate(index, 8, 0.95)
    assert 1 <= probes < 15  # clustered vectors need a part of the lists
    assert nearest.recall(nearest.search(index, asked, probes), exact).first().recall >= 0.9
    assert nearest.recall(nearest.search(index, asked, 30), exact).first().recall == 1.0
    none = docs.where("ord < 0")
    assert nearest.search(nearest.build(none, nearest.fit(none)), asked, 1).count() == 0


def test_one_pass_falls_back(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{'x' * (i % 5)}", "d") for i in range(30)], "ord long, text string, also string")
    asked = spark.createDataFrame([("a", "alpha wx"), ("b", "beta wxx wxx")], "q string, text string")
    both = [retrieval.one_pass(docs, asked, F.col("text"), F.col("also"), F.col("text"), F.col("text"), 5, limit_mb=m) for m in (64, 0)]
    first = [retrieval.top_k(b[1].withColumnRenamed("cosine", "score"), 5).select("q", "ord", "rank").orderBy("q", "rank").collect() for b in both]
    second = [sorted((r.q, r.ord, round(r.base, 9)) for r in retrieval.bm25_of(b[0], asked, F.col("text")).collect()) for b in both]
    assert first[0] == first[1] and second[0] == second[1]


# --- the chain ---------------------------------------------------------------------------------------

PASSAGES = [
    (0, "说明书", "华法林", "药物相互作用", "华法林与阿司匹林合用显著增加出血风险，应避免合用。"), (1, "说明书", "华法林", "老年用药", "老年患者慎用，应监测凝血指标。"), (2, "说明书", "阿司匹林", "禁忌", "活动性出血患者禁用。"),
    (3, "说明书", "布洛芬", "用法用量", "口服，一次一片。"), (4, "说明书", "布洛芬", "警告与注意事项", "高血压患者慎用，需监测血压。"), (5, "说明书", "辛伐他汀", "儿童用药", "儿童禁用。"),
]


@pytest.fixture(scope="module")
def chain(spark):
    docs = spark.createDataFrame([(*r, r[-1]) for r in PASSAGES], "ord long, source string, drug string, section string, text string, snippet string")
    known = spark.createDataFrame([(n, n) for n in ("华法林", "阿司匹林", "布洛芬", "辛伐他汀")], "name string, canonical string")
    rules = spark.createDataFrame([("华法林", "阿司匹林", "High", "出血风险增加。", "避免合用。", 0)], "left string, right string, risk_level string, mechanism string, recommendation string, ord long")
    edges = spark.createDataFrame([("Drug", "华法林", "INTERACTS_WITH", "Drug", "布洛芬", 1.1, "Medium"), ("Drug", "华法林", "USE_WITH_CAUTION_IN", "Population", "老年人", 1.1, None)], "s_label string, s_name string, rel string, o_label string, o_name string, weight double, risk_level string")
    asked = spark.createDataFrame([
        (1, "华法林和阿司匹林能一起吃吗"), (2, "我72岁，华法林能吃吗"), (3, "高血压能吃布洛芬吗，一次200mg"), (4, "华法林和布洛芬"), (5, "今天天气"), (6, "消炎药和止痛药"),
    ], "q long, message string")
    ambiguous = spark.createDataFrame([(6, "消炎药"), (6, "止痛药")], "q long, mention string")
    memory = spark.createDataFrame([(5, ["华法林", "阿司匹林"], ["老年人"], [])], "q long, drugs array<string>, population array<string>, conditions array<string>")
    return asked, known, docs, rules, kg.nodes_of(edges), edges, ambiguous, memory


def test_answers(spark, chain):
    asked, known, docs, rules, nodes, edges, ambiguous, memory = chain
    found = consultation.consult(asked, known, docs, rules, nodes, edges, ambiguous=ambiguous, memory=memory)
    rows = {r.q: r for r in found.answers.collect()}
    assert {q: r.level for q, r in rows.items()} == {1: "High", 2: "Medium", 3: "Medium", 4: "High", 5: "High", 6: "Unknown"}
    assert rows[1].confidence == 0.88 and rows[1].conclusion == "华法林 与 阿司匹林 存在 High 级用药风险。" or rows[1].conclusion == "阿司匹林 与 华法林 存在 High 级用药风险。"
    assert rows[1].recommendation == "避免合用。" and rows[1].mechanism.startswith("出血风险增加。 避免合用。")
    assert "老年人" in rows[2].mechanism and [f["level"] for f in rows[2].flags] == ["info", "warning"]
    assert rows[4].n_relations == 1 and "知识图谱" in rows[4].mechanism and rows[4].answer.count("图谱关系：华法林 - 相互作用 - 布洛芬") == 1
    assert rows[5].drugs == ["华法林", "阿司匹林"] or sorted(rows[5].drugs) == sorted(["华法林", "阿司匹林"])  # nothing is named now: the session's names count
    assert rows[6].mechanism == terms.MECHANISMS["ambiguous"] and rows[6].flags[0]["message"].startswith("止痛药、消炎药") and rows[6].confidence == 0.32
    evidence = found.evidence.collect()
    assert {r.drug for r in evidence if r.q == 2} == {"华法林"} and min(r.position for r in evidence if r.q == 2) == 1
    first = next(r for r in evidence if r.q == 2 and r.position == 1)
    assert first.section == "老年用药"  # what is about the population comes first
    assert all(r.answer.endswith(terms.ANSWER["notice"]) for r in rows.values())
    assert [s["node"] for s in rows[1].trace] == ["extract_entities", "retrieve_evidence", "query_kg", "assess_risk", "prepare_answer"]


def test_families_are_concepts(spark, chain):
    asked, known, docs, rules, nodes, edges, _, _ = chain
    groups = spark.createDataFrame([(1, 0, "他汀", ["辛伐他汀", "阿司匹林"])], "q long, i long, concept string, candidates array<string>")
    one = spark.createDataFrame([(1, "华法林和他汀")], "q long, message string")
    row = consultation.consult(one, known, docs, rules, nodes, edges, groups=groups).answers.first()
    assert row.concepts == 2 and row.level == "High" and row.conclusion == "华法林 与 阿司匹林 存在 High 级用药风险。"
    assert any(f["code"] == "family" and "2 个相关制剂" in f["message"] for f in row.flags)


def test_reports(spark, chain):
    asked, known, docs, rules, *_ = chain
    rows = {r.q: r for r in consultation.analyze(asked, known, docs, rules).collect()}
    assert rows[1].level == "High" and rows[1].confidence == 0.86 and rows[1].limitations == [terms.LIMITATIONS["no_dose"]]
    assert terms.LIMITATIONS["few"] in rows[3].limitations and terms.LIMITATIONS["no_dose"] not in rows[3].limitations
    assert rows[5].level == "Unknown" and rows[5].confidence == 0.35 and rows[5].conclusion == terms.REPORT["Unknown"]
