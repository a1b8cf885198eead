"""Operators on small fixtures: rules that hold for Chinese text, folds against plain models, files, streams."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import chunking, kg, knowledge, metrics, names, questions, retrieval, risk, sessions
from terrace.plans import registry
from terrace.plans.common import in_bytes
from terrace.sources import readers
from terrace.streaming import streams


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


# --- text --------------------------------------------------------------------------------------------


def test_tokens_count_runs_and_single_characters(spark):
    assert one(spark, text.tokens, "Warfarin-2 华法林 a 片") == ["warfarin-2", "华法林", "华", "法", "林", "片"]


@pytest.mark.parametrize(("name", "base"), [("感冒灵颗粒", "感冒灵"), ("复方感冒灵片", "复方感冒灵"), ("复方感冒灵片(双层片)", "复方感冒灵"), ("X片", "x片"), ("氧缓释片", "氧缓释")])
def test_base_name(spark, name, base):
    assert one(spark, text.base_name, name) == base


def test_salt_prefix(spark):
    assert one(spark, text.without_salt, "盐酸二甲双胍片") == "二甲双胍片"
    assert one(spark, text.without_salt, "盐酸片") == "盐酸片"


@pytest.mark.parametrize(("value", "ages"), [("我7岁", [7]), ("我七岁", [7]), ("六十五岁", [65]), ("一百二十岁", [120]), ("十岁", [10]), ("二十岁", [20]), ("百岁", [100]), ("1.5岁", []), ("二三岁", []), ("一百零五岁", []), ("200岁", []), ("65 周岁", [65])])
def test_ages(spark, value, ages):
    assert one(spark, text.ages, value) == ages


def test_context(spark):
    rows = spark.createDataFrame([(1, "我六十五岁，肾功能不全，有出血风险"), (2, "我30岁，低血压"), (3, "怀孕期间"), (4, "心力衰竭和心衰")], "q long, message string")
    got = {r.q: r for r in names.context(rows).collect()}
    assert "老年人" in got[1].population and "肾功能相关" in got[1].population and got[1].conditions == ["肾功能不全"] and "出血" in got[1].risk_factors
    assert got[2].population == [] and got[2].risk_factors == ["低血压"]
    assert got[3].population == ["妊娠/备孕"]
    assert got[4].conditions == sorted(["心力衰竭", "心衰"])


def test_sentences_and_items(spark):
    assert one(spark, text.sentences, "本品禁用于孕妇。慎用；1.老人减量使用。短。") == ["本品禁用于孕妇", "老人减量使用"]
    assert one(spark, text.numbered_items, "1.儿童禁止使用。2.老人慎重使用。") == ["儿童禁止使用", "老人慎重使用"]
    assert one(spark, text.numbered_items, " ") == []
    assert one(spark, text.numbered_items, "短句") == ["短句"]


def test_normalize(spark):
    assert one(spark, text.normalize, "　甲|乙??\n 丙。 丁；") == "甲。乙？ 丙。丁"
    assert one(spark, text.normalize, None) == ""


def test_clean_page(spark):
    assert one(spark, text.clean_page, "a\r\n - 3 - \r\nb  c\n\n\n\nd ") == "a\nb c\n\nd"


def test_near_terms(spark):
    near = lambda v: one(spark, lambda c: text.near_terms(c, ["血压"], ["禁用"], 5), v)
    assert near("高血压患者禁用") and near("禁用于血压高") and not near("血压正常的人群可以不禁用") and not near("血压")


def test_json_object(spark):
    assert one(spark, lambda c: text.json_object(c, "a int")["a"], 'noise {"a": 3} tail') == 3
    assert one(spark, lambda c: text.json_object(c, "a int")["a"], "none") is None


def test_section_classifier_first_wins(spark):
    assert one(spark, text.first_section, "联合用药的禁忌") == "药物相互作用"
    assert one(spark, text.first_section, "其他") is None


# --- chunking ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "chunks"), [(0, 1), (1, 1), (160, 1), (161, 2), (250, 2), (251, 3), (280, 3)])
def test_window_count(spark, n, chunks):
    assert chunking.window_chunks(spark.createDataFrame([(1, "x" * n)], "k long, t string"), "k", "t").count() == chunks


def packed(units, limit=30, overlap=1):
    done, cur, size = [], [], 0
    close = lambda x: "。".join(x).strip("。") + "。"
    for u in units:
        if len(u) > limit:
            if cur:
                done.append(close(cur))
            cur, size = [], 0
            done += [u[i : i + limit].strip() for i in range(0, len(u), limit)]
            continue
        extra = len(u) + bool(cur)
        if cur and size + extra > limit:
            done.append(close(cur))
            cur = cur[-overlap:]
            size = sum(map(len, cur))
        cur.append(u)
        size += extra
    if cur:
        done.append(close(cur))
    return [x for x in done if len(x.strip()) >= 4]


def test_pack_units_like_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [(i, ["字" * rng.choice([2, 5, 9, 14, 29, 31, 70]) for _ in range(rng.randint(0, 9))]) for i in range(80)]
    got = spark.createDataFrame(rows, "k long, u array<string>").select("k", chunking.pack_units(F.col("u"), 30).alias("c")).collect()
    assert {r.k: r.c for r in got} == {k: packed(u) for k, u in rows}


def test_headings(spark):
    body = "【禁忌】\n孕妇及哺乳期妇女禁用本品，儿童禁用。\n2. 不良反应\n可见恶心、呕吐，停药后消失。\n其他：\n这是没有名字的一节内容。"
    got = chunking.heading_sections(spark.createDataFrame([(1, body), (2, "本品与华法林合用需谨慎"), (3, "无关")], "k long, t string"), "k", "t").collect()
    assert [(r.k, r.title) for r in sorted(got, key=lambda r: (r.k, r.section_index))] == [(1, "禁忌"), (1, "不良反应"), (2, "药物相互作用")]


def test_retrieval_documents(spark):
    rows = [("s", "阿魏酸哌嗪片", [("老年用药", "x", [("老人应在 专业医师指导下使用", "section", ["老年人"], [])]), ("禁忌", "y" * 200, None)])]
    df = spark.createDataFrame(rows, "source string, drug string, sections array<struct<title string, content string, chunks array<struct<text string, chunk_type string, population_tags array<string>, risk_terms array<string>>>>>")
    got = {r.chunk_id: (r.text, r.chunk_type) for r in chunking.retrieval_documents(df).collect()}
    assert got["阿魏酸哌嗪片::0::老年用药::structured::0"] == ("老人应在 专业医师指导下使用", "section")
    assert sum(k.startswith("阿魏酸哌嗪片::1::禁忌::window::") for k in got) == 2


# --- names -------------------------------------------------------------------------------------------

FAMILY = ["感冒灵片", "感冒灵颗粒", "复方感冒灵片", "复方感冒灵颗粒", "布洛芬片", "布洛芬胶囊", "布洛芬凝胶", "华法林钠片"]


def resolve(spark, drugs, message, overrides=None):
    records = spark.createDataFrame([(d, []) for d in drugs], "drug string, aliases array<string>")
    over = spark.createDataFrame(overrides, readers.OVERRIDE) if overrides else None
    index = names.resolution_names(records, over)
    r = names.resolve(spark.createDataFrame([(1, message)], "q long, message string"), index).first()
    return r.resolved, [(g.mention, g.candidates) for g in r.groups]


def test_resolver(spark):
    assert resolve(spark, FAMILY, "复方感冒灵片和布洛芬片能一起吃吗") == (["复方感冒灵片", "布洛芬片"], [])
    assert resolve(spark, FAMILY, "布洛芬能吃吗") == ([], [("布洛芬", ["布洛芬片", "布洛芬胶囊"])])
    salts = ["盐酸二甲双胍片", "盐酸二甲双胍缓释片"]
    assert resolve(spark, salts, "长期吃二甲双胍片") == (["盐酸二甲双胍片"], [])
    assert resolve(spark, salts, "长期吃二甲双胍") == ([], [("二甲双胍", sorted(salts))])
    resolved, groups = resolve(spark, FAMILY, "布洛芬和华法林能一起吃吗", [("华法林", ["华法林钠片"], "manual_review")])
    assert resolved == ["华法林钠片"] and groups[0][0] == "布洛芬"
    assert resolve(spark, FAMILY, "") == ([], [])


def test_negation_and_dictionary(spark):
    records = spark.createDataFrame([(1, "华法林", ["warfarin"]), (2, "布洛芬", ["华法林"]), (3, "氧", [])], "ord long, drug string, aliases array<string>")
    index = names.alias_dictionary(records)
    assert {(r.name, r.canonical) for r in index.collect()} == {("华法林", "华法林"), ("warfarin", "华法林"), ("布洛芬", "布洛芬"), ("氧", "氧")}
    asked = spark.createDataFrame([(1, "我不吃华法林，可以吃布洛芬吗"), (2, "停了华法林"), (3, "不推荐服用华法林"), (4, "吃氧和Warfarin")], "q long, message string")
    assert {r.q: r.drugs for r in names.extract(asked, index).collect()} == {1: ["布洛芬"], 2: [], 3: [], 4: ["华法林"]}


def test_payload(spark):
    index = spark.createDataFrame([("华法林", "华法林钠片"), ("布洛芬", "布洛芬片")], "name string, canonical string")
    body = json.dumps({"medications": [{"mention": "华法林"}, {"mention": "止痛药", "normalized": "布洛芬"}, {"mention": "消炎药"}, {"mention": "布洛芬", "status": "past"}]}, ensure_ascii=False)
    got = names.payload_mentions(spark.createDataFrame([(1, "说明：" + body)], "q long, payload string"), index).collect()
    assert {(r.mention, r.drug, r.ambiguous) for r in got} == {("华法林", "华法林钠片", False), ("止痛药", "布洛芬片", False), ("消炎药", None, True)}


def test_resolver_like_a_plain_model(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choices("甲乙丙", k=rng.randint(2, 4))) for _ in range(12)]
    index = [("exact_name", n, [n]) for n in set(pool[:5])] + [("alias", n, ["t" + n]) for n in set(pool[5:9])] + [("derived_base_name", n, ["b" + n]) for n in set(pool[9:])]
    texts = [(i, "".join(rng.choices("甲乙丙丁", k=rng.randint(0, 20)))) for i in range(60)]
    rank = {"exact_name": 3, "alias": 2, "derived_base_name": 1}

    def model(t):
        hits = sorted((-len(n), -rank[k], p, targets) for k, n, targets in index for p in range(len(t)) if t.startswith(n, p))
        kept = []
        for n, _, p, targets in hits:
            if not any(p < e and s < p - n for s, e, _ in kept):
                kept.append((p, p - n, targets))
        return sorted({x[0] for _, _, x in kept})

    df = spark.createDataFrame(index, "kind string, name string, targets array<string>")
    got = {r.q: r.resolved for r in names.resolve(spark.createDataFrame(texts, "q long, message string"), df).collect()}
    assert got == {i: model(t) for i, t in texts}


# --- records, graph, risk ----------------------------------------------------------------------------


def test_merges(spark):
    old = spark.createDataFrame([("d", "a", 0, "old a"), ("d", "b", 1, "old b")], "drug string, title string, ord long, content string")
    new = spark.createDataFrame([("d", "c", 0, "new c"), ("d", "b", 1, "b")], "drug string, title string, ord long, content string")
    assert [(r.title, r.content) for r in knowledge.merge_new_wins(old, new).orderBy("position").collect()] == [("a", "old a"), ("b", "b"), ("c", "new c")]
    assert {r.title: r.content for r in knowledge.merge_longer_wins(old, new).collect()} == {"a": "old a", "b": "old b", "c": "new c"}


def test_section_rows(spark):
    rows = spark.createDataFrame([(1, " 甲 片", None, "禁用于孕妇", "无"), (2, "甲片", None, "禁用于孕妇", ""), (3, "", "乙片", "慎用于老人", "")], "row long, name string, title_text string, c1 string, c2 string")
    texts = knowledge.deduped_texts(knowledge.section_rows(rows, {"c1": "禁忌", "c2": "其他"}))
    assert {(r.drug, r.title, r.text): r.rows for r in texts.collect()} == {("甲片", "禁忌", "禁用于孕妇"): [1, 2], ("乙片", "禁忌", "慎用于老人"): [3]}


def test_report_gathers_no_texts(spark):
    """Counts need no array of a section's texts."""
    plan = registry.queries()["build_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    rows = spark.createDataFrame([(1, "甲", None, "禁用于孕妇", "无"), (2, "甲", None, "禁用于孕妇", "另有内容"), (3, "甲", None, "慎用于老人", "")], "row long, name string, title_text string, c1 string, c2 string")
    texts = knowledge.deduped_texts(knowledge.section_rows(rows, {"c1": "禁忌", "c2": "其他"}))
    assert {(r.title, r.variant_count) for r in knowledge.section_counts(texts).collect()} == {("禁忌", 2), ("其他", 1)}


def test_export_appends_sources(spark):
    rows = spark.createDataFrame([(1, "甲", "t", "禁忌", "x", "p1"), (2, "甲", "t", "其他", "y", "p2"), (3, "甲", "t", "其他", "z", "p1"), (4, "", "布洛芬说明书", "禁忌", "x", "p3")], "ord long, drug string, title string, section string, text string, source_path string")
    got = {r.drug: r for r in knowledge.export_records(rows).collect()}
    assert got["甲"].source == "p1 + p2" and len(got["甲"].sections) == 3 and got["布洛芬"].source == "p3"


def test_graph_candidates(spark):
    sections = spark.createDataFrame([(1, "甲片", "药物相互作用", "与华法林合用可能增加出血风险。尚不明确的作用。"), (2, "甲片", "禁忌", "孕妇禁用本品。老年患者应注意监测血压。"), (3, "甲片", "适应症", "孕妇禁用本品。")], "ord long, drug string, title string, text string")
    index = spark.createDataFrame([("华法林", "华法林钠片"), ("甲片", "甲片")], "name string, canonical string")
    got = {(r.relation, r.object, r.object_type, r.risk_level, r.confidence) for r in kg.candidates(sections, index).collect()}
    assert got == {
        ("INTERACTS_WITH", "华法林钠片", "Drug", "Low", 0.72), ("INTERACTS_WITH", "抗凝药", "DrugClass", "Low", 0.62),
        ("CONTRAINDICATED_FOR", "妊娠/备孕", "Population", "High", 0.68), ("USE_WITH_CAUTION_IN", "老年人", "Population", "Medium", 0.68),
    }


def test_neighbours_by_alias_and_either_end(spark):
    nodes = spark.createDataFrame([("Drug", "warfarin", ["华法林"]), ("Drug", "aspirin", []), ("Risk", "High", [])], "label string, name string, aliases array<string>")
    edges = spark.createDataFrame([("Drug", "aspirin", "INTERACTS_WITH", "Drug", "warfarin", 1.3), ("Drug", "aspirin", "MAY_CAUSE", "Risk", "High", 0.8), ("Drug", "warfarin", "MAY_CAUSE", "Risk", "High", None)], "s_label string, s_name string, rel string, o_label string, o_name string, weight double")
    asked = spark.createDataFrame([(1, ["华法林"]), (2, ["nobody"])], "q long, entities array<string>")
    got = kg.neighbours(asked, nodes, edges, 10).orderBy("ord").collect()
    assert [(r.q, r.subject, r.relation, r.object) for r in got] == [(1, "aspirin", "相互作用", "warfarin"), (1, "warfarin", "风险", "High")]


def test_evidence_levels(spark):
    rows = [(1, "可能导致严重不良反应和禁忌"), (2, "需要监测肾功能和出血情况"), (3, "在正常剂量下耐受良好"), (4, "避免与肝素合用")]
    found = risk.evidence_level(spark.createDataFrame([(i,) for i in range(1, 6)], "q long"), spark.createDataFrame(rows, "q long, snippet string"), F.col("snippet"))
    assert {r.q: r.level for r in found.collect()} == {1: "High", 2: "Medium", 3: "Low", 4: "High", 5: "Unknown"}


def test_confidence(spark):
    f = lambda *x: spark.range(1).select(risk.confidence(*map(F.lit, x)).alias("c")).first().c
    assert [f("High", True, 0, 0), f("Unknown", False, 3, 0), f("Medium", False, 3, 2), f("Low", False, 9, 9)] == [0.88, 0.32, 0.72, 0.82]


def test_fusion(spark):
    key = "drug"
    lists = {"bm25": [(1, 1, "A"), (1, 2, "B")], "dense": [(1, 1, "B"), (1, 2, "C")]}
    frames = {n: spark.createDataFrame(x, "q long, rank long, drug string") for n, x in lists.items()}
    fused = retrieval.rrf(frames, [key], mine=F.col("drug") == "C")
    assert [(r.drug, r.score) for r in fused.orderBy("rank").collect()] == [("B", 0.0525), ("C", 0.0461), ("A", 0.0164)]
    ranked = retrieval.rerank(fused, F.lit(False), F.col("drug") == "C", F.lit(False))
    assert [(r.drug, r.score) for r in ranked.orderBy("rank").collect()] == [("C", 0.1261), ("B", 0.0525), ("A", 0.0164)]


def diversified(rows, limit):
    order, by = [], {}
    for x in rows:
        if x[1] not in by:
            order.append(x[1])
        by.setdefault(x[1], []).append(x)
    if len(order) <= 1:
        return rows[:limit]
    quota = max(2, limit // len(order))
    chosen = [x for c in order for x in by[c][:quota]]
    if len(chosen) < limit:
        chosen += [x for x in rows if x not in chosen][: limit - len(chosen)]
    return chosen[:limit]


def test_diversified_like_a_plain_model(spark):
    rng = random.Random(2)
    lists = {q: [(i, rng.choice("abcde"[: rng.randint(1, 5)])) for i in range(rng.randint(0, 20))] for q in range(60)}
    df = spark.createDataFrame([(q, i, c) for q, x in lists.items() for i, c in x], "q long, ord long, concept string")
    got = {}
    for r in retrieval.diversified(df, "concept", 9).orderBy("q", "position").collect():
        got.setdefault(r.q, []).append((r.ord, r.concept))
    assert got == {q: diversified(x, 9) for q, x in lists.items() if x}


# --- state -------------------------------------------------------------------------------------------


def test_metrics(spark):
    schema = "id long, created_at long, latency_ms double, risk_level string, evidence_count int, kg_relation_count int, fallback_used boolean, downgraded boolean"
    for n, index in ((1, 0), (19, 18), (20, 19), (21, 19), (100, 95), (300, 285)):
        rows = spark.createDataFrame([(i, i, float(i), "Low", 1, 2, False, i % 2 == 0) for i in range(n)], schema)
        assert metrics.snapshot(rows).first().p95_latency_ms == index
    empty = metrics.snapshot(spark.createDataFrame([], schema)).first()
    assert empty.chat_count == 0 and empty.avg_latency_ms == 0 and empty.risk_distribution == {}


def test_population_memory(spark):
    rng = random.Random(6)
    turns = [(s, t, "m", [], [x for x in ("老年人", "儿童", "哺乳期") if rng.random() < 0.3], [], []) for s in range(40) for t in range(8)]
    schema = "session_id long, turn long, message string, drugs array<string>, population array<string>, conditions array<string>, risk_factors array<string>"
    got = {(r.session_id, r.turn): r.population for r in sessions.snapshots(spark.createDataFrame(turns, schema)).collect()}
    state = {}
    for s, t, _, _, now, _, _ in turns:
        kept = state.setdefault(s, set())
        if "儿童" in now and "老年人" not in now:
            kept.discard("老年人")
        if "老年人" in now and "儿童" not in now:
            kept.discard("儿童")
        kept |= set(now)
        assert got[s, t] == sorted(kept)


# --- files -------------------------------------------------------------------------------------------


def test_ingestion(spark, tmp_path):
    (tmp_path / "warfarin.json").write_text(json.dumps([{"drug": "warfarin", "aliases": ["华法林"], "sections": [{"title": "药物相互作用", "content": "与布洛芬合用可能增加出血风险"}, {"title": "空", "content": " "}]}, {"drug": "x", "text": "flat"}], ensure_ascii=False))
    (tmp_path / "metformin.csv").write_text("﻿drug,section,content\nmetformin,禁忌,严重肾功能不全者禁用\nother,禁忌,\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "阿司匹林说明书.txt").write_text("阿司匹林可能增加出血风险，服用前请咨询医生。")
    (tmp_path / "note.md").write_text("skipped")
    docs = readers.read_documents(spark, str(tmp_path))
    chunks = readers.document_chunks(docs)
    got = {r.chunk_id: (r.drug, r.section) for r in chunks.collect()}
    assert got == {
        "warfarin.json::json::0::0::chunk::0": ("warfarin", "药物相互作用"), "warfarin.json::json::1::chunk::0": ("x", "正文"),
        "metformin.csv::csv::0::chunk::0": ("metformin", "禁忌"), "阿司匹林说明书.txt::txt::0::chunk::0": ("阿司匹林", "正文"),
    }
    report = readers.ingestion_report(readers.file_listing(spark, str(tmp_path)), docs, chunks).first()
    assert (report.files, report.skipped, report.failed, report.chunks, report.by_type) == (4, 1, 0, 4, {"csv": 1, "json": 1, "txt": 1})
    ordered = chunks.withColumn("ord", F.row_number().over(Window.partitionBy("drug").orderBy("chunk_id")))
    assert {"warfarin", "metformin"} <= {r.drug for r in knowledge.export_records(ordered).collect()}


def test_sheet(spark, tmp_path):
    for name, rows in (("a.csv", "甲\n乙\n"), ("b.csv", "丙\n"), ("~$b.csv", "锁\n")):
        (tmp_path / name).write_text("通用名称 \n" + rows)
    rows = readers.read_sheet(spark, [str(tmp_path), str(tmp_path)])
    assert sorted((r.row, r["通用名称"]) for r in rows.collect()) == [(1, "甲"), (2, "乙"), (3, "丙")]
    assert readers.read_sheet(spark, [str(tmp_path)], 2).count() == 2


def test_pages(spark):
    pages = spark.createDataFrame([("dir/布洛芬说明书.pdf", 1, "可能引起胃肠道不适"), ("dir/布洛芬说明书.pdf", 2, " ")], "file string, page int, text string")
    got = readers.document_chunks(readers.page_documents(pages)).collect()
    assert [(r.source_id, r.drug, r.page) for r in got] == [("布洛芬说明书.pdf::page::1", "布洛芬", 1)]
    assert readers.joined_pages(pages).first().text == "可能引起胃肠道不适\n\n "


@pytest.mark.parametrize(("setting", "size"), [("134217728b", 134217728), ("64m", 64 << 20), ("128MB", 128 << 20), ("1g", 1 << 30), ("77", 77)])
def test_sizes(setting, size):
    assert in_bytes(setting) == size


def test_missing_files(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_knowledge(spark, str(tmp_path / "none.json")).collect()
    assert readers.read_overrides(spark, None).count() == 0
    path = tmp_path / "c.jsonl"
    path.write_text('{"subject": "a", "relation": "INTERACTS_WITH", "object": "b", "object_type": "Drug", "confidence": 0.5}\n\n')
    assert kg.valid(readers.read_candidates(spark, str(path)), 0.6).count() == 0 and kg.valid(readers.read_candidates(spark, str(path))).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id long, turn long, message string, drugs array<string>, population array<string>, conditions array<string>, risk_factors array<string>"
    rows = spark.createDataFrame([(1, 0, "m", ["a"], ["老年人"], [], []), (1, 1, "m", ["b"], ["儿童"], ["c"], []), (2, 0, "m", [], [], ["d"], [])], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.session_states(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.session_id, r.turn): (r.drugs, r.population, r.conditions) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.session_id, r.turn): (r.drugs, r.population, r.conditions) for r in sessions.snapshots(rows).collect()}


# --- questions ---------------------------------------------------------------------------------------


def test_expansion_keeps_message_words_and_drops_repeats(spark):
    rows = spark.createDataFrame([(1, "头孢 监测", ["甲"], ["哺乳期", "外星人"], ["糖尿病"], ["出血"])], "q long, m string, d array<string>, p array<string>, c array<string>, r array<string>")
    c = F.col
    first = rows.select(questions.evidence_query(c("m"), c("p"), c("c"), c("r")).alias("x")).first().x
    assert first == "头孢 监测 哺乳 乳汁 婴儿 特殊人群 禁用 慎用 外星人 糖尿病 出血"
    second = rows.select(questions.population_query(c("m"), c("d"), c("p")).alias("x")).first().x
    assert second == "头孢 监测 甲 哺乳 乳汁 婴儿 特殊人群 禁用 慎用 外星人 孕妇及哺乳期妇女用药 警告与注意事项 用药前确认 禁忌 注意事项 用法用量"


def test_negated_groups(spark):
    asked = spark.createDataFrame([(1, "我没有吃布洛芬"), (2, "吃布洛芬，不吃别的"), (3, "没吃 药很久了现在想吃布洛芬")], "q long, message string")
    groups = spark.createDataFrame([(q, "布洛芬") for q in (1, 2, 3)], "q long, mention string")
    assert {r.q for r in questions.without_negated_groups(groups, asked).collect()} == {2, 3}


def test_population_example(spark):
    sections = spark.createDataFrame([(1, "阿魏酸哌嗪片", "禁忌", "对本品过敏者禁用"), (2, "阿魏酸哌嗪片", "老年用药", "应在专业医师指导下使用"), (3, "别的", "老年用药", "x")], "ord long, drug string, section string, content string")
    asked = spark.createDataFrame([(1, ["阿魏酸哌嗪片"], ["老年人"])], "q long, drugs array<string>, population array<string>")
    found = questions.direct_evidence(asked, sections)
    assert [(r.section, r.score) for r in found.collect()] == [("老年用药", 1.0)]
    signal = risk.population_signal(asked, found)
    assert [(r.level, r.groups) for r in signal.collect()] == [("Medium", ["老年人"])]


def test_scope_falls_back(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "q long, drug string")
    assert sorted(map(tuple, questions.scoped_if_any(rows, F.col("drug") == "a").collect())) == [(1, "a"), (2, "b")]


def test_consensus(spark):
    sections = spark.createDataFrame([(d, "药物相互作用", "与抗凝药合用可能增加出血风险。") for d in ("甲药片", "甲药颗粒")] + [("乙药片", "药物相互作用", "禁忌合用")], "drug string, section string, content string")
    groups = spark.createDataFrame([(1, "甲药", ["甲药片", "甲药颗粒"]), (2, "混", ["甲药片", "乙药片"]), (3, "缺", ["甲药片", "丙"])], "q long, concept string, candidates array<string>")
    assert {r.q: r.agreed for r in questions.consensus(groups, sections).collect()} == {1: True, 2: False, 3: False}


def test_last_group_names_the_concept(spark):
    groups = spark.createDataFrame([(1, 0, "a", ["x", "y"]), (1, 1, "b", ["y"])], "q long, i int, concept string, candidates array<string>")
    assert {(r.drug, r.concept) for r in questions.concept_of(groups).collect()} == {("x", "a"), ("y", "b")}


def test_names_fingerprint_depends_on_order(spark):
    prints = [knowledge.names_fingerprint(spark.createDataFrame(rows, "ord long, drug string, aliases array<string>")).first().fingerprint for rows in ([(0, "a", ["y", "x"]), (1, "b", None)], [(0, "a", ["x", "y"]), (1, "b", [])], [(1, "a", ["x", "y"]), (0, "b", [])])]
    assert prints[0] == prints[1] != prints[2]


@pytest.mark.parametrize("small", [50_000, 1])
def test_mentions_of_repeated_rows_and_nulls(spark, monkeypatch, small):
    monkeypatch.setattr(names, "SMALL", small)
    texts = spark.createDataFrame([(1, "red ring and blue bolt"), (1, "red ring and blue bolt"), (2, "re"), (3, None), (4, "")], "id long, t string")
    known = spark.createDataFrame([("red",), ("red ring",), ("blue bolt",), ("ring and blue bolt",), ("x",)], "name string")
    got = sorted((r.id, r.name) for r in names.mentions(texts, known, "id", "t").select("id", "name").collect())
    assert got == sorted([(1, n) for n in ("red", "red ring", "blue bolt", "ring and blue bolt")] * 2)
    assert names.mentions(texts.limit(0), known, "id", "t").count() == 0
    assert names.mentions(texts, known.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("limit_mb", [64, 0])
def test_hash_nearest_is_exact(spark, limit_mb):
    words = "alpha beta gamma delta".split()
    docs = spark.createDataFrame([(i, " ".join(words[: 1 + i % 4])) for i in range(40)] + [(40, ""), (41, None)], "ord long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "delta"), (3, "")], "q long, text string")
    both = [
        [tuple(r) for r in retrieval.top_k(f.withColumnRenamed("cosine", "score"), 5).select("q", "ord", "rank").orderBy("q", "rank").collect()]
        for f in (retrieval.hash_nearest(docs, asked, F.col("text"), F.col("text"), 5, limit_mb=limit_mb), retrieval.hash_similarity(docs, asked, F.col("text"), F.col("text")))
    ]
    assert both[0] == both[1] and [x[1] for x in both[0] if x[0] == 1] == [1, 5, 9, 13, 17]
