"""What must not grow with the square of a table: rows that questions meet, and that are shuffled for them."""

import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import chunking, kg, names, questions, retrieval, risk, stored_index
from terrace.plans import consultation_queries, graph_queries, registry, retrieval_queries, state_queries, text_queries
from terrace.plans.common import table
from terrace.sources import readers
from terrace.streaming import streams

OLD, YOUNG = "older", "younger"
LISTS = {"match": ((OLD, ("old",)), (YOUNG, ("kid",))), "titles": ((OLD, ("T0",)), (YOUNG, ("T1",))), "high": ("stop",), "medium": ("care",)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *by):
    return sorted(tuple(r[c] for c in by or df.columns) for r in df.collect())


def passages(spark, n):
    rng = random.Random(5)
    some = lambda: f"{rng.choice(['', '1. ', '2) '])}{rng.choice(['old', 'kid', 'old kid', 'none'])} {rng.choice(['stop', 'care', ''])} {rng.randrange(30)}"
    data = [(i, f"s{i % 2}", f"d{i % 3}", f"T{i % 4}", some()) for i in range(n)]
    return spark.createDataFrame(data, "ord long, source string, drug string, section string, snippet string")


@pytest.mark.parametrize("seed", [1, 2])
def test_first_direct_rows_give_the_assembly_of_all(spark, seed):
    """few direct rows a question, and the same evidence as from every passage about its population."""
    docs, rng = passages(spark, 1500), random.Random(seed)
    asked = spark.createDataFrame([(q, rng.sample([OLD, YOUNG, "other"], q % 3), rng.sample(["d0", "d1", "d2"], 1 + q % 3)) for q in range(9)], "q long, population array<string>, drugs array<string>")
    found = docs.where("ord % 37 = 5").crossJoin(asked.select("q", "drugs")).where("array_contains(drugs, drug)").drop("drugs").withColumn("score", F.lit(0.2) + F.col("ord") / 500)
    sections = docs.withColumnRenamed("snippet", "content")
    every = questions.direct_evidence(asked, sections, match=LISTS["match"], titles=LISTS["titles"]).join(docs.select("ord", "source"), "ord").select(*found.columns)
    few = questions.first_direct(asked, sections, found.where("length(snippet) > 0"), 12, **LISTS).select(*found.columns)
    assert few.count() < every.count() / 3
    want, got = (rows(questions.assemble(found, x, asked, None, 12, **LISTS), "q", "position", "source", "drug", "section", "snippet", "score") for x in (every, few))
    assert want == got and len(want) > 60


def test_boosts_keep_the_best_of_each_question(spark):
    """of a question that matches all documents, only what can be among the k best goes on."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, f"d{i % 5}", f"s{i % 2}") for i in range(400)], "ord long, drug string, section string")
    asked = spark.createDataFrame([(q, [f"d{q}"]) for q in range(4)], "q long, drugs array<string>")
    base = {(q, o): round(rng.random(), 2) for q in range(4) for o in range(400) if o % 7}
    matched = spark.createDataFrame([(q, o, b) for (q, o), b in base.items()], "q long, ord long, base double")
    got = retrieval.boosted(matched, docs, asked, 8, ["s1"], 0.35, 0.45)
    assert got.count() <= 4 * 8 * 4
    want = []
    for q in range(4):
        scores = {o: base.get((q, o), 0.0) + (0.35 if o % 2 else 0) + (0.45 if o % 5 == q else 0) for o in range(400)}
        want += [(q, o, i + 1) for i, o in enumerate(sorted(scores, key=lambda o: (-round(scores[o], 9), o))[:8])]
    assert rows(retrieval.top_k(got, 8), "q", "ord", "rank") == sorted(want)


def test_evidence_asks_no_graph(spark, monkeypatch):
    """the evidence needs no candidates of the graph."""

    def refuse(*a, **k):
        raise AssertionError("the graph is built")

    monkeypatch.setattr(consultation_queries.kg, "candidates", refuse)
    assert "position" in consultation_queries.QUERIES["consultation_evidence"](spark, "/root/testdata/sf0.001").columns


def test_candidates_shuffle_no_sentence(spark):
    """neither a join on sentences nor their text in a shuffle; a name that is a class as well is a class, once."""
    text = "alpha and beta and aspirin stop. " + "x" * 900
    docs = spark.createDataFrame([(1, "drugX", "inter", text), (2, "drugX", "inter", text), (None, "drugY", "inter", text)], "ord long, drug string, title string, text string")
    names = spark.createDataFrame([("alpha", "A"), ("beta", "A"), ("aspirin", "nsaid")], "name string, canonical string")
    found = kg.candidates(docs, names, interaction="inter", safety=("inter",), split=lambda c: F.array(c), classes=(("nsaid", ("aspirin",)),), tables=(), shown=0, high=("stop",), medium=("care",), action=("go",), idle=("ou",))
    assert rows(found, "subject", "object", "object_type", "risk_level", "evidence_text") == [(s, o, t, "High", "") for s in ("drugX", "drugY") for o, t in (("A", "Drug"), ("nsaid", "DrugClass"))]
    assert found.where("subject = 'drugX'").agg(F.max("ord")).first()[0] == 1
    assert "SortMergeJoin" not in plan(found)


def test_questions_meet_the_first_edges_of_a_node(spark):
    """no question meets all edges of a node; repeated edges count once, the heaviest."""
    rng = random.Random(4)
    data = [("Drug", f"n{i % 200}", "BELONGS_TO", "DrugClass", f"hub{i % 2}", rng.choice([0.8, 1.1, 1.3, None])) for i in range(600)] + [("DrugClass", "hub0", "R", "DrugClass", "hub1", 0.9), ("DrugClass", "hub0", "R", "DrugClass", "hub0", 1.2)]
    edges = spark.createDataFrame(data, "s_label string, s_name string, rel string, o_label string, o_name string, weight double")
    asked = spark.createDataFrame([(q, [["hub0"], ["HUB1", "hub0"], ["n3", "hub1"]][q % 3]) for q in range(60)], "q long, entities array<string>")
    got = kg.neighbours(asked, kg.nodes_of(edges), edges, 5)
    best = {}
    for *key, w in data:
        best[tuple(key)] = max(best.get(tuple(key), 0), 1.0 if w is None else w)
    want = []
    for q in range(60):
        names = [{"hub0"}, {"hub0", "hub1"}, {"n3", "hub1"}][q % 3]
        hits = sorted((-w, k[1], k[2], k[4]) for k, w in best.items() if k[1] in names or k[4] in names)[:5]
        want += [(q, i + 1, s, r, o) for i, (_, s, r, o) in enumerate(hits)]
    assert rows(got, "q", "ord", "subject", "rel", "object") == sorted(want)
    got.select("q", "ord").write.format("noop").mode("overwrite").save()
    met = got._jdf.queryExecution().optimizedPlan().toString()
    assert met.count("row_number") >= 3  # one limit at each end of a node before the join, one by question


def test_first_pairs_are_not_sorted(spark):
    """the first pair is kept as pairs pass; no window over all of them."""
    rules = spark.createDataFrame([("a", "b", "High", 1), ("b", "a", "Low", 2), ("c", "d", "Medium", 3)], "left string, right string, risk_level string, ord long")
    asked = spark.createDataFrame([(1, ["x", "d", "b", "c", "a"]), (2, ["a", "a"]), (3, ["b", "a", "b"])], "q long, drugs array<string>")
    got = risk.first_pair(asked, risk.last_rules(rules))
    assert rows(got, "q", "left", "right", "risk_level") == [(1, "d", "c", "Medium"), (3, "b", "a", "Low")]
    concepts = spark.createDataFrame([(1, 0, ["b", "d"]), (1, 1, ["c", "a"]), (2, 0, ["a", "b"])], "q long, i int, candidates array<string>")
    across = risk.first_pair_across(concepts, risk.last_rules(rules))
    assert rows(across, "q", "left", "right", "risk_level") == [(1, "b", "a", "Low")]
    assert "Window" not in plan(got) and "Window" not in plan(across)


@pytest.mark.parametrize(("gap", "level"), [(15, 1), (16, 0)])
def test_condition_window_reaches_as_far_in_sql(spark, tmp_path, gap, level):
    """a word lies wholly within 18 characters before a term in both, 15 between the two."""
    docs = [(1, "ein" + "x" * gap + "the asked", "en", "src1", 30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, "asked")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = registry.queries()["condition_signal"](spark, str(tmp_path)).count()
    assert got == len(con.execute(registry.oracle_sql()["condition_signal"]).fetchall()) == level


def test_tfidf_gathers_no_terms(spark):
    """cosines as plain counts give them, without a list of terms for a document."""
    import math
    from collections import Counter

    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    asked = [(1, "aa bb zz"), (2, "dd dd"), (3, "zz")]
    got = retrieval.tfidf(spark.createDataFrame(docs, "ord long, text string"), spark.createDataFrame(asked, "q long, text string"), F.col("text"), F.col("text"))
    tf = {i: Counter(t.split()) for i, t in docs}
    idf = {w: math.log(41 / (sum(w in c for c in tf.values()) + 1)) + 1 for c in tf.values() for w in c}
    want = {}
    for q, t in asked:
        v = {w: n * idf.get(w, 1.0) for w, n in Counter(t.split()).items()}
        for i, c in tf.items():
            if any(w in c for w in v):
                want[q, i] = sum(v[w] * c[w] * idf[w] for w in v if w in c) / math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()) * sum(x * x for x in v.values()))
    assert {(r.q, r.ord): r.base for r in got.collect()} == pytest.approx(want)
    assert "collect_list" not in plan(got)


def test_chunks_work_on_a_text_once(spark):
    """F8: the section is told, and the text cleaned, before a document is cut, not for each of its chunks."""
    pages = spark.createDataFrame([("d/a.pdf", 1, "x y " * 900 + "\U0001f600 副作用 " * 200)], "file string, page int, text string")
    chunks = readers.document_chunks(readers.page_documents(pages))
    lines = chunks._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert not any("副作用" in x for x in lines[:cut]) and not any("Filter" in x and "transform" in x for x in lines)
    body = pages.first().text.strip()
    want = [body[i : i + 700].strip() for i in range(0, len(body), 600)]
    assert [r.text for r in chunks.orderBy(F.length("chunk_id"), "chunk_id").collect()] == want and chunks.first().section == "不良反应"


@pytest.mark.parametrize(("size", "overlap"), [(7, 2), (6, 3), (6, 0), (6, 5)])
def test_windows(spark, size, overlap):
    """F8: in one pass, and the same windows."""
    texts = ["", "a\n\U0001f600" * 9, "abcdef", "abcdefg", "字" * 20, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.windows(F.col("t"), size, overlap).alias("w")).orderBy("i").collect()
    cut = lambda t: [t] if t is None or len(t) <= size else [t[i : i + size] for i in range(0, len(t), size - overlap)]
    assert [r.w for r in got] == [cut(t) for t in texts]


def test_structured_chunks_work_on_a_text_once(spark):
    """each step over a text or its items stands in the plan once, and long units are cut as before."""
    body = "1.儿童禁止使用。2." + "12 01 " * 120
    sections = spark.createDataFrame([("d", "正文", [body]), ("d", "正文", ["短"]), ("d", "正文", [None])], "k string, title string, texts array<string>")
    got = chunking.structured_chunks(sections)
    steps = got._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("[一二三四五六七八九十]") == 1 and not any("Filter" in x and "aggregate" in x for x in steps.splitlines())
    unit = ("12 01 " * 120).strip()
    want = ["儿童禁止使用。", *[unit[i : i + 360].strip(" ") for i in range(0, len(unit), 360)], "短"]
    assert [r.text for r in got.collect()] == want


@pytest.mark.parametrize("held", [1 << 21, 7])
def test_cosines_are_held_for_some_questions_at_a_time(spark, monkeypatch, held):
    """a task's memory does not grow with the product of its documents and the questions; the nearest stay the same."""
    monkeypatch.setattr(retrieval, "HELD", held)
    assert all((p.stop - p.start) * 5 <= max(held, 5) for p in retrieval.question_parts(9, 5))
    assert sorted(i for p in retrieval.question_parts(9, 5) for i in range(p.start, p.stop)) == list(range(9))
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(["drug", "dose", "risk", "care", "stop", "old"]) + str(rng.randrange(9)) for _ in range(n))
    docs = spark.createDataFrame([(i, some(12)) for i in range(300)], "ord long, text string").coalesce(2)
    asked = spark.createDataFrame([(q, some(4)) for q in range(9)], "q long, asked string")
    near = retrieval.hash_nearest(docs, asked, F.col("text"), F.col("asked"), 5).withColumnRenamed("cosine", "score")
    exact = retrieval.hash_similarity(docs, asked, F.col("text"), F.col("asked")).withColumnRenamed("cosine", "score")
    assert rows(retrieval.top_k(near, 5), "q", "ord", "rank") == rows(retrieval.top_k(exact, 5), "q", "ord", "rank")


def test_bm25_makes_tokens_once(spark):
    """lengths, frequencies and counts come from one table."""
    docs = spark.createDataFrame([(1, "drug dose dose"), (2, "drug"), (3, None), (4, "")], "ord long, text string")
    asked = spark.createDataFrame([(1, "dose drug dose")], "q long, asked string")
    found = retrieval.bm25(docs, asked, F.col("text"), F.col("asked"))
    assert "lower(text" not in plan(found)
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    weight = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 1.5))
    want = {1: 2 * idf(1) * weight(2, 3) + idf(2) * weight(1, 3), 2: idf(2) * weight(1, 1)}
    assert {r.ord: r.base for r in found.collect()} == pytest.approx(want)


def test_index_makes_tokens_once(spark, tmp_path, monkeypatch):
    """Lengths, frequencies and postings come from one written table of counts."""
    made = []
    monkeypatch.setattr(stored_index.store, "written", lambda df, name="table", f=stored_index.store.written: made.append(name) or f(df, name))
    docs = spark.createDataFrame([(1, "a", "drug dose dose"), (2, "b", "drug"), (3, "a", None), (4, "b", "")], "ord long, section string, text string")
    index = stored_index.build(docs, F.col("text"), f"file://{tmp_path}/index", near=["section"])
    assert made.count("counts") == 1
    stats = index.stats.first()
    assert (stats.n, stats.mean) == (4, 1.5)
    got = {r.term: (r.df, r.ords, r.tfs, r.lens) for r in index.postings.collect()}
    assert got == {"drug": (2, [1, 2], [1, 1], [3, 1]), "dose": (1, [1], [2], [3])}


def test_ablation_makes_each_list_once(spark, monkeypatch):
    """three variants share the lists of vectors and of words."""
    made = []
    for name in ("_dense_list", "bm25_full"):
        monkeypatch.setattr(retrieval_queries, name, lambda *a, n=name, f=getattr(retrieval_queries, name), **b: made.append(n) or f(*a, **b))
    state_queries._evaluated(spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["_dense_list", "bm25_full"]


def test_edges_meet_their_candidates_once(spark, monkeypatch, tmp_path):
    """a delivery has a file for each task, and new candidates are not aggregated before they meet the stored edges."""
    calls = []
    monkeypatch.setattr(streams, "last_of_edges", lambda rows, f=streams.last_of_edges: calls.append(1) or f(rows))
    monkeypatch.setattr(state_queries.store, "fresh", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = state_queries.QUERIES["stream_edges"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "edges" / "in").rglob("*.parquet"))
    assert len(files) >= 3 * 8 and len(calls) == 3
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_discount * 10 >= 0.2").count()
    assert got.agg(F.sum("n_candidates")).first()[0] == lines


def test_texts_of_fewer_splits_than_cores_are_dealt_out(spark):
    """a table of two splits is not left to two tasks, and its rows are not sorted for that."""
    path = "/root/testdata/sf0.001"
    size = spark.read.format("binaryFile").load(f"{path}/documents.parquet").first().length
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size // 2 + 1))
    try:
        docs = table(spark, path, "documents")
        assert docs.rdd.getNumPartitions() == 24 and "hashpartitioning(doc_id" in plan(docs)
        assert rows(docs.select("doc_id", "text")) == rows(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"))
    finally:
        spark.conf.set(name, before)


def test_candidates_split_a_text_once(spark):
    """no filter asks for the size of the split text or of the tags."""
    found = plan(graph_queries._candidates(spark, "/root/testdata/sf0.001"))
    assert "size(filter(transform(split" not in found.replace(" ", "") and "RLIKE" not in found


def test_terms_are_counted_in_small_parts_of_documents(spark, monkeypatch):
    """partitions go with the table's size, and counts are not shuffled after the texts."""
    monkeypatch.setattr(text_queries, "_PIECE", "2k")
    size = spark.read.format("binaryFile").load("/root/testdata/sf0.001/documents.parquet").first().length
    found = text_queries.QUERIES["doc_term_freq"](spark, "/root/testdata/sf0.001")
    assert plan(found).count("hashpartitioning") == 1 and "hashpartitioning(doc_id#" in plan(found) and f", {-(-size // 2048)})" in plan(found)


def test_a_page_is_cleaned_in_two_passes(spark):
    """one pattern for line ends and one for blanks, one for the windows, and the same texts as by four patterns in turn."""
    rng = random.Random(22)
    texts = ["".join(rng.choice(x) for _ in range(rng.randrange(26))) for x in ("\r\n\t -1a", "\n -12", "\n\n\n 1-", "a \t\n\r\x0b1-\U0001f600字") for _ in range(500)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: r.c for r in docs.select("i", text.clean_page(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        for pattern, by in (("\r\n?", "\n"), (r"\n\s*-?\s*\d+\s*-?\s*\n", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
            t = re.sub(pattern, by, t, flags=re.ASCII)
        assert got[i] == t.strip(text._BLANKS), texts[i]
    assert got[-1] is None
    steps = plan(chunking.page_chunks(docs, "i", "t"))
    assert steps.count("regexp_extract_all") == 1 and "{3,}" not in steps and "[ \\t]+" not in steps


def test_a_run_of_line_ends_is_not_tried_in_parts(spark):
    """this took minutes, as white space around a missing page number was split in all ways."""
    began = time.monotonic()
    odd = spark.createDataFrame([("a" + "\n" * 3000 + "b",)], "t string").select(text.clean_page(F.col("t")).alias("c")).first()
    assert odd.c == "a\n\nb" and time.monotonic() - began < 20


def test_deliveries_are_read_from_the_table_once(spark, monkeypatch):
    """what comes again is the first delivery; no delivery ends with a batch without data."""
    read, batches, run = spark.sparkContext.accumulator(0), [], streams.run_available
    seen = F.udf(lambda _: read.add(1) or True, "boolean")
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    monkeypatch.setattr(state_queries, "table", lambda *a: table(*a).where(seen("doc_id")))

    def counted(stream, path, checkpoint, **more):
        run(stream, path, checkpoint, **more)
        batches.append(spark.read.format("binaryFile").load(f"{checkpoint}/commits/*").count())

    monkeypatch.setattr(streams, "run_available", counted)
    got = state_queries.QUERIES["stream_ingest_once"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert read.value == docs.count() and batches == [1, 2, 3] and spark.conf.get(name) == before
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunking.page_chunks(docs, "doc_id", "text").collect()))


@pytest.mark.parametrize("many", [4_000_000, 0])
def test_many_names_meet_texts_in_the_task(spark, monkeypatch, many):
    """r04 F1: beyond ``SMALL`` names no text is shuffled, nor its pieces; beyond ``MANY`` the join finds the same."""
    monkeypatch.setattr(names, "SMALL", 1)
    monkeypatch.setattr(names, "MANY", many)
    rng = random.Random(8)
    known = {"".join(rng.choices("甲乙aé", k=rng.randint(2, 12))): f"c{i % 5}" for i in range(60)}
    texts = [(i, "".join(rng.choices("甲乙aé ", k=rng.randint(0, 200)))) for i in range(40)] + [(98, None), (99, "")]
    frame, dictionary = spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame([*known.items(), ("甲乙", None), ("甲", "one")], "name string, canonical string")
    got = names.canonicals(frame, dictionary, "id", "t")
    want = {(i, c) for i, t in texts for n, c in known.items() if n in (t or "")}
    assert {(r.id, c) for r in got.collect() for c in r.canonicals} == want and len(want) > 40
    first = names.hits(frame, dictionary.where("canonical is not null"), "id", "t", True)
    assert {(r.id, r.name, r.start) for r in first.collect()} == {(i, n, t.index(n)) for i, t in texts for n in known if n in (t or "")}
    if many:
        assert got.count() == len(texts) and not any(re.search(r"Exchange hash|Join|Generate", plan(x)) for x in (got, first))


def test_sentences_are_dealt_out_before_their_objects(spark):
    """r04 F1, F2: a sentence of many objects is one row of the shuffle; of copies the first counts, object by object."""
    words = [f"name{chr(97 + i)}" for i in range(20)]
    same = "stop " + "y" * 80
    texts = [(i, "drugX", "inter", t) for i, t in enumerate([" ".join(words) + " stop", " ".join(words) + " stop", same + " namea", same + " namea nameb", same + " aspirin", "stop"])]
    docs = spark.createDataFrame([texts[0], *texts[:0:-1]], "ord long, drug string, title string, text string").coalesce(1)
    found = kg.candidates(docs, spark.createDataFrame([(w, w.upper()) for w in words], "name string, canonical string"), interaction="inter", safety=("inter",), split=lambda c: F.array(c), classes=(("nsaid", ("aspirin",)),), tables=(), high=("stop",), medium=(), action=("go",), idle=("ou",))
    want = {(0, w.upper()) for w in words} | {(2, "NAMEA"), (3, "NAMEB"), (4, "nsaid")}
    assert rows(found, "ord", "object") == sorted(want)
    wording = {"interaction": "inter", "safety": ("inter",), "split": lambda c: F.split(c, "/"), "classes": (), "tables": (), "high": ("stop",), "medium": (), "action": ("go",), "idle": ("ou",)}
    cut = spark.createDataFrame([(1, "X", "inter", "namea stop/nameb stop/namec stop"), (2, "X", "inter", "nameb stop/named stop"), (3, "X", "inter", "named namee stop"), (4, "Y", "inter", "nameb stop")], "ord long, drug string, title string, text string")
    every, opening = (kg.candidates(cut, spark.createDataFrame([(w, w.upper()) for w in words], "name string, canonical string"), opening=o, **wording) for o in (False, True))
    assert rows(opening, "ord", "_i", "object") == rows(every.where("_i = 0"), "ord", "_i", "object") == [(1, 0, "NAMEA"), (3, 0, "NAMED"), (3, 0, "NAMEE"), (4, 0, "NAMEB")]
    nodes = re.findall(r"Generate|Exchange hashpartitioning|MapInArrow", plan(found))
    assert nodes[:3] == ["Generate", "Exchange hashpartitioning", "MapInArrow"]  # from the result down


@pytest.mark.parametrize(("frequent", "longest"), [(200_000, 64), (3, 64), (0, 64), (200_000, 2)])
def test_tfidf_shuffles_no_text(spark, monkeypatch, frequent, longest):
    """r04 F2: norms of frequent and of rare terms, together as plain counts give them; no token is exploded or dealt out."""
    monkeypatch.setattr(retrieval, "FREQUENT", frequent)
    monkeypatch.setattr(retrieval, "LONGEST", longest)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "d1d", f"e{i}", "ffff"]) for _ in range(rng.randrange(0, 15)))) for i in range(30)] + [(30, None), (31, "...")]
    asked = spark.createDataFrame([(1, "aa bb zz"), (2, "d1d e3"), (3, "zz"), (4, None)], "q long, text string")
    frame = spark.createDataFrame(docs, "ord long, text string")
    got = retrieval.tfidf(frame, asked, F.col("text"), F.col("text"))
    found = {(r.q, r.ord): r.base for r in got.collect()}
    dealt = {(r.q, r.ord): r.base for r in retrieval._tfidf_dealt(frame, asked, F.col("text"), F.col("text")).collect()}
    assert found == pytest.approx(dealt) and len(found) > 30
    assert "Generate" not in plan(got) and "_t#" not in plan(got)
    # rows of one ord are one document
    cut = spark.createDataFrame([(i, x) for i, t in docs for x in ((t or "").split() or [""])], "ord long, text string")
    parts, merged = ({(r.q, r.ord): r.base for r in f(cut, asked, F.col("text"), F.col("text")).collect()} for f in (retrieval.tfidf, retrieval._tfidf_dealt))
    assert parts == pytest.approx(merged) and parts.keys() == found.keys()
