"""The stages of corpus_pipeline, each against what its operator's contract says about its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from terrace.llm import common

from .test_llm import linked, without_repeats

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


def test_stages_keep_their_columns(spark, docs):
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = common.cut(stage(spark, kept, SF))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert kept.where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, kept, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert pipeline.run(spark, SF).count() > 0


def test_one_of_each_group_stays(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in pipeline.jaccard_stage(spark, docs, SF).collect()}
    assert kept == {d for d, (_, root) in linked(rows).items() if d == root}


def test_repeats_go(spark, docs):
    rows = docs.where("doc_id < 80")
    want = {d: n - gone for d, n, gone, _, _ in without_repeats([(r.doc_id, r.text) for r in rows.collect()], 100)}
    got = {r.doc_id: r.text for r in pipeline.suffix_stage(spark, rows, SF).collect()}
    assert set(got) == set(want) and all(want[d] - 8 <= len(t.encode()) <= want[d] for d, t in got.items())


def test_secrets_go_and_documents_stay(spark):
    rows = spark.createDataFrame([(1, "a token=abcdef0123456789abcdef z", "en", "s", 32), (2, "clean", "en", "s", 5), (3, None, None, None, None)], DOCUMENT)
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.secrets_stage(spark, rows, SF).collect()}
    assert got == {1: ("a [SECRET] z", 12), 2: ("clean", 5), 3: ("", 0)}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "no id", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3), (4, "x y", "en", "s", 3)], DOCUMENT)
    kept = common.cut(pipeline.jaccard_stage(spark, rows, SF))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3]
    assert pipeline.suffix_stage(spark, rows, SF).count() == 6
    assert pipeline.toxicity_stage(spark, rows, SF).count() == 6
    empty = rows.where(F.lit(False))
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in pipeline.STAGES)


def test_rows_without_ids_or_with_one_id_stay(spark):
    near = " ".join(f"w{i}" for i in range(60))
    texts = [(None, "one two three four five six"), (None, "six five four three two one"), (7, "a b c d e f"), (7, "f e d c b a"), (None, near), (None, near + " x"), (9, near + " y"), (None, "only here " + near[::-1]), (None, "only here " + near[::-1] + " z")]
    rows = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], DOCUMENT)
    kept = sorted((r.doc_id or 0, r.text) for r in pipeline.jaccard_stage(spark, rows, SF).collect())
    assert len(kept) == 6 and [t for d, t in kept if d] == ["a b c d e f", "f e d c b a", near + " y"]
    assert {"one two three four five six", "six five four three two one"} < {t for d, t in kept if not d}
