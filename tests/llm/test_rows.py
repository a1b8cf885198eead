"""Every operator on documents gives each row its result: null and repeated ids, repeated rows, one id with several texts,
long and empty texts, columns with clashing names, and no rows at all."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrace.llm import bpe, fingerprint, jaccard, lm, packing, quality, secrets, suffix, toxicity

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
#: Words enough for every rule, and a long text of a million characters.
_RNG = random.Random(13)
_PROSE = [" ".join("".join(_RNG.choices("abcdefghij", k=_RNG.randint(2, 7))) for _ in range(120)) for _ in range(6)]
ROWS = [
    (1, _PROSE[0]), (2, _PROSE[1]), (2, _PROSE[1]), (3, _PROSE[2]), (3, _PROSE[3] + " more"), (None, _PROSE[4]), (None, _PROSE[4]), (None, _PROSE[5]), (None, None), (4, None), (5, ""), (5, ""), (6, " \n\t"),
    (7, "long words " + " ".join(_PROSE) * 200), (8, "日本 é 🎉 " * 20), (9, "token = abcdefABCDEF0123456789"), (10, "\x00"),
]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (6, 0, 0), (None, 1, 1), (7, None, None)], LABELS)


OPERATORS = {
    "op1": lambda s, d: lm.score(d), "op2": lambda s, d: suffix.remove_repeats(d), "op4": lambda s, d: jaccard.linked_groups(d), "op6": lambda s, d: quality.judge(d, labels(s)),
    "op7": lambda s, d: fingerprint.fingerprints(d), "op8": lambda s, d: secrets.scan(d), "op9": lambda s, d: toxicity.toxicity(d, labels(s)), "op10": lambda s, d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
}


def frame(spark, rows):
    clashing = {c: F.lit("x") for c in ("id", "key", "block", "words", "n", "part", "cls", "packed", "place", "toxic", "label", "spans", "start")}
    return spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns(clashing)


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_its_result(spark, name):
    rows = [tuple(r) for r in OPERATORS[name](spark, frame(spark, ROWS)).collect()]
    assert Counter(r[0] for r in rows) == Counter(d for d, _ in ROWS)
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op2", "op4", "op6", "op8", "op9", "op10"])
def test_equal_rows_have_equal_results(spark, name):
    by_id = defaultdict(list)
    for r in OPERATORS[name](spark, frame(spark, ROWS)).collect():
        by_id[r.doc_id].append(tuple(r)[1:])
    assert len(set(map(str, by_id[2]))) == len(set(map(str, by_id[5]))) == 1
    assert len(set(map(str, by_id[None]))) <= 3


def test_pieces_of_all_rows(spark):
    rows = packing.pack(frame(spark, ROWS), public_tokenizers.path("byte_bpe_50k.json")).collect()
    firsts = Counter(r.doc_id for r in rows if r.start == 0)
    assert firsts == Counter(d for d, _ in ROWS)
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048
    assert packing.pack(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
