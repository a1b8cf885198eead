"""Registered queries of retrieval and ranking: benchmark texts as questions, documents as passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import nearest, retrieval, risk, stored_index
from ..sources import store
from .common import CORPUS, HIGH, IMPORTANT, MEDIUM, QUESTIONS, corpus, questions, sql_any, sql_in, sql_tokens, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- lexical -----------------------------------------------------------------------------------------

_BM25_TEXT = "drug || ' ' || section || ' ' || text"


def _sql_bm25(value: str, asked: str) -> str:
    return f"""{CORPUS}, {QUESTIONS},
    t AS (SELECT ord, unnest({sql_tokens(value)}) AS term FROM corpus),
    tf AS (SELECT ord, term, count(*) AS tf FROM t GROUP BY ALL),
    len AS (SELECT ord, greatest(len({sql_tokens(value)}), 1) AS n_tokens FROM corpus),
    av AS (SELECT avg(n_tokens) AS mean, count(*) AS n FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT q, unnest({sql_tokens(asked)}) AS term FROM questions),
    bm AS (SELECT qt.q, tf.ord, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_tokens / mean))) AS base
        FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (ord), av GROUP BY ALL)"""


def _sql_boosted(source: str, section: float, drug: float) -> str:
    return f"""bo AS (SELECT q.q, c.ord, coalesce(base, 0) + CASE WHEN c.section IN {sql_in(IMPORTANT)} THEN {section} ELSE 0 END
        + CASE WHEN list_contains(q.drugs, c.drug) THEN {drug} ELSE 0 END AS score
        FROM questions q CROSS JOIN corpus c LEFT JOIN {source} b ON b.q = q.q AND b.ord = c.ord)"""


def _sql_top(source: str, k: int, score: str = "score", name: str = "top") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round({score}, 9) DESC, ord) AS rank FROM {source}) WHERE rank <= {k})"""


def bm25_plain(spark, sf_dir, k=8):
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    return retrieval.top_k(retrieval.bm25(docs, asked, F.col("text"), F.col("text")).withColumnRenamed("base", "score"), k)


@query(f"WITH {_sql_bm25('text', 'text')}, {_sql_top('bm', 8, 'base')} SELECT q, ord, rank, round(base, 4) AS score FROM top")
def bm25_topk(spark, sf_dir):
    return bm25_plain(spark, sf_dir).select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def bm25_full(spark, sf_dir, k=8):
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    matched = retrieval.bm25(docs, asked, F.concat_ws(" ", "drug", "section", "text"), F.concat_ws(" ", "text", F.array_join("drugs", " ")))
    return retrieval.top_k(retrieval.boosted(matched, docs, asked, k, IMPORTANT, 0.35, 0.45), k)


_SQL_BM25_FULL = f"{_sql_bm25(_BM25_TEXT, 'text || chr(32) || drugs[1]')}, {_sql_boosted('bm', 0.35, 0.45)}"


@query(f"WITH {_SQL_BM25_FULL}, {_sql_top('(SELECT * FROM bo WHERE score > 0)', 8)} SELECT q, ord, rank, round(score, 4) AS score FROM top")
def bm25_boosted_topk(spark, sf_dir):
    return bm25_full(spark, sf_dir).select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


_SQL_TFIDF = f"""{CORPUS}, {QUESTIONS},
    t AS (SELECT ord, unnest({sql_tokens('text')}) AS term FROM corpus),
    tf AS (SELECT ord, term, count(*) AS tf FROM t GROUP BY ALL),
    df AS (SELECT term, ln((any_value(n) + 1.0) / (count(*) + 1)) + 1 AS idf FROM tf, (SELECT count(*) AS n FROM corpus) GROUP BY term),
    w AS (SELECT ord, term, tf * idf AS w FROM tf JOIN df USING (term)),
    nd AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM w GROUP BY ord),
    qt AS (SELECT q, term, count(*) AS n FROM (SELECT q, unnest({sql_tokens('text')}) AS term FROM questions) GROUP BY ALL),
    qw AS (SELECT q, term, n * coalesce(idf, 1.0) AS v FROM qt LEFT JOIN df USING (term)),
    nq AS (SELECT q, sqrt(sum(v * v)) AS own FROM qw GROUP BY q),
    co AS (SELECT qw.q, w.ord, sum(v * w) / (any_value(norm) * any_value(own)) AS base FROM qw JOIN w USING (term) JOIN nd USING (ord) JOIN nq USING (q) GROUP BY ALL)"""


@query(f"WITH {_SQL_TFIDF}, {_sql_boosted('co', 0.2, 0.25)}, {_sql_top('(SELECT * FROM bo WHERE score > 0)', 8)} SELECT q, ord, rank, round(score, 4) AS score FROM top")
def tfidf_topk(spark, sf_dir):
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    scored = retrieval.boosted(retrieval.tfidf(docs, asked, F.col("text"), F.col("text")), docs, asked, 8, IMPORTANT, 0.2, 0.25)
    return retrieval.top_k(scored, 8).select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(f"WITH {_sql_bm25('text', 'text')}, {_sql_top('bm', 8, 'base')} SELECT q, ord, rank, round(base, 4) AS score FROM top")
def index_topk(spark, sf_dir):
    """BM25 from a stored index: the rows of bm25_topk."""
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    _, index = stored_index.ensure(docs, F.col("text"), store.fresh(spark, "index"), near=["section"])
    best = stored_index.top_k(index, asked, F.col("text"), 8)
    return best.select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS part FROM documents)
    SELECT 'empty' AS place, 'built' AS outcome, part AS held FROM n UNION ALL SELECT 'complete', 'kept', part FROM n UNION ALL SELECT 'partial', CASE WHEN part < n THEN 'refused' ELSE 'kept' END, part FROM n""")
def index_cases(spark, sf_dir):
    """An empty place is built, a complete index kept, a partial one refused: English documents alone, then all of them."""
    docs, path = corpus(spark, sf_dir), store.fresh(spark, "index")
    english, outcomes = docs.where("section = 'en'"), []
    for place, wanted in (("empty", english), ("complete", english), ("partial", docs)):
        try:
            outcome = stored_index.ensure(wanted, F.col("text"), path)[0]
        except stored_index.IncompleteIndex:
            outcome = "refused"
        outcomes.append((place, outcome, stored_index.stored_documents(spark, path)))
    return spark.createDataFrame(outcomes, "place string, outcome string, held long")


# --- vectors -----------------------------------------------------------------------------------------

_PART = "('0x' || substr(md5(term), {}, 8))::BIGINT"
_BUCKET = f"(((({_PART.format(1)} % 384) * 256 + {_PART.format(9)}) % 384 * 256 + {_PART.format(17)}) % 384 * 256 + {_PART.format(25)}) % 384"


def _sql_hash(name: str, key: str, source: str) -> str:
    return f"""{name}t AS (SELECT {key}, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT {key}, unnest({sql_tokens('text')}) AS term FROM {source}) GROUP BY ALL),
    {name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}t)"""


_SQL_HASH = f"""{CORPUS}, {QUESTIONS}, {_sql_hash('hd', 'ord', 'corpus')}, {_sql_hash('hq', 'q', 'questions')},
    sim AS (SELECT q, ord, sum(hd.w * hq.w) AS cosine FROM hd JOIN hq USING (bucket) GROUP BY ALL)"""


def _hash_near(spark, sf_dir, k):
    return retrieval.hash_nearest(corpus(spark, sf_dir), questions(spark, sf_dir), F.col("text"), F.col("text"), k)


@query(f"WITH {_SQL_HASH}, {_sql_top('sim', 8, 'cosine')} SELECT q, ord, rank, round(cosine, 4) AS score FROM top")
def hash_embedding_topk(spark, sf_dir):
    best = retrieval.top_k(_hash_near(spark, sf_dir, 8).withColumnRenamed("cosine", "score"), 8)
    return best.select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def _dense_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    docs = rows.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"), "label")
    # the stated question set: ids divisible by 100
    return docs, docs.where("ord % 100 = 0").select(F.col("ord").alias("q"), "vec", "label")


_SQL_DENSE = """SELECT a.vec_id AS q, b.vec_id AS ord, list_sum(list_transform(generate_series(1, len(a.embedding)), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS cosine
    FROM embeddings a JOIN embeddings b ON {} WHERE a.vec_id % 100 = 0"""


@query(f"WITH sim AS ({_SQL_DENSE.format('true')}), {_sql_top('sim', 8, 'cosine')} SELECT q, ord, rank, round(cosine, 4) AS score FROM top")
def dense_topk(spark, sf_dir):
    best = nearest.exact(*_dense_tables(spark, sf_dir), 8)
    return best.select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(f"WITH sim AS ({_SQL_DENSE.format('a.label = b.label')}), {_sql_top('sim', 8, 'cosine')} SELECT q, ord, rank, round(cosine, 4) AS score FROM top")
def dense_topk_filtered(spark, sf_dir):
    docs, asked = _dense_tables(spark, sf_dir)
    best = retrieval.top_k(retrieval.dense(docs, asked, scope="label").withColumnRenamed("cosine", "score"), 8)
    return best.select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def _approximate(spark, sf_dir, k=8):
    docs, asked = _dense_tables(spark, sf_dir)
    index = nearest.build(docs, nearest.fit(docs))
    return nearest.search(index, asked, nearest.calibrate(index, k, 0.97), k)


@query(None)
def ann_topk(spark, sf_dir):
    """The nearest vectors by inverted lists, probed as deep as a calibrated recall of 0.97 asks."""
    return _approximate(spark, sf_dir).select("q", "ord", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("SELECT count(*) AS questions, 8 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, sf_dir):
    """Whether the lists find nine of ten of the exact nearest vectors of the question set."""
    exact = nearest.exact(*_dense_tables(spark, sf_dir), 8)
    return nearest.recall(_approximate(spark, sf_dir), exact).select("questions", "wanted", (F.col("recall") >= 0.9).alias("enough"))


# --- fusion ------------------------------------------------------------------------------------------


def _dense_list(spark, sf_dir, k):
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    return retrieval.dense_scored(_hash_near(spark, sf_dir, 3 * k), docs, asked, k, IMPORTANT)


_SQL_DENSE_LIST = f"""{_sql_hash('hd', 'ord', 'corpus')}, {_sql_hash('hq', 'q', 'questions')},
    sim AS (SELECT q, ord, sum(hd.w * hq.w) AS cosine FROM hd JOIN hq USING (bucket) GROUP BY ALL), {_sql_top('sim', 96, 'cosine', 'near')},
    dl AS (SELECT q, ord, round(1 / (2 - cosine) + CASE WHEN section IN {sql_in(IMPORTANT)} THEN 0.12 ELSE 0 END + CASE WHEN list_contains(drugs, drug) THEN 0.18 ELSE 0 END, 4) AS score
        FROM near JOIN corpus USING (ord) JOIN questions USING (q)), {_sql_top('dl', 32, 'score', 'dense')}"""

_KEY = ("drug", "section", "text")
_SQL_FUSED = f"""WITH {_SQL_BM25_FULL}, {_sql_top('(SELECT * FROM bo WHERE score > 0)', 32, 'score', 'lex')}, {_SQL_DENSE_LIST},
    ranked AS (SELECT q, ord, rank, 0 AS l FROM lex UNION ALL SELECT q, ord, rank, 1 AS l FROM dense),
    fu AS (SELECT q, drug, section, text, sum(1.0 / (60 + rank)) AS s, count(DISTINCT l) AS lists, min(l * 1000000 + rank) AS pos FROM ranked JOIN corpus USING (ord) GROUP BY ALL),
    fused AS (SELECT q, drug, section, fu.text, pos, round(s + CASE WHEN lists > 1 THEN 0.02 ELSE 0 END + CASE WHEN list_contains(drugs, drug) THEN 0.03 ELSE 0 END, 4) AS score, drugs FROM fu JOIN questions USING (q)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM fused)"""
_SQL_RERANKED = f"""{_SQL_FUSED}, rr AS (SELECT q, drug, section, text, rank AS before, round(score + CASE WHEN section IN {sql_in(IMPORTANT)} THEN 0.08 ELSE 0 END
    + CASE WHEN list_contains(drugs, drug) THEN 0.08 ELSE 0 END + CASE WHEN {sql_any('text', HIGH)} THEN 0.05 ELSE 0 END, 4) AS score FROM fr),
    re AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, before) AS rank FROM rr)"""


def fused(spark, sf_dir, dense=None):
    """BM25 and hash-vector lists of 4 k = 32 passages each, fused by rank; ``dense`` may be there already."""
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    lists = {"bm25": bm25_full(spark, sf_dir, 32), "dense": dense if dense is not None else _dense_list(spark, sf_dir, 32)}
    lists = {n: x.join(docs, "ord").join(asked.select("q", "drugs"), "q").withColumn("mine", F.array_contains("drugs", F.col("drug"))) for n, x in lists.items()}
    return retrieval.rrf(lists, [*_KEY, "mine"], mine=F.col("mine"))


def reranked(spark, sf_dir, found=None):
    return retrieval.rerank(found if found is not None else fused(spark, sf_dir), F.col("section").isin(*IMPORTANT), F.col("mine"), text.contains_any(F.col("text"), HIGH))


def _shown(ranked, k=8):
    return ranked.where(F.col("rank") <= k).select("q", "drug", "section", F.md5("text").alias("snippet"), F.col("rank").cast("long").alias("rank"), "score")


@query(f"{_SQL_FUSED} SELECT q, drug, section, md5(text) AS snippet, rank, score FROM fr WHERE rank <= 8")
def rrf_fuse(spark, sf_dir):
    return _shown(fused(spark, sf_dir))


@query(f"{_SQL_RERANKED} SELECT q, drug, section, md5(text) AS snippet, rank, score FROM re WHERE rank <= 8")
def hybrid_topk(spark, sf_dir):
    return _shown(reranked(spark, sf_dir))


# --- evidence ----------------------------------------------------------------------------------------

_SQL_LIST = f"WITH {_sql_bm25('text', 'text')}, {_sql_top('bm', 24, 'base')}, ev AS (SELECT q, rank AS ord, drug, section, text, round(base, 4) AS score FROM top JOIN corpus USING (ord))"


def evidence(spark, sf_dir, k=24):
    ranked = bm25_plain(spark, sf_dir, k).select("q", F.col("ord").alias("_d"), F.col("rank").alias("place"), F.round("score", 4).alias("score"))
    docs = corpus(spark, sf_dir).withColumnRenamed("ord", "_d")
    return ranked.join(docs, "_d").select("q", F.col("place").cast("long").alias("ord"), "drug", "section", "text", "score")


@query(_SQL_LIST + r""" SELECT q, ord, drug, section FROM (SELECT *, row_number() OVER (PARTITION BY q, section, trim(regexp_replace(substr(text, 1, 40), '^\s*\d+[.、)]\s*', '')) ORDER BY ord) AS n FROM ev) WHERE n = 1""")
def evidence_dedupe(spark, sf_dir):
    rows = evidence(spark, sf_dir).withColumn("head", F.substring("text", 1, 40))
    return retrieval.first_seen(rows, ["section"], "head").select("q", "ord", "drug", "section")


@query(_SQL_LIST + """, c AS (SELECT *, min(ord) OVER (PARTITION BY q, section) AS f, row_number() OVER (PARTITION BY q, section ORDER BY ord) AS n FROM ev),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY f) AS r FROM c), k AS (SELECT *, max(r) OVER (PARTITION BY q) AS k FROM r),
    i AS (SELECT *, n <= CASE WHEN k <= 1 THEN 12 ELSE greatest(2, 12 // k) END AS inside FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN f ELSE ord END, CASE WHEN inside THEN n ELSE 0 END) AS position FROM i)
    SELECT q, ord, section, position FROM p WHERE position <= 12""")
def diversify_topn(spark, sf_dir):
    return retrieval.diversified(evidence(spark, sf_dir), "section", 12).select("q", "ord", "section", F.col("position").cast("long").alias("position"))


@query(_SQL_LIST + f""", s AS (SELECT q, ord, round(score + CASE WHEN section = 'en' THEN 2.0 ELSE 0 END + CASE WHEN drug IN ('src1', 'src2') THEN 0.8 ELSE 0 END
    + CASE WHEN {sql_any('text', HIGH)} THEN 0.4 ELSE 0 END + CASE WHEN {sql_any('text', MEDIUM)} THEN 0.3 ELSE 0 END, 4) AS score FROM ev)
    SELECT q, ord, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord) AS position FROM s""")
def population_priority(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    out = retrieval.prioritized(rows, F.col("section") == "en", F.col("drug").isin("src1", "src2"), F.col("text"), HIGH, MEDIUM)
    return out.select("q", "ord", "score", F.col("position").cast("long").alias("position"))


@query(_SQL_LIST + f""", j AS (SELECT q, bool_or({sql_any('text', HIGH)}) AS high, bool_or({sql_any('text', MEDIUM)}) AS medium, count(*) AS n FROM ev WHERE ord <= 8 GROUP BY q)
    SELECT q.q, CASE WHEN n IS NULL THEN 'Unknown' WHEN high THEN 'High' WHEN medium THEN 'Medium' ELSE 'Low' END AS level, coalesce(n, 0) AS n_evidence,
    CAST(CASE WHEN n IS NULL THEN 0.32 ELSE round(least(0.82, 0.48 + 0.06 * least(n, 5)), 2) END AS DOUBLE) AS confidence FROM questions q LEFT JOIN j USING (q)""")
def bm25_evidence_risk(spark, sf_dir):
    """Each question's level from the words of its eight best passages, and the confidence in it."""
    rows = evidence(spark, sf_dir, 8)
    levels = risk.evidence_level(questions(spark, sf_dir).select("q"), rows, F.col("text"), HIGH, MEDIUM)
    score = risk.confidence(F.col("level"), F.lit(False), F.col("n_evidence"), F.lit(0))
    return levels.select("q", "level", "n_evidence", score.alias("confidence"))
