"""Registered queries of the whole chain of a question: benchmark texts as questions, documents as passages.

Nothing is dealt by number: names are words that documents begin with, each standing for the source that has it first; the
graph holds what the documents' sentences say about those names, the pair rules what first sentences say.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..operators import consultation, kg, names
from ..sources import store
from . import graph_queries as gq
from . import retrieval_queries as rq
from .common import HIGH, MEDIUM, sql_any, sql_in, sql_tokens, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ADDED, _TITLES = {"older": ("old", "age", "dose"), "younger": ("child", "dose")}, {"older": ("EN",), "younger": ("FR", "DE")}
_MATCH, _NEAR = {"older": ("these", "there"), "younger": ("und", "que")}, {"thin": ("thin",), "thing": ("thing",), "tion": ("tion ",)}
WORDING = consultation.Wording(
    important=("DE", "ES"), risky=HIGH, negations=(("nicht", 6),), populations=(("that", "older"), ("und", "younger"), ("que", "younger")), conditions=tuple(_NEAR), risks=("er", "es"),
    population_query=tuple(_ADDED.items()), population_titles=tuple(_TITLES.items()), population_match=tuple(_MATCH.items()), population_tail=("end",), population_high=HIGH, population_medium=MEDIUM,
    condition_match=tuple(_NEAR.items()), condition_high=("wh",), condition_medium=("ness",), evidence_high=HIGH, evidence_medium=MEDIUM,
)


def passages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("ord"), F.lit("documents").alias("source"), F.col("source").alias("drug"), F.upper("lang").alias("section"), "text", F.substring("text", 1, 320).alias("snippet"))


def dictionary(spark, sf_dir):
    """Words of five to eight letters that documents begin with, for the source that has them first."""
    word = F.nullif(F.regexp_extract(F.lower("text"), "[a-z]{5,8}", 0), F.lit(""))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("drug"), F.array_compact(F.array(word)).alias("aliases"))
    return names.alias_dictionary(records)


def _stated(spark, sf_dir, known, **how):
    found = kg.candidates(
        gq._sections(spark, sf_dir), known, interaction="interactions", safety=("interactions", "cautions"), classes=(("classA", ("thing", "tion")),), tables=(("Condition", gq._TAGS),),
        shown=0, high=("enti", "qui "), medium=("tion", "ein"), action=("the",), idle=("ou",), **how,
    )
    return found.drop("evidence_text")


def rules_of(found):
    """The pair rules that first sentences state."""
    return found.where("_i = 0 and object_type = 'Drug'").select(F.col("subject").alias("left"), F.col("object").alias("right"), "risk_level", F.lit(None).cast("string").alias("mechanism"), F.lit(None).cast("string").alias("recommendation"), "ord")


def graph(spark, sf_dir, known):
    """(rules, nodes, edges) that the documents state."""
    # written once for rules and edges; no answer shows a candidate's text
    found = store.written(_stated(spark, sf_dir, known), "candidates").withColumn("_o", F.struct("ord", "_i"))
    edges = kg.upsert_edges(found, "_o")
    return rules_of(found), kg.nodes_of(edges), edges


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("message"))


def _answers(spark, sf_dir):
    known = store.written(dictionary(spark, sf_dir), "names").select("name", "canonical")
    rules, nodes, edges = graph(spark, sf_dir, known)
    edges, rules = store.written(edges, "edges"), store.written(rules, "rules")
    return consultation.consult(asked(spark, sf_dir), known, passages(spark, sf_dir), rules, kg.nodes_of(edges), edges, WORDING)


# --- SQL ---------------------------------------------------------------------------------------------

_DICT = """dict AS (SELECT DISTINCT lower(source) AS name, source AS canonical FROM documents UNION ALL
    SELECT word, arg_min(source, doc_id) FROM (SELECT regexp_extract(lower(text), '[a-z]{5,8}') AS word, source, doc_id FROM documents) WHERE word <> '' AND word NOT IN (SELECT lower(source) FROM documents) GROUP BY word)"""

_EXTRACT = f"""mention AS (SELECT DISTINCT item_id AS q, canonical FROM benchmark JOIN dict ON contains(lower(text), name)),
    negated AS (SELECT DISTINCT item_id AS q, canonical FROM benchmark JOIN dict ON length(name) <= 6 AND regexp_matches(text, 'nicht(?s:.{{0,' || greatest(6 - length(name), 0) || '}})(?i:' || name || ')')),
    named AS (SELECT q, list_sort(list(canonical)) AS drugs FROM (SELECT * FROM mention EXCEPT SELECT * FROM negated) GROUP BY q),
    x AS (SELECT item_id AS q, text AS message, coalesce(drugs, []) AS drugs, len(coalesce(drugs, [])) AS n,
        list_filter([CASE WHEN contains(text, 'that') THEN 'older' END, CASE WHEN {sql_any('text', ('und', 'que'))} THEN 'younger' END], lambda v: v IS NOT NULL) AS population,
        list_filter([CASE WHEN contains(text, 'thin') AND NOT contains(text, 'thing') THEN 'thin' END, CASE WHEN contains(text, 'thing') THEN 'thing' END, CASE WHEN contains(text, 'tion') THEN 'tion' END], lambda v: v IS NOT NULL) AS conditions,
        list_filter([CASE WHEN contains(text, 'er') THEN 'er' END, CASE WHEN contains(text, 'es') THEN 'es' END], lambda v: v IS NOT NULL) AS risks FROM benchmark LEFT JOIN named ON q = item_id)"""

_OLD, _YOUNG = "list_contains(population, 'older')", "list_contains(population, 'younger')"
_POP_WORDS = f"CASE WHEN {_OLD} AND {_YOUNG} THEN 'old age dose child' WHEN {_OLD} THEN 'old age dose' WHEN {_YOUNG} THEN 'child dose' ELSE '' END"
_POP_TITLES = f"CASE WHEN {_OLD} THEN 'EN ' ELSE '' END || CASE WHEN {_YOUNG} THEN 'FR DE' ELSE '' END"
_ASKS = f"""asks AS (SELECT q || ':0' AS q, q AS question, 0 AS kind, drugs, least(greatest(8, 2 * n), 24) AS k, message || ' ' || {_POP_WORDS} || ' ' || array_to_string(list_concat(conditions, risks), ' ') AS text FROM x
    UNION ALL SELECT q || ':1', q, 1, drugs, 12, message || ' ' || array_to_string(drugs, ' ') || ' ' || {_POP_WORDS} || ' ' || {_POP_TITLES} || ' end' FROM x WHERE len(population) > 0 AND n > 0)"""
_PASSAGES = "corpus AS (SELECT doc_id AS ord, 'documents' AS source, source AS drug, upper(lang) AS section, text, substr(text, 1, 320) AS snippet FROM documents)"


def _top(source: str, name: str, limit: str, score: str = "score") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round({score}, 9) DESC, ord) AS rank FROM {source}) WHERE rank <= {limit})"


_VALUE = "drug || ' ' || section || ' ' || text"
_RETRIEVED = f"""t AS (SELECT ord, unnest({sql_tokens(_VALUE)}) AS term FROM corpus), tf AS (SELECT ord, term, count(*) AS tf FROM t GROUP BY ALL),
    len AS (SELECT ord, greatest(len({sql_tokens(_VALUE)}), 1) AS n_tokens FROM corpus), av AS (SELECT avg(n_tokens) AS mean, count(*) AS n FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT q, unnest({sql_tokens("text || ' ' || array_to_string(drugs, ' ')")}) AS term FROM asks),
    bm AS (SELECT qt.q, tf.ord, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_tokens / mean))) AS base FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (ord), av GROUP BY ALL),
    bo AS (SELECT a.q, c.ord, a.k, coalesce(base, 0) + CASE WHEN c.section IN {sql_in(WORDING.important)} THEN 0.35 ELSE 0 END + CASE WHEN list_contains(a.drugs, c.drug) THEN 0.45 ELSE 0 END AS score
        FROM asks a CROSS JOIN corpus c LEFT JOIN bm b ON b.q = a.q AND b.ord = c.ord),
    {_top('(SELECT * FROM bo WHERE score > 0)', 'lex', 'greatest(4 * k, 16)')},
    {rq._sql_hash('hd', 'ord', 'corpus')}, {rq._sql_hash('hq', 'q', 'asks')}, sim AS (SELECT q, ord, sum(hd.w * hq.w) AS cosine FROM hd JOIN hq USING (bucket) GROUP BY ALL),
    {_top('(SELECT sim.*, k, drugs FROM sim JOIN asks USING (q))', 'near', '3 * greatest(4 * k, 16)', 'cosine')},
    dl AS (SELECT q, ord, k, round(1 / (2 - cosine) + CASE WHEN section IN {sql_in(WORDING.important)} THEN 0.12 ELSE 0 END + CASE WHEN list_contains(drugs, drug) THEN 0.18 ELSE 0 END, 4) AS score FROM near JOIN corpus USING (ord)),
    {_top('dl', 'dense', 'greatest(4 * k, 16)')},
    ranked AS (SELECT q, ord, rank, 0 AS l FROM lex UNION ALL SELECT q, ord, rank, 1 FROM dense),
    fu AS (SELECT q, drug, section, snippet, sum(1.0 / (60 + rank)) AS s, count(DISTINCT l) AS lists, min(l * 1000000 + rank) AS pos FROM ranked JOIN corpus USING (ord) GROUP BY ALL),
    fused AS (SELECT fu.*, question, kind, k, drugs, list_contains(drugs, drug) AS mine, round(s + CASE WHEN lists > 1 THEN 0.02 ELSE 0 END + CASE WHEN list_contains(drugs, drug) THEN 0.03 ELSE 0 END, 4) AS f FROM fu JOIN asks USING (q)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY f DESC, pos) AS before FROM fused),
    rr AS (SELECT *, round(f + CASE WHEN section IN {sql_in(WORDING.important)} THEN 0.08 ELSE 0 END + CASE WHEN mine THEN 0.08 ELSE 0 END + CASE WHEN {sql_any('snippet', HIGH)} THEN 0.05 ELSE 0 END, 4) AS score FROM fr),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, before) AS rank FROM rr) WHERE rank <= k)"""


def _about(body: str, with_titles: bool) -> str:
    words = {g: (*w, *(_TITLES[g] if with_titles else ())) for g, w in _MATCH.items()}
    return f"(({_OLD} AND {sql_any(body, words['older'])}) OR ({_YOUNG} AND {sql_any(body, words['younger'])}))"


_BODY = "(section || ' ' || snippet)"


def _assembled(name: str, first: str, second: str) -> str:
    """Two lists (q, ord, drug, section, snippet, score) as ``questions.assemble`` does it."""
    titled = f"(({_OLD} AND section IN ('EN')) OR ({_YOUNG} AND section IN ('FR', 'DE')))"
    return f"""{name}u AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY l, ord) AS o FROM (SELECT q, ord, drug, section, snippet, score, 0 AS l FROM {first} UNION ALL SELECT q, ord, drug, section, snippet, score, 1 FROM {second})),
    {name}d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, drug, section, trim(regexp_replace(snippet, '^\\s*\\d+[.、)]\\s*', '')) ORDER BY o) AS n FROM {name}u) WHERE n = 1),
    {name}s AS (SELECT {name}d.q, o, drug, section, snippet, score AS plain, len(population) AS people, round(score + CASE WHEN {_about(_BODY, True)} THEN 2.0 ELSE 0 END + CASE WHEN {titled} THEN 0.8 ELSE 0 END
        + CASE WHEN {sql_any('snippet', HIGH)} THEN 0.4 ELSE 0 END + CASE WHEN {sql_any('snippet', MEDIUM)} THEN 0.3 ELSE 0 END, 4) AS better FROM {name}d JOIN x USING (q)),
    {name}p AS (SELECT q, drug, section, snippet, CASE WHEN people > 0 THEN better ELSE plain END AS score, CASE WHEN people > 0 THEN row_number() OVER (PARTITION BY q ORDER BY better DESC, o) ELSE o END AS o FROM {name}s),
    {name}c AS (SELECT *, min(o) OVER (PARTITION BY q, drug) AS f, row_number() OVER (PARTITION BY q, drug ORDER BY o) AS n FROM {name}p), {name}r AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY f) AS r FROM {name}c),
    {name}k AS (SELECT *, max(r) OVER (PARTITION BY q) AS k FROM {name}r), {name}i AS (SELECT *, n <= CASE WHEN k <= 1 THEN 12 ELSE greatest(2, 12 // k) END AS inside FROM {name}k),
    {name} AS (SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN f ELSE o END, CASE WHEN inside THEN n ELSE 0 END) AS ord, drug, section, snippet, score FROM {name}i) WHERE ord <= 12)"""


_EVIDENCE = f"""gi AS (SELECT question AS q, rank AS ord, drug, section, snippet, score, mine, bool_or(mine) OVER (PARTITION BY q) AS hit FROM found WHERE kind = 0), general AS (SELECT * FROM gi WHERE mine OR NOT hit),
    retrieved AS (SELECT question AS q, rank AS ord, drug, section, snippet, score FROM found JOIN x ON x.q = question WHERE kind = 1 AND mine AND {_about(_BODY, True)}),
    direct AS (SELECT x.q, ord, drug, section, snippet, 1.0 AS score FROM x JOIN corpus ON list_contains(drugs, drug) WHERE len(population) > 0 AND {_about(_BODY, True)}),
    {_assembled('special', 'direct', 'retrieved')}, {_assembled('evidence', 'special', 'general')}"""

_CHAIN = f"WITH {_DICT}, {_EXTRACT}, {_ASKS}, {_PASSAGES}, {_RETRIEVED}, {_EVIDENCE}"

_GRAPH = f"""sx AS (SELECT doc_id AS ord, source AS subject, CASE WHEN lang = 'en' THEN 'interactions' ELSE 'cautions' END AS section, {gq._SQL_SENTENCES} AS ss FROM documents),
    se AS (SELECT ord, subject, section, unnest(ss) AS sentence, unnest(generate_series(0, len(ss) - 1)) AS i FROM sx),
    sr AS (SELECT *, CASE WHEN NOT {sql_any('sentence', ('enti', 'qui ', 'the'))} AND contains(sentence, 'ou') THEN NULL WHEN section = 'interactions' THEN 'INTERACTS_WITH'
        WHEN {sql_any('sentence', ('enti', 'qui '))} THEN 'CONTRAINDICATED_FOR' WHEN {sql_any('sentence', ('tion', 'ein'))} THEN 'USE_WITH_CAUTION_IN' END AS relation FROM se),
    so AS (SELECT DISTINCT sr.*, canonical AS object, 'Drug' AS object_type FROM sr JOIN dict ON contains(sentence, name) WHERE section = 'interactions' AND relation IS NOT NULL
        UNION ALL SELECT *, 'classA', 'DrugClass' FROM sr WHERE section = 'interactions' AND relation IS NOT NULL AND {sql_any('sentence', ('thing', 'tion'))}
        UNION ALL SELECT *, 'place', 'Condition' FROM sr WHERE section <> 'interactions' AND relation IS NOT NULL AND {sql_any('sentence', gq._TAGS[0][1])}
        UNION ALL SELECT *, 'time', 'Condition' FROM sr WHERE section <> 'interactions' AND relation IS NOT NULL AND {sql_any('sentence', gq._TAGS[1][1])}),
    sn AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object, section, substr(sentence, 1, 80) ORDER BY ord, i) AS n FROM so WHERE object <> subject),
    ca AS (SELECT *, CASE WHEN {sql_any('sentence', ('enti', 'qui '))} THEN 'High' WHEN {sql_any('sentence', ('tion', 'ein'))} THEN 'Medium' ELSE 'Low' END AS risk_level FROM sn WHERE n = 1),
    rules AS (SELECT least(subject, object) AS lo, greatest(subject, object) AS hi, arg_max(risk_level, ord) AS pair_level FROM ca WHERE i = 0 AND object_type = 'Drug' GROUP BY ALL),
    ed AS (SELECT subject AS s_name, relation AS rel, object_type AS o_label, object AS o_name, arg_max(risk_level, ord * 100000 + i) AS risk_level FROM ca GROUP BY ALL),
    ew AS (SELECT *, CASE risk_level WHEN 'High' THEN 1.3 WHEN 'Medium' THEN 1.1 ELSE 0.8 END AS weight FROM ed),
    hits AS (SELECT DISTINCT q, n, drugs, ew.* FROM (SELECT q, n, drugs, unnest(drugs) AS d FROM x) JOIN ew ON lower(s_name) = lower(d) OR lower(o_name) = lower(d)),
    gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, s_name, rel, o_name, o_label) AS ord FROM hits) WHERE ord <= least(greatest(80, 8 * n), 240)),
    relations AS (SELECT q, ord, s_name, o_name, risk_level, CASE rel WHEN 'INTERACTS_WITH' THEN '相互作用' WHEN 'CONTRAINDICATED_FOR' THEN '禁用于' ELSE '慎用于' END AS relation FROM gr WHERE list_contains(drugs, s_name) AND list_contains(drugs, o_name))"""

_M = terms.MECHANISMS


def _fill(template: str, **values: str) -> str:
    out = "'" + template + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_NEAR_SQL = " OR ".join(
    f"(name = '{c}' AND ({' OR '.join(f'''regexp_matches(body, '(?s){w}.{{0,{48 - len(s)}}}{s}|{s}.{{0,{48 - len(s)}}}{w}')''' for w in words for s in ('wh', 'ness'))}))" for c, words in _NEAR.items()
)
_SCORED = f"""{_GRAPH}, ev AS (SELECT *, {_BODY} AS body FROM evidence),
    base AS (SELECT q, count(*) AS n_evidence, CASE WHEN bool_or({sql_any('snippet', HIGH)}) THEN 'High' WHEN bool_or({sql_any('snippet', MEDIUM)}) THEN 'Medium' ELSE 'Low' END AS words FROM ev GROUP BY q),
    pm AS (SELECT ev.q, g, snippet FROM (SELECT q, unnest(population) AS g FROM x) JOIN ev USING (q) WHERE (g = 'older' AND {sql_any('body', _MATCH['older'])}) OR (g = 'younger' AND {sql_any('body', _MATCH['younger'])})),
    pg AS (SELECT q, array_to_string(list_sort(list(DISTINCT g)), '、') AS groups, CASE WHEN bool_or({sql_any('snippet', HIGH)}) THEN 'High' WHEN bool_or({sql_any('snippet', MEDIUM)}) THEN 'Medium' END AS people FROM pm GROUP BY q),
    cm AS (SELECT ev.q, name, {_NEAR_SQL} AS near FROM (SELECT q, unnest(conditions) AS name FROM x) JOIN ev USING (q) WHERE {' OR '.join(f"(name = '{c}' AND {sql_any('body', w)})" for c, w in _NEAR.items())}),
    cg AS (SELECT q, array_to_string(list_sort(list(DISTINCT name)), '、') AS near_conditions FROM cm GROUP BY q HAVING bool_or(near)),
    rl AS (SELECT q, count(*) AS n_relations, arg_max({{'s': s_name, 'r': relation, 'o': o_name, 'l': risk_level}}, CASE risk_level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END * 1000 - ord) AS best, arg_min({{'s': s_name, 'r': relation, 'o': o_name}}, ord) AS first FROM relations GROUP BY q),
    du AS (SELECT q, unnest(drugs) AS d, unnest(generate_series(1, n)) AS i FROM x),
    pa AS (SELECT a.q, arg_min({{'l': a.d, 'r': b.d, 'v': pair_level}}, a.i * 1000 + b.i) AS p FROM du a JOIN du b ON a.q = b.q AND a.i < b.i JOIN rules ON lo = least(a.d, b.d) AND hi = greatest(a.d, b.d) GROUP BY a.q),
    fe AS (SELECT q, drug, section, snippet FROM evidence WHERE ord = 1),
    j AS (SELECT x.q, x.drugs, n, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_relations, 0) AS n_relations, words, people, groups, near_conditions, best, first, fe.drug, fe.section, fe.snippet, p IS NOT NULL AND n >= 2 AS pair, p
        FROM x LEFT JOIN base USING (q) LEFT JOIN pg USING (q) LEFT JOIN cg USING (q) LEFT JOIN rl USING (q) LEFT JOIN pa USING (q) LEFT JOIN fe USING (q)),
    rk AS (SELECT *, CASE WHEN n < 2 THEN CASE WHEN n >= 1 AND people IS NOT NULL THEN people WHEN n >= 1 AND near_conditions IS NOT NULL THEN 'Medium' ELSE 'Unknown' END WHEN n_evidence = 0 AND NOT pair AND best IS NULL THEN 'Unknown'
        ELSE ['Unknown', 'Low', 'Medium', 'High'][1 + greatest(list_position(['Unknown', 'Low', 'Medium', 'High'], CASE WHEN pair THEN p.v ELSE coalesce(words, 'Unknown') END), list_position(['Unknown', 'Low', 'Medium', 'High'], coalesce(people, 'Unknown')),
            CASE WHEN near_conditions IS NULL THEN 1 ELSE 3 END, list_position(['Unknown', 'Low', 'Medium', 'High'], coalesce(best.l, 'Unknown'))) - 1] END AS level,
        CASE people WHEN 'High' THEN {_fill(_M['population_high'], names='groups')} WHEN 'Medium' THEN {_fill(_M['population_medium'], names='groups')} END AS said_people,
        {_fill(_M['condition'], names='near_conditions')} AS said_near, {_fill(_M['graph'], subject='best.s', relation='best.r', object='best.o')} AS said_graph FROM j),
    me AS (SELECT *, CASE WHEN n < 2 THEN coalesce(CASE WHEN n >= 1 THEN said_people END, CASE WHEN n >= 1 THEN said_near END, '{_M['few']}') WHEN n_evidence = 0 AND NOT pair AND best IS NULL THEN '{_M['nothing']}'
        ELSE concat_ws('{_M['also']}', CASE WHEN pair THEN '{_M['pair']}' WHEN n_evidence = 0 THEN '{_M['no_evidence']}' WHEN words = 'High' THEN '{_M['High']}' WHEN words = 'Medium' THEN '{_M['Medium']}' ELSE '{_M['Low']}' END, said_people, said_near, said_graph) END AS mechanism,
        CASE WHEN pair THEN '{_M['pair_advice']}' WHEN level = 'High' THEN '{terms.RECOMMENDATIONS['High']}' WHEN level = 'Medium' THEN '{terms.RECOMMENDATIONS['Medium']}' WHEN level = 'Low' THEN '{terms.RECOMMENDATIONS['Low']}'
            WHEN n > 0 THEN '{terms.RECOMMENDATIONS['ambiguous']}' ELSE '{terms.RECOMMENDATIONS['other']}' END AS recommendation,
        CASE WHEN pair THEN {_fill(terms.CONCLUSIONS['pair'], left='p.l', right='p.r', level='level')} WHEN level = 'Unknown' THEN '{terms.CONCLUSIONS['Unknown']}' ELSE {_fill(terms.CONCLUSIONS['other'], level='level')} END AS conclusion,
        CASE WHEN pair THEN 0.88 WHEN level = 'Unknown' THEN 0.32 ELSE round(least(0.82, 0.48 + 0.06 * least(n_evidence, 5) + 0.03 * least(n_relations, 5)), 2) END AS confidence,
        list_filter([CASE WHEN level = 'High' THEN 'danger:{terms.FLAG_MESSAGES['high_risk']}' END, CASE WHEN n_evidence = 0 THEN 'warning:{terms.FLAG_MESSAGES['no_evidence']}' END, CASE WHEN n < 2 THEN 'info:{terms.FLAG_MESSAGES['few_concepts']}' END,
            CASE WHEN people = 'High' THEN 'danger:' WHEN people IS NOT NULL THEN 'warning:' END || said_people, 'warning:' || said_near], lambda v: v IS NOT NULL) AS flags FROM rk),
    an AS (SELECT *, concat_ws(chr(10) || chr(10), conclusion, {_fill(terms.ANSWER['mechanism'], mechanism='mechanism')}, {_fill(terms.ANSWER['recommendation'], recommendation='recommendation')},
        {_fill(terms.ANSWER['graph'], subject='first.s', relation='first.r', object='first.o')}, {_fill(terms.ANSWER['evidence'], drug='drug', section='section', snippet='substr(snippet, 1, 90)')},
        CASE WHEN len(flags) > 0 THEN '安全提示：' || array_to_string(list_transform(flags, lambda f: substr(f, instr(f, ':') + 1)), '；') END, '{terms.ANSWER['notice']}') AS answer FROM me)"""


@query(f"{_CHAIN} SELECT q, ord AS position, drug, section, md5(snippet) AS snippet, CAST(score AS DOUBLE) AS score FROM evidence")
def consultation_evidence(spark, sf_dir):
    """The evidence of each question: retrieval, population retrieval and direct evidence, scoped, by priority, spread."""
    known = store.written(dictionary(spark, sf_dir), "names").select("name", "canonical")
    # the steps of ``consult`` up to the evidence
    context = store.written(consultation.extracted(asked(spark, sf_dir), known, WORDING), "extracted")
    found = consultation.evidence_of(context, passages(spark, sf_dir), WORDING)
    return found.select("q", "position", "drug", "section", F.md5("snippet").alias("snippet"), "score")


@query(f"""{_CHAIN}, {_SCORED} SELECT q, array_to_string(drugs, '|') AS drugs, level, CAST(confidence AS DOUBLE) AS confidence, conclusion, recommendation, mechanism, array_to_string(flags, '|') AS flags,
    level = 'Unknown' OR len(list_filter(flags, lambda f: starts_with(f, 'warning'))) > 0 AS downgraded, n_evidence, n_relations, answer FROM an""")
def consultation_answers(spark, sf_dir):
    """One answer per question, from its names to its text."""
    rows = _answers(spark, sf_dir).answers
    flags = F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["level"], f["message"])), "|")
    return rows.select("q", F.array_join("drugs", "|").alias("drugs"), "level", "confidence", "conclusion", "recommendation", "mechanism", flags.alias("flags"), "downgraded", "n_evidence", "n_relations", "answer")


@query(f"""WITH {_DICT}, {_EXTRACT}, {_PASSAGES}, {_GRAPH},
    t AS (SELECT ord, unnest({sql_tokens('text')}) AS term FROM corpus), tf AS (SELECT ord, term, count(*) AS tf FROM t GROUP BY ALL),
    df AS (SELECT term, ln((any_value(n) + 1.0) / (count(*) + 1)) + 1 AS idf FROM tf, (SELECT count(*) AS n FROM corpus) GROUP BY term), w AS (SELECT ord, term, tf * idf AS w FROM tf JOIN df USING (term)), nd AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM w GROUP BY ord),
    qt AS (SELECT q, term, count(*) AS c FROM (SELECT q, unnest({sql_tokens('message')}) AS term FROM x) GROUP BY ALL), qw AS (SELECT q, term, c * coalesce(idf, 1.0) AS v FROM qt LEFT JOIN df USING (term)), nq AS (SELECT q, sqrt(sum(v * v)) AS own FROM qw GROUP BY q),
    co AS (SELECT qw.q, w.ord, sum(v * w) / (any_value(norm) * any_value(own)) AS base FROM qw JOIN w USING (term) JOIN nd USING (ord) JOIN nq USING (q) GROUP BY ALL),
    bo AS (SELECT x.q, c.ord, snippet, coalesce(base, 0) + CASE WHEN c.section IN {sql_in(WORDING.important)} THEN 0.2 ELSE 0 END + CASE WHEN list_contains(x.drugs, c.drug) THEN 0.25 ELSE 0 END AS score FROM x CROSS JOIN corpus c LEFT JOIN co b ON b.q = x.q AND b.ord = c.ord),
    {_top('(SELECT * FROM bo WHERE score > 0)', 'ev', '8')}, base AS (SELECT q, count(*) AS n_evidence, CASE WHEN bool_or({sql_any('snippet', HIGH)}) THEN 'High' WHEN bool_or({sql_any('snippet', MEDIUM)}) THEN 'Medium' ELSE 'Low' END AS words FROM ev GROUP BY q),
    du AS (SELECT q, unnest(drugs) AS d, unnest(generate_series(1, n)) AS i FROM x),
    pa AS (SELECT a.q, arg_min({{'l': a.d, 'r': b.d, 'v': pair_level}}, a.i * 1000 + b.i) AS p FROM du a JOIN du b ON a.q = b.q AND a.i < b.i JOIN rules ON lo = least(a.d, b.d) AND hi = greatest(a.d, b.d) GROUP BY a.q),
    lv AS (SELECT x.q, x.drugs, n, message, coalesce(n_evidence, 0) AS n_evidence, p, CASE WHEN n = 0 THEN 'Unknown' WHEN p IS NOT NULL THEN p.v ELSE coalesce(words, 'Unknown') END AS level FROM x LEFT JOIN base USING (q) LEFT JOIN pa USING (q))
    SELECT q, array_to_string(drugs, '|') AS drugs, level, CASE WHEN level = 'Unknown' THEN '{terms.REPORT['Unknown']}' WHEN p IS NOT NULL THEN {_fill(terms.REPORT['pair'], left='p.l', right='p.r', level='level')} ELSE {_fill(terms.REPORT['other'], level='level')} END AS conclusion,
        CASE WHEN level = 'Unknown' THEN '{terms.REPORT['Unknown_advice']}' WHEN p IS NOT NULL THEN '{terms.REPORT['pair_advice']}' ELSE '{terms.REPORT['other_advice']}' END AS recommendation,
        CAST(CASE WHEN level = 'Unknown' THEN 0.35 WHEN p IS NOT NULL THEN 0.86 WHEN n_evidence > 0 THEN 0.62 ELSE 0.35 END AS DOUBLE) AS confidence,
        concat_ws('|', CASE WHEN n < 2 THEN '{terms.LIMITATIONS['few']}' END, CASE WHEN n_evidence = 0 THEN '{terms.LIMITATIONS['no_evidence']}' END, CASE WHEN NOT regexp_matches(message, '(?i)\\d+\\s*(mg|毫克|片|粒)') THEN '{terms.LIMITATIONS['no_dose']}' END) AS limitations, n_evidence FROM lv""")
def analysis_reports(spark, sf_dir):
    """The report of each question over TF-IDF evidence and pair rules, with its limitations."""
    known = store.written(dictionary(spark, sf_dir), "names").select("name", "canonical")
    rules = store.written(rules_of(_stated(spark, sf_dir, known, opening=True)), "rules")
    rows = consultation.analyze(asked(spark, sf_dir), known, passages(spark, sf_dir), rules, WORDING)
    return rows.withColumns({"drugs": F.array_join("drugs", "|"), "limitations": F.array_join("limitations", "|")})
