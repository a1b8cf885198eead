"""Registered queries of operators on questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import names, risk
from ..sources import store
from ..operators import questions as qs
from . import retrieval_queries as rq
from .common import HIGH, MEDIUM, corpus, questions, sql_any, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TERMS = (("older", ("old", "age", "dose")), ("younger", ("child", "dose")))


def _people(q):
    return F.when(q % 3 == 0, F.array(F.lit("older"), F.lit("younger"))).when(q % 3 == 1, F.array(F.lit("younger"), F.lit("other"))).otherwise(F.array().cast("array<string>"))


def _asked(spark, sf_dir):
    return questions(spark, sf_dir).withColumn("population", _people(F.col("q")))


_SQL_PEOPLE = "CASE q % 3 WHEN 0 THEN 'old age dose child' WHEN 1 THEN 'child dose other' ELSE '' END"


@query(f"""SELECT item_id AS q, trim(text || ' ' || {_SQL_PEOPLE.replace('q %', 'item_id %')} || CASE WHEN item_id % 3 < 2 THEN ' ' ELSE '' END || 'a b src') AS expanded FROM benchmark""")
def query_expansion(spark, sf_dir):
    rows = _asked(spark, sf_dir)
    body = qs.evidence_query(F.col("text"), F.col("population"), F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("src")), _TERMS)
    return rows.select("q", F.trim(body).alias("expanded"))


@query(f"""SELECT item_id AS q, CASE item_id % 3 WHEN 0 THEN text || ' src' || (item_id % 20) || ' old age dose child T1 T2 end' WHEN 1 THEN text || ' src' || (item_id % 20) || ' child dose other T2 end' ELSE text || ' src' || (item_id % 20) || ' end' END AS expanded FROM benchmark""")
def population_query(spark, sf_dir):
    rows = _asked(spark, sf_dir)
    body = qs.population_query(F.col("text"), F.col("drugs"), F.col("population"), _TERMS, (("older", ("T1", "dose")), ("younger", ("T2", "dose"))), ("end",))
    return rows.select("q", body.alias("expanded"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'default' ELSE role END AS user_id FROM conversations WHERE length(text) >= 120")
def valid_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("user_id"))
    return qs.valid(rows, 120).select("conv_id", "turn", "user_id")


@query(rq._SQL_LIST + """, i AS (SELECT *, section = 'de' AS inside FROM ev), a AS (SELECT *, bool_or(inside) OVER (PARTITION BY q) AS hit FROM i) SELECT q, ord, section FROM a WHERE inside OR NOT hit""")
def scoped_evidence(spark, sf_dir):
    return qs.scoped_if_any(rq.evidence(spark, sf_dir), F.col("section") == "de").select("q", "ord", "section")


_MATCH = (("older", ("the", "les")), ("younger", ("und", "que")))
_SQL_ABOUT = f"((q % 3 = 0 AND {sql_any('body', ('the', 'les', 'und', 'que'))}) OR (q % 3 = 1 AND ({sql_any('body', ('und', 'que'))} OR contains(body, 'other'))))"


def _direct(spark, sf_dir):
    sections = corpus(spark, sf_dir).withColumnRenamed("text", "content")
    return qs.direct_evidence(_asked(spark, sf_dir), sections, match=_MATCH, titles=())


@query(f"""WITH x AS (SELECT item_id AS q, doc_id AS ord, source AS drug, lang AS section, substr(d.text, 1, 320) AS snippet, lang || ' ' || substr(d.text, 1, 320) AS body FROM documents d JOIN benchmark b ON source = 'src' || (item_id % 20))
    SELECT q, ord, drug, section, md5(snippet) AS snippet FROM x WHERE {_SQL_ABOUT}""")
def direct_evidence(spark, sf_dir):
    return _direct(spark, sf_dir).select("q", "ord", "drug", "section", F.md5("snippet").alias("snippet"))


@query(None)
def evidence_assembly(spark, sf_dir):
    """Direct and retrieved evidence of each question, once, by priority, spread over sources; its parts have SQL of their own."""
    rows = rq.evidence(spark, sf_dir, 16).select("q", "ord", F.lit("documents").alias("source"), "drug", "section", F.substring("text", 1, 320).alias("snippet"), "score")
    rows = store.written(rows, "retrieved")
    sections = corpus(spark, sf_dir).withColumnRenamed("text", "content").withColumn("source", F.lit("documents"))
    direct = qs.first_direct(_asked(spark, sf_dir), sections, rows, 12, high=HIGH, medium=MEDIUM, titles=(), match=_MATCH).withColumn("ord", F.col("ord").cast("long"))
    out = qs.assemble(rows, direct.select(*rows.columns), _asked(spark, sf_dir), limit=12, high=HIGH, medium=MEDIUM, titles=(), match=_MATCH)
    return out.select("q", F.col("position").cast("long").alias("position"), "drug", "section", F.md5("snippet").alias("snippet"), "score")




@query(f"""WITH t AS (SELECT source || lang AS drug, {sql_any('left(text, 2000)', HIGH)} AS h, {sql_any('left(text, 2000)', MEDIUM)} AS m FROM documents),
    l AS (SELECT drug, CASE WHEN bool_or(h) THEN 3 WHEN bool_or(m) THEN 2 ELSE 1 END AS level FROM t GROUP BY drug),
    g AS (SELECT DISTINCT source AS concept, source || lang AS drug FROM documents) SELECT concept, bool_and(level IS NOT NULL) AND count(DISTINCT level) = 1 AS agreed FROM g LEFT JOIN l USING (drug) GROUP BY concept""")
def candidate_consensus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("drug", F.concat("source", "lang"))
    groups = docs.groupBy(F.col("source").alias("concept")).agg(F.collect_set("drug").alias("candidates")).withColumn("q", F.lit(1))
    sections = docs.select("drug", F.lit("x").alias("section"), F.col("text").alias("content"))
    return qs.consensus(groups, sections, "x", 2000, HIGH, MEDIUM).select("concept", "agreed")


@query(rq._SQL_LIST + """, g AS (SELECT DISTINCT q, drug AS d FROM ev WHERE ord <= 12), f AS (SELECT q.q, f.d FROM questions q CROSS JOIN (SELECT DISTINCT source AS d FROM documents) f)
    SELECT f.q, count(*) AS candidates, count(g.d) AS with_evidence FROM f LEFT JOIN g ON g.q = f.q AND g.d = f.d GROUP BY f.q""")
def family_counts(spark, sf_dir):
    """All sources as one family of each question: how many the evidence names."""
    family = table(spark, sf_dir, "documents").agg(F.collect_set("source").alias("candidates"))  # one row: the sources are a fixed list
    groups = questions(spark, sf_dir).select("q").crossJoin(F.broadcast(family)).withColumn("concept", F.lit("all"))
    return qs.family_counts(groups, rq.evidence(spark, sf_dir, 12)).select("q", "candidates", "with_evidence")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS questions, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM events) AS events")
def health_counts(spark, sf_dir):
    read = lambda n: table(spark, sf_dir, n)
    return qs.health(documents=read("documents"), questions=read("benchmark"), turns=read("conversations"), events=read("events"))


@query(rq._SQL_LIST + """, e AS (SELECT q, count(*) AS n FROM ev WHERE ord <= 8 GROUP BY q), g AS (SELECT q, count(*) AS n FROM ev WHERE ord <= 8 AND section = 'de' GROUP BY q)
    SELECT q, 'extract:done:1,retrieve:' || CASE WHEN e.n > 0 THEN 'done:' || e.n ELSE 'empty:0' END || ',german:' || CASE WHEN g.n > 0 THEN 'done:' || g.n ELSE 'empty:0' END AS trace FROM questions LEFT JOIN e USING (q) LEFT JOIN g USING (q)""")
def stage_trace(spark, sf_dir):
    asked, rows = questions(spark, sf_dir), rq.evidence(spark, sf_dir, 8)
    out = qs.trace(asked, {"extract": asked, "retrieve": rows, "german": rows.where("section = 'de'")})
    return out.select("q", F.array_join(F.transform("trace", lambda x: F.concat_ws(":", x["node"], x["status"], x["n"].cast("string"))), ",").alias("trace"))


@query("SELECT source AS drug, lang AS title, array_to_string(list_sort(list(DISTINCT 'url' || (doc_id % 17))), '|') AS urls FROM documents GROUP BY ALL")
def source_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("drug"), F.col("doc_id").alias("row"), F.concat(F.lit("url"), (F.col("doc_id") % 17).cast("string")).alias("url"))
    sections = docs.select(F.col("source").alias("drug"), F.col("lang").alias("title"), F.col("doc_id").alias("row"))
    return qs.source_references(rows, sections).select("drug", "title", F.array_join("source_urls", "|").alias("urls"))


def _letters(texts):
    """A tiny embedder: counts of eight letters."""
    return [[float(t.count(c)) for c in "etaoinsr"] for t in texts]


@query("""WITH v AS (SELECT doc_id, [""" + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "etaoinsr") + """] AS v FROM documents)
    SELECT doc_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 6) AS first_weight, len(v) AS dim FROM v""")
def embedder_hook(spark, sf_dir):
    rows = qs.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _letters)
    return rows.select("doc_id", F.round(F.get("vec", F.lit(0)), 6).alias("first_weight"), F.size("vec").cast("long").alias("dim"))


@query("SELECT o_orderkey AS q, NOT (o_orderkey % 11 = 0 AND o_orderkey % 4 < 2) AS asks, CAST(least(greatest(80, 8 * (o_orderkey % 40 + 1)), 240) AS INTEGER) AS most FROM orders")
def graph_skip(spark, sf_dir):
    """Which questions ask the graph, and for how many edges at most."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("q"), F.sequence(F.lit(1), (key % 40 + 1).cast("int")).alias("entities"))
    return rows.select("q", qs.asks_graph(F.col("q") % 11 == 0, F.col("q") % 4).alias("asks"), qs.graph_limit(F.col("entities")).alias("most"))


@query(r"""WITH t AS (SELECT doc_id AS q, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM documents), m AS (SELECT q, t, unnest(['and', 'que', 'und']) AS mention FROM t)
    SELECT q, mention FROM m WHERE NOT (instr(t, mention) > 0 AND regexp_matches(substr(t, 1, instr(t, mention) - 1), '(?s)(in|de).{0,6}$'))""")
def negated_groups(spark, sf_dir):
    """Groups whose first mention does not stand within six characters of a word that stands for a negation here."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q"), F.col("text").alias("message"))
    groups = docs.select("q", F.explode(F.array(*map(F.lit, ("and", "que", "und")))).alias("mention"))
    return qs.without_negated_groups(groups, docs, (("(in|de)", 6),)).select("q", "mention")


@query("SELECT o_orderkey AS q, 'm' AS mention FROM orders WHERE o_orderkey % 5 <> o_orderkey % 7")
def unresolved_mentions(spark, sf_dir):
    """Ambiguous mentions whose own resolution meets none of the known names."""
    key, name = F.col("o_orderkey"), lambda n: F.concat(F.lit("n"), (F.col("o_orderkey") % n).cast("string"))
    orders = table(spark, sf_dir, "orders")
    ambiguous = orders.select(key.alias("q"), F.lit("m").alias("mention"), F.array(name(5)).alias("found"))
    return qs.without_resolved(ambiguous, orders.select(key.alias("q"), F.array(name(7), F.lit("x")).alias("names"))).select("q", "mention")


@query("""WITH g AS (SELECT l_orderkey AS q, l_linenumber * 1000000 + l_partkey AS i, unnest(['p' || (l_partkey % 5), 'p' || (l_suppkey % 3)]) AS drug FROM lineitem) SELECT q, drug, 'c' || max(i) AS concept FROM g GROUP BY ALL""")
def candidate_concepts(spark, sf_dir):
    """Lines as groups of two candidates each: the last group of a candidate counts."""
    i = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    part = lambda c, n: F.concat(F.lit("p"), (F.col(c) % n).cast("string"))
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), i.alias("i"), F.concat(F.lit("c"), i.cast("string")).alias("concept"), F.array(part("l_partkey", 5), part("l_suppkey", 3)).alias("candidates"))
    return qs.concept_of(groups)


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_name, p_brand])), '|') AS names FROM part")
def united_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.united(F.array("p_brand", "p_type"), F.array("p_name", "p_brand")), "|").alias("names"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS iso FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_utc(F.col("ts")).alias("iso"))


@query(f"""WITH f AS (SELECT item_id AS q, 'all' AS concept, n AS candidates FROM benchmark, (SELECT count(DISTINCT source) AS n FROM documents))
    SELECT q, 'info' AS level, '“' || concept || '”已按药物家族展开为 ' || candidates || ' 个相关制剂，本次基于其中 ' || (q % 5) || ' 个制剂召回到的说明书证据进行综合判断。' AS message FROM f""")
def family_flags(spark, sf_dir):
    """A flag per question for one family of all sources, with q % 5 of them in the evidence."""
    family = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("candidates"))
    families = questions(spark, sf_dir).select("q", F.lit("all").alias("concept"), (F.col("q") % 5).alias("with_evidence")).crossJoin(F.broadcast(family))  # one row
    return risk.family_flags(families)
