"""Registered queries of names, knowledge records, graphs and rule scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms, text
from ..operators import kg, knowledge, names, risk
from . import retrieval_queries as rq
from .common import CORPUS, HIGH, MEDIUM, QUESTIONS, sql_any, sql_in, sql_list, table
from .text_queries import _SQL_SENTENCES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(c: str):
    return F.array_join(c, "|").alias(c)


# --- names -------------------------------------------------------------------------------------------

FORMS, SALTS = ("ring", "bolt", "gear", "widget"), ("red", "blue", "big")


def part_records(spark, sf_dir):
    """Part names as records, with their brands as aliases."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("drug")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.min("p_partkey").alias("ord"))


def part_overrides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    target = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?")))
    return part.groupBy(F.col("p_type").alias("alias")).agg(F.array_sort(F.collect_set(target)).alias("targets"), F.lit("review").alias("source"))


def _names(spark, sf_dir):
    return names.resolution_names(part_records(spark, sf_dir), part_overrides(spark, sf_dir), FORMS, SALTS)


_SQL_NAMES = f"""WITH d AS (SELECT p_name AS drug, lower(replace(p_name, ' ', '')) AS x, list_sort(list(DISTINCT p_brand)) AS aliases FROM part GROUP BY ALL),
    f AS (SELECT *, CASE WHEN regexp_matches(x, '^.{{2,}}?(?:{"|".join(FORMS)})$') THEN regexp_replace(x, '(?:{"|".join(FORMS)})$', '') ELSE x END AS base,
        CASE WHEN regexp_matches(x, '^(?:{"|".join(SALTS)}).{{2,}}$') THEN regexp_replace(x, '^(?:{"|".join(SALTS)})', '') ELSE x END AS salt FROM d),
    g AS (SELECT *, CASE WHEN regexp_matches(salt, '^.{{2,}}?(?:{"|".join(FORMS)})$') THEN regexp_replace(salt, '(?:{"|".join(FORMS)})$', '') ELSE salt END AS salt_base FROM f),
    o AS (SELECT DISTINCT p_type AS alias, CASE WHEN p_size > 25 THEN p_name ELSE p_name || '?' END AS target FROM part),
    r AS (SELECT 'exact_name' AS kind, x AS name, drug AS target, 'knowledge' AS source FROM g
        UNION ALL SELECT 'derived_base_name', base, drug, 'derived' FROM g WHERE base <> x
        UNION ALL SELECT 'alias', salt, drug, 'derived_salt_short_name' FROM g WHERE salt <> x
        UNION ALL SELECT 'derived_base_name', salt_base, drug, 'derived' FROM g WHERE salt <> x AND salt_base <> salt
        UNION ALL SELECT 'alias', lower(a), drug, 'source_alias' FROM (SELECT drug, unnest(aliases) AS a FROM g)
        UNION ALL SELECT 'alias', lower(alias), target, 'review' FROM o WHERE target IN (SELECT drug FROM d)),
    n AS (SELECT kind, name, list_sort(list(DISTINCT target)) AS targets, list_sort(list(DISTINCT source)) AS sources FROM r GROUP BY ALL)"""


@query(f"{_SQL_NAMES} SELECT kind, name, array_to_string(targets, '|') AS targets, array_to_string(sources, '|') AS sources FROM n")
def name_index(spark, sf_dir):
    return _names(spark, sf_dir).select("kind", "name", _text("targets"), _text("sources"))


@query(f"{_SQL_NAMES} SELECT name, array_to_string(targets, '|') AS targets FROM n WHERE kind = 'alias' AND len(targets) > 1")
def alias_conflicts(spark, sf_dir):
    return names.alias_conflicts(_names(spark, sf_dir)).select("name", _text("targets"))


@query("""WITH o AS (SELECT p_type || p_size AS alias, list_sort(list(DISTINCT CASE WHEN p_size > 25 THEN p_name ELSE p_name || '?' END)) AS targets, bool_or(p_size > 25) AS good FROM part GROUP BY ALL)
    SELECT alias, array_to_string(targets, '|') AS targets FROM o WHERE NOT good""")
def rejected_overrides(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_type", F.concat("p_type", F.col("p_size").cast("string")))
    target = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?")))
    rows = part.groupBy(F.col("p_type").alias("alias")).agg(F.array_sort(F.collect_set(target)).alias("targets"))
    return names.rejected_overrides(rows, part_records(spark, sf_dir)).select("alias", _text("targets"))


@query(f"""WITH RECURSIVE {_SQL_NAMES.removeprefix('WITH ')}, asked AS (SELECT p_partkey AS q, lower(regexp_replace(p_name || ' and ' || p_type, '\\s+', '', 'g')) AS t FROM part),
    texts AS (SELECT DISTINCT t FROM asked), places AS (SELECT t, unnest(generate_series(1, length(t))) AS i FROM texts), sizes AS (SELECT DISTINCT length(name) AS size FROM n),
    hits AS (SELECT t, i - 1 AS start, i - 1 + size AS stop, name, targets, kind FROM places CROSS JOIN sizes JOIN n ON name = substr(t, i, size) AND length(name) = size WHERE i + size - 1 <= length(t)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY stop - start DESC, CASE kind WHEN 'exact_name' THEN 3 WHEN 'alias' THEN 2 ELSE 1 END DESC, start, name, targets, kind) AS r FROM hits),
    fold AS (SELECT t, 0 AS r, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept, false AS took FROM texts
        UNION ALL SELECT fold.t, h.r, CASE WHEN len(list_filter(kept, lambda x: h.start < x.e AND x.s < h.stop)) = 0 THEN list_append(kept, {{'s': h.start, 'e': h.stop}}) ELSE kept END, len(list_filter(kept, lambda x: h.start < x.e AND x.s < h.stop)) = 0
        FROM fold JOIN ranked h ON h.t = fold.t AND h.r = fold.r + 1),
    chosen AS (SELECT h.*, list_filter(targets, lambda x: NOT contains(x, 'gear')) AS usable FROM fold JOIN ranked h USING (t, r) WHERE took),
    used AS (SELECT t, start, name, kind, CASE WHEN contains(t, 'small') AND kind = 'derived_base_name' AND len(usable) > 0 THEN usable ELSE targets END AS targets FROM chosen),
    one AS (SELECT t, array_to_string(list_sort(list(DISTINCT targets[1])), '|') AS resolved FROM used WHERE len(targets) = 1 GROUP BY t),
    many AS (SELECT t, to_json(list({{'mention': name, 'candidates': targets, 'source': kind}} ORDER BY start)) AS groups FROM (SELECT *, row_number() OVER (PARTITION BY t, name, targets ORDER BY start, kind) AS k FROM used WHERE len(targets) > 1) WHERE k = 1 GROUP BY t)
    SELECT q, coalesce(resolved, '') AS resolved, coalesce(CAST(groups AS VARCHAR), '[]') AS groups FROM asked LEFT JOIN one USING (t) LEFT JOIN many USING (t)""")
def longest_match_resolve(spark, sf_dir):
    """Part names and types as messages, resolved by the name index."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), F.concat_ws(" and ", "p_name", "p_type").alias("message"))
    found = names.resolve(asked, _names(spark, sf_dir), ("small",), ("gear",))
    return found.select("q", _text("resolved"), F.to_json("groups").alias("groups"))


_SQL_WORDS = r"words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS name FROM benchmark)"


def _words(spark, sf_dir):
    """Long words of the benchmark texts as a dictionary of names."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select(words.alias("name")).distinct().withColumn("canonical", F.col("name"))


@query(f"WITH {_SQL_WORDS} SELECT doc_id, name FROM documents JOIN words ON contains(lower(text), name)")
def mention_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return names.mentions(docs, _words(spark, sf_dir), "doc_id", "t", block=9).select("doc_id", "name")


@query(rf"""WITH {_SQL_WORDS}, s AS (SELECT doc_id, string_split(regexp_replace(text, '(nicht|dans|from)', chr(1) || '\1', 'g'), chr(1)) AS p FROM documents),
    t AS (SELECT doc_id, p, unnest(generate_series(2, len(p))) AS j FROM s), u AS (SELECT doc_id, lower(substr(array_to_string(p[j:j + 16], ''), CASE WHEN starts_with(p[j], 'nicht') THEN 6 ELSE 5 END, 60)) AS tail FROM t)
    SELECT DISTINCT doc_id AS q, name AS canonical FROM u JOIN words ON contains(tail, name)""")
def negation_filter(spark, sf_dir):
    """Names wholly within 60 characters after a word that stands for a negation here."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q"), F.col("text").alias("message"))
    return names.negated(asked, _words(spark, sf_dir), (("(?:nicht|dans|from)", 60),))


_SQL_LETTERS = r"letters AS (SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\s.,]+')) AS name FROM benchmark) WHERE regexp_matches(name, '^[a-z]{1,2}$'))"
_SQL_SIDE = r"regexp_extract_all(text, '([\p{{L}}\p{{N}}_]+)\s*(?:和|与|及|、|,|，|\+)\s*([\p{{L}}\p{{N}}_]+)', {})"


@query(f"WITH {_SQL_LETTERS}, sides AS (SELECT doc_id AS q, unnest(list_concat({_SQL_SIDE.format(1)}, {_SQL_SIDE.format(2)})) AS side FROM documents) SELECT DISTINCT q, name AS canonical FROM sides JOIN letters ON lower(side) = name")
def combination_mentions(spark, sf_dir):
    """Names of one or two letters that stand on a side of a listing mark."""
    letters = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s.,]+"), F.lit(0)))
    known = table(spark, sf_dir, "benchmark").select(letters.alias("name")).where(F.col("name").rlike("^[a-z]{1,2}$")).distinct().withColumn("canonical", F.col("name"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q"), F.col("text").alias("message"))
    return names.combined(asked, known)


# --- records -----------------------------------------------------------------------------------------


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("drug"), F.col("lang").alias("title"), F.col("text"), F.col("doc_id").alias("row"))


_SQL_TEXTS = "t AS (SELECT source AS drug, lang AS title, sha1(text) AS text_hash, any_value(text) AS text, min(doc_id) AS first_row, list_sort(list(DISTINCT doc_id)) AS rows FROM documents WHERE length(text) >= 4 GROUP BY ALL)"


@query(f"WITH {_SQL_TEXTS} SELECT drug, title, text_hash, first_row, array_to_string(rows, '|') AS rows FROM t")
def section_dedupe(spark, sf_dir):
    rows = knowledge.deduped_texts(_cells(spark, sf_dir))
    return rows.select("drug", "title", "text_hash", "first_row", F.array_join(F.col("rows").cast("array<string>"), "|").alias("rows"))


@query(f"""WITH {_SQL_TEXTS}, v AS (SELECT drug, title, text, row_number() OVER (PARTITION BY drug, title ORDER BY first_row, text_hash) AS variant_index, count(*) OVER (PARTITION BY drug, title) AS variant_count FROM t)
    SELECT drug, title, variant_index, variant_count, md5(CASE WHEN variant_count > 1 THEN variant_index || '. ' || text ELSE text END) AS content FROM v""")
def record_build(spark, sf_dir):
    rows = knowledge.section_variants(knowledge.deduped_texts(_cells(spark, sf_dir)))
    return rows.withColumn("content", F.md5("content"))


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT lang)), '|') AS langs, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)))[1:50], '|') AS doc_ids FROM documents GROUP BY source""")
def source_lists(spark, sf_dir):
    rows = knowledge.source_lists(table(spark, sf_dir, "documents"), "source", {"lang": None, "doc_id": 50})
    return rows.select("source", F.array_join("lang", "|").alias("langs"), F.array_join("doc_id", "|").alias("doc_ids"))


@query(f"""WITH {_SQL_TEXTS}, s AS (SELECT drug, title, count(*) AS variants FROM t GROUP BY ALL)
    SELECT (SELECT count(*) FROM documents WHERE coalesce(source, '') <> '') AS rows_read, (SELECT count(*) FROM documents WHERE coalesce(source, '') = '') AS rows_skipped,
    count(DISTINCT drug) AS records, count(*) AS sections, CAST(sum(variants) AS BIGINT) AS variants FROM s WHERE coalesce(drug, '') <> ''""")
def build_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    built = knowledge.section_counts(knowledge.deduped_texts(_cells(spark, sf_dir).where("coalesce(drug, '') <> ''")))
    return knowledge.build_report(docs, built, F.coalesce("source", F.lit("")) == "")


def _old_new(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("drug"), F.concat_ws("-", "lang", (F.col("doc_id") % 7).cast("string")).alias("title"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    return rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1")


_SQL_SIDES = "m AS (SELECT source AS drug, lang || '-' || (doc_id % 7) AS title, doc_id AS ord, text AS content, doc_id % 2 AS p FROM documents)"


@query(f"""WITH {_SQL_SIDES}, w AS (SELECT *, row_number() OVER (PARTITION BY drug, title ORDER BY p DESC, ord DESC) AS n, row_number() OVER (PARTITION BY drug, title ORDER BY p, ord) AS a, max(p) OVER (PARTITION BY drug, title) AS mp FROM m),
    f AS (SELECT drug, title, p AS fp, ord AS ford FROM w WHERE a = 1), l AS (SELECT drug, title, md5(content) AS content, mp = 1 AS is_new FROM w WHERE n = 1)
    SELECT drug, title, content, is_new, row_number() OVER (PARTITION BY drug ORDER BY fp, ford, title) - 1 AS position FROM f JOIN l USING (drug, title)""")
def merge_new_wins(spark, sf_dir):
    return knowledge.merge_new_wins(*_old_new(spark, sf_dir)).withColumn("content", F.md5("content")).select("drug", "title", "content", "is_new", "position")


@query(f"""WITH {_SQL_SIDES} SELECT drug, title, md5(content) AS content, p = 1 AS is_new FROM (SELECT *, row_number() OVER (PARTITION BY drug, title ORDER BY length(content) DESC, p, ord) AS n FROM m) WHERE n = 1""")
def merge_longer_wins(spark, sf_dir):
    return knowledge.merge_longer_wins(*_old_new(spark, sf_dir)).withColumn("content", F.md5("content"))


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.col("source").alias("drug"), F.col("source").alias("title"), F.col("lang").alias("section"), "text", F.concat(F.lit("files/"), "lang").alias("source_path"))


@query("SELECT source AS drug, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, lang AS title, md5(text) AS content FROM documents")
def knowledge_export(spark, sf_dir):
    return knowledge.export_rows(_chunks(spark, sf_dir)).withColumn("content", F.md5("content"))


@query("""WITH p AS (SELECT source AS drug, 'files/' || lang AS path, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY ALL)
    SELECT drug, string_agg(path, ' + ' ORDER BY first) AS source, CAST(sum(n) AS BIGINT) AS n_sections FROM p GROUP BY drug""")
def knowledge_sources(spark, sf_dir):
    return knowledge.export_heads(_chunks(spark, sf_dir)).select("drug", "source", "n_sections")


# --- graph -------------------------------------------------------------------------------------------

_TAGS = (("place", ("avec", "dans")), ("time", ("nach", "und")))


def _sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.col("source").alias("drug"), F.when(F.col("lang") == "en", "interactions").otherwise("cautions").alias("title"), F.replace("text", F.lit(". "), F.lit("。")).alias("text"))


def _candidates(spark, sf_dir):
    return kg.candidates(
        _sections(spark, sf_dir), _words(spark, sf_dir), interaction="interactions", safety=("interactions", "cautions"), classes=(("classA", ("thing", "tion")),), tables=(("Condition", _TAGS),),
        high=("enti", "qui "), medium=("tion", "ein"), action=("the",), idle=("ou",),
    )


_SQL_CANDIDATES = f"""WITH {_SQL_WORDS}, s AS (SELECT doc_id AS ord, source AS subject, CASE WHEN lang = 'en' THEN 'interactions' ELSE 'cautions' END AS section, {_SQL_SENTENCES} AS ss FROM documents),
    e AS (SELECT ord, subject, section, unnest(ss) AS sentence, unnest(generate_series(0, len(ss) - 1)) AS i FROM s),
    r AS (SELECT *, CASE WHEN NOT {sql_any('sentence', ('enti', 'qui ', 'the'))} AND contains(sentence, 'ou') THEN NULL WHEN section = 'interactions' THEN 'INTERACTS_WITH'
        WHEN {sql_any('sentence', ('enti', 'qui '))} THEN 'CONTRAINDICATED_FOR' WHEN {sql_any('sentence', ('tion', 'ein'))} THEN 'USE_WITH_CAUTION_IN' END AS relation FROM e),
    o AS (SELECT r.*, name AS object, 'Drug' AS object_type FROM r JOIN words ON contains(sentence, name) WHERE section = 'interactions' AND relation IS NOT NULL
        UNION ALL SELECT *, 'classA', 'DrugClass' FROM r WHERE section = 'interactions' AND relation IS NOT NULL AND {sql_any('sentence', ('thing', 'tion'))}
        UNION ALL SELECT *, 'place', 'Condition' FROM r WHERE section <> 'interactions' AND relation IS NOT NULL AND {sql_any('sentence', _TAGS[0][1])}
        UNION ALL SELECT *, 'time', 'Condition' FROM r WHERE section <> 'interactions' AND relation IS NOT NULL AND {sql_any('sentence', _TAGS[1][1])}),
    n AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object, section, substr(sentence, 1, 80) ORDER BY ord, i) AS n FROM o),
    c AS (SELECT ord, i, subject, relation, object, object_type, CASE WHEN {sql_any('sentence', ('enti', 'qui '))} THEN 'High' WHEN {sql_any('sentence', ('tion', 'ein'))} THEN 'Medium' ELSE 'Low' END AS risk_level,
        substr(sentence, 1, 600) AS evidence_text, section, CAST(CASE object_type WHEN 'Drug' THEN 0.72 WHEN 'DrugClass' THEN 0.62 ELSE 0.68 END AS DOUBLE) AS confidence FROM n WHERE n = 1)"""


@query(f"{_SQL_CANDIDATES} SELECT ord, subject, relation, object, object_type, risk_level, md5(evidence_text) AS evidence, section, confidence FROM c")
def kg_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("ord", "subject", "relation", "object", "object_type", "risk_level", F.md5("evidence_text").alias("evidence"), "section", "confidence")


def _orders_candidates(spark, sf_dir, dealt=False):
    """Supplier - part group relations from order lines, in order of orders and lines; ``dealt`` out to all cores on demand."""
    lines = table(spark, sf_dir, "lineitem")
    if dealt:
        lines = lines.repartition("l_orderkey")
    relation = F.when(F.col("l_returnflag") == "A", "INTERACTS_WITH").when(F.col("l_returnflag") == "R", "CONTRAINDICATED_FOR").otherwise("USE_WITH_CAUTION_IN")
    level = F.when(F.col("l_linestatus") == "O", "High").when(F.col("l_linenumber") % 2 == 0, "Medium").otherwise("Low")
    return lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("subject"), relation.alias("relation"),
        F.concat(F.lit("group"), (F.col("l_partkey") % 50).cast("string")).alias("object"), F.when(F.col("l_partkey") % 50 < 25, "Drug").otherwise("Condition").alias("object_type"), level.alias("risk_level"), (F.col("l_discount") * 10).alias("confidence"),
    )


_SQL_EDGES = """WITH c AS (SELECT l_orderkey * 100 + l_linenumber AS ord, l_partkey, l_suppkey, 'supplier' || l_suppkey AS subject, CASE l_returnflag WHEN 'A' THEN 'INTERACTS_WITH' WHEN 'R' THEN 'CONTRAINDICATED_FOR' ELSE 'USE_WITH_CAUTION_IN' END AS relation,
        'group' || (l_partkey % 50) AS object, CASE WHEN l_partkey % 50 < 25 THEN 'Drug' ELSE 'Condition' END AS object_type, CASE WHEN l_linestatus = 'O' THEN 'High' WHEN l_linenumber % 2 = 0 THEN 'Medium' ELSE 'Low' END AS risk_level, l_discount * 10 AS confidence FROM lineitem),
    g AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object_type, object ORDER BY ord DESC, confidence DESC, risk_level DESC) AS n, count(*) OVER (PARTITION BY subject, relation, object_type, object) AS n_candidates FROM c WHERE confidence >= 0.2),
    e AS (SELECT subject AS s_name, relation AS rel, object_type AS o_label, object AS o_name, CAST(CASE risk_level WHEN 'High' THEN 1.3 WHEN 'Medium' THEN 1.1 ELSE 0.8 END AS DOUBLE) AS weight, risk_level, n_candidates FROM g WHERE n = 1)"""


def _edges(spark, sf_dir):
    rows = kg.valid(_orders_candidates(spark, sf_dir), 0.2).withColumn("at", F.struct("ord", "confidence", "risk_level"))
    return kg.upsert_edges(rows, "at")


@query(f"{_SQL_EDGES} SELECT s_name, rel, o_label, o_name, weight, risk_level, n_candidates FROM e")
def kg_upsert_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("s_name", "rel", "o_label", "o_name", "weight", "risk_level", "n_candidates")


@query(f"{_SQL_EDGES}, n AS (SELECT 'Drug' AS label, s_name AS name FROM e UNION SELECT o_label, o_name FROM e) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def kg_stats(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return kg.graph_stats(kg.nodes_of(edges), edges)


def _rules(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    level = F.when(F.col("p_size") % 3 == 0, "High").when(F.col("p_size") % 3 == 1, "Medium").otherwise("Low")
    return part.select(F.col("p_brand").alias("left"), F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string")).alias("right"), F.col("p_partkey").alias("ord"), level.alias("risk_level"))


_SQL_RULES = "ru AS (SELECT p_brand AS l, 'Brand#' || (p_size % 25 + 1) AS r, p_partkey AS ord, CASE p_size % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS risk_level FROM part)"
_SQL_LAST = f"{_SQL_RULES}, la AS (SELECT lo, hi, arg_max(risk_level, ord) AS risk_level FROM (SELECT least(l, r) AS lo, greatest(l, r) AS hi, risk_level, ord FROM ru) GROUP BY lo, hi)"


@query(f"""WITH {_SQL_RULES}, la AS (SELECT l, r, arg_max(risk_level, ord) AS risk_level FROM ru GROUP BY l, r),
    p AS (SELECT l AS s_name, CASE WHEN risk_level = 'High' THEN 'CONTRAINDICATED_WITH' ELSE 'INTERACTS_WITH' END AS rel, 'Drug' AS o_label, r AS o_name, CAST(CASE risk_level WHEN 'High' THEN 1.3 WHEN 'Medium' THEN 1.1 ELSE 0.9 END AS DOUBLE) AS weight, risk_level FROM la)
    SELECT s_name, rel, o_label, o_name, weight FROM p UNION ALL SELECT DISTINCT s_name, 'MAY_CAUSE', 'Risk', risk_level, CAST(0.8 AS DOUBLE) FROM p""")
def kg_rule_edges(spark, sf_dir):
    """The last rule of each ordered brand pair as edges."""
    rules = _rules(spark, sf_dir).groupBy("left", "right").agg(F.max_by("risk_level", "ord").alias("risk_level"))
    return kg.rule_edges(rules).select("s_name", "rel", "o_label", "o_name", "weight")


def _places(spark, sf_dir):
    """suppliers - nation - region as a graph."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    live = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    weight = F.when(F.col("s_acctbal") > 5000, 1.3).when(F.col("s_acctbal") > 0, 1.1).otherwise(0.8)
    one = live.select(F.lit("Drug").alias("s_label"), F.col("s_name"), F.lit("BELONGS_TO").alias("rel"), F.lit("DrugClass").alias("o_label"), F.col("n_name").alias("o_name"), weight.alias("weight"))
    two = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.lit("DrugClass").alias("s_label"), F.col("n_name").alias("s_name"), F.lit("MAY_CAUSE").alias("rel"), F.lit("Risk").alias("o_label"), F.col("r_name").alias("o_name"), F.lit(0.9).alias("weight"))
    return one.union(two)


_SQL_PLACES = """WITH ed AS (SELECT 'Drug' AS s_label, s_name, 'BELONGS_TO' AS rel, 'DrugClass' AS o_label, n_name AS o_name, CAST(CASE WHEN s_acctbal > 5000 THEN 1.3 WHEN s_acctbal > 0 THEN 1.1 ELSE 0.8 END AS DOUBLE) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'DrugClass', n_name, 'MAY_CAUSE', 'Risk', r_name, CAST(0.9 AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey),
    qs AS (SELECT c_custkey AS q, n_name AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey),
    hit AS (SELECT DISTINCT q, ed.* FROM qs JOIN ed ON ed.s_name = entity OR ed.o_name = entity),
    nb AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, s_name, rel, o_name) AS ord FROM hit)"""


def _asked_places(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("q"), F.array(F.lower("n_name")).alias("entities"), F.array("n_name").alias("drugs"))


def _neighbours(spark, sf_dir):
    edges = _places(spark, sf_dir)
    return kg.neighbours(_asked_places(spark, sf_dir), kg.nodes_of(edges), edges, 16)


@query(f"{_SQL_PLACES} SELECT q, ord, s_name AS subject, CASE rel WHEN 'BELONGS_TO' THEN '属于' ELSE '风险' END AS relation, o_name AS object, weight FROM nb WHERE ord <= 16")
def kg_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("q", F.col("ord").cast("long").alias("ord"), "subject", "relation", "object", "weight")


@query(f"{_SQL_PLACES} SELECT q, s_name AS subject, o_name AS object FROM nb JOIN qs USING (q) WHERE ord <= 16 AND s_name = entity AND o_name IN ('ASIA', 'EUROPE')")
def kg_relevant(spark, sf_dir):
    asked = _asked_places(spark, sf_dir).withColumn("context", F.array(F.lit("ASIA"), F.lit("EUROPE")))
    return kg.relevant(_neighbours(spark, sf_dir), asked).select("q", "subject", "object")


@query(f"""{_SQL_PLACES}, lv AS (SELECT q, ord, s_name AS subject, o_name AS object, CASE WHEN rel = 'MAY_CAUSE' AND o_name IN ('ASIA', 'AFRICA') THEN 3 WHEN rel = 'BELONGS_TO' THEN 2 END AS r FROM nb WHERE ord <= 16)
    SELECT q, CASE r WHEN 3 THEN 'High' ELSE 'Medium' END AS level, subject, object FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r DESC, ord) AS n FROM lv WHERE r IS NOT NULL) WHERE n = 1""")
def graph_signal(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).withColumn("risk_level", F.when((F.col("rel") == "MAY_CAUSE") & F.col("object").isin("ASIA", "AFRICA"), "High"))
    return risk.graph_signal(rows, medium=("属于",), high=()).select("q", "level", "subject", "object")


# --- rules -------------------------------------------------------------------------------------------


def _ordered_brands(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_brand"))).alias("b"))
    return rows.select("q", F.transform("b", lambda x: x["p_brand"]).alias("drugs"))


@query(f"""WITH {_SQL_LAST}, b AS (SELECT l_orderkey AS q, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
    h AS (SELECT x.q, x.p_brand AS "left", y.p_brand AS "right", risk_level, row_number() OVER (PARTITION BY x.q ORDER BY x.i, y.i) AS n FROM b x JOIN b y ON x.q = y.q AND x.i < y.i JOIN la ON lo = least(x.p_brand, y.p_brand) AND hi = greatest(x.p_brand, y.p_brand))
    SELECT q, "left", "right", risk_level FROM h WHERE n = 1""")
def pair_rules(spark, sf_dir):
    return risk.first_pair(_ordered_brands(spark, sf_dir), risk.last_rules(_rules(spark, sf_dir))).select("q", "left", "right", "risk_level")


@query(f"""WITH {_SQL_LAST}, b AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, unnest([p_brand, 'Brand#' || (p_size % 25 + 1)]) AS m FROM lineitem JOIN part ON l_partkey = p_partkey),
    h AS (SELECT x.q, x.m AS "left", y.m AS "right", risk_level, row_number() OVER (PARTITION BY x.q ORDER BY x.i, y.i, x.m, y.m) AS n FROM (SELECT DISTINCT * FROM b) x JOIN (SELECT DISTINCT * FROM b) y ON x.q = y.q AND x.i < y.i JOIN la ON lo = least(x.m, y.m) AND hi = greatest(x.m, y.m))
    SELECT q, "left", "right", risk_level FROM h WHERE n = 1""")
def pair_across_concepts(spark, sf_dir):
    """Each line's brand and its substitute are one concept."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct("l_linenumber", "l_partkey", F.array_distinct(F.array("p_brand", F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string")))).alias("c"))
    rows = lines.groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_list(item)).alias("b")).select("q", F.posexplode("b").alias("i", "x"))
    return risk.first_pair_across(rows.select("q", "i", F.col("x.c").alias("candidates")), risk.last_rules(_rules(spark, sf_dir))).select("q", "left", "right", "risk_level")


_GROUPS = (("older", ("the", "les")), ("younger", ("und", "que")))


def _signals(spark, sf_dir):
    rows = rq.evidence(spark, sf_dir, 8).select("q", "section", F.col("text").alias("snippet"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("older"))).otherwise(F.array(F.lit("younger"), F.lit("es"))).alias("population"))
    return asked, rows


_SQL_SIGNAL = rq._SQL_LIST + """, p AS (SELECT q, unnest(CASE WHEN q % 2 = 0 THEN ['older'] ELSE ['younger', 'es'] END) AS grp FROM questions),
    m AS (SELECT p.q, grp, section, text, section || ' ' || text AS t FROM p JOIN ev USING (q) WHERE ord <= 8)"""


@query(_SQL_SIGNAL + f""", f AS (SELECT * FROM m WHERE (grp = 'older' AND {sql_any('t', ('the', 'les'))}) OR (grp = 'younger' AND {sql_any('t', ('und', 'que'))}) OR (grp = 'es' AND contains(t, 'es')))
    SELECT q, CASE WHEN bool_or({sql_any('text', HIGH)}) THEN 'High' ELSE 'Medium' END AS level, array_to_string(list_sort(list(DISTINCT grp)), '|') AS groups FROM f GROUP BY q HAVING bool_or({sql_any('text', HIGH)}) OR bool_or({sql_any('text', ('tion', 'ein'))})""")
def population_signal(spark, sf_dir):
    return risk.population_signal(*_signals(spark, sf_dir), table=_GROUPS, high=HIGH, medium=("tion", "ein")).select("q", "level", _text("groups"))


@query(_SQL_SIGNAL + """, f AS (SELECT *, regexp_matches(t, '(?s)lich.{0,15}ein|ein.{0,15}lich') AND grp = 'younger' OR regexp_matches(t, '(?s)the .{0,15}ein|ein.{0,15}the ') AND grp = 'older' AS near FROM m WHERE (grp = 'older' AND contains(t, 'the ')) OR (grp = 'younger' AND contains(t, 'lich')))
    SELECT q, 'Medium' AS level, array_to_string(list_sort(list(DISTINCT grp)), '|') AS conditions FROM f GROUP BY q HAVING bool_or(near)""")
def condition_signal(spark, sf_dir):
    asked, rows = _signals(spark, sf_dir)
    asked = asked.withColumnRenamed("population", "conditions")
    found = risk.condition_signal(asked, rows, table=(("older", ("the ",)), ("younger", ("lich",))), high=("ein",), medium=(), window=18)
    return found.select("q", "level", _text("conditions"))


def _scored(spark, sf_dir):
    """Orders as questions: levels from order facts, combined by the rules."""
    orders = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    pick = lambda n, *levels: F.element_at(F.array(*[F.lit(x) if x else F.lit(None).cast("string") for x in levels]), (key % n + 1).cast("int"))
    rows = orders.select(
        F.col("o_orderkey").alias("q"), (key % 4).cast("int").alias("concepts"), (key % 11 == 0).alias("ambiguous"), (key % 7).cast("int").alias("evidence"), (key % 5 == 0).alias("pair"),
        pick(3, "Low", "Medium", "High").alias("base"), pick(5, None, "Medium", None, "High", None).alias("population"), pick(6, None, "Medium", None, None, None, None).alias("condition"),
        pick(8, None, "High", None, "Medium", None, None, None, None).alias("graph"), (price > 100000).alias("named"),
    )
    level = risk.combined(F.col("concepts"), F.col("ambiguous"), F.col("evidence"), F.col("pair"), F.col("base"), F.col("population"), F.col("condition"), F.col("graph"))
    return rows.withColumn("level", level)


_SQL_SCORED = """WITH s AS (SELECT o_orderkey AS q, o_orderkey % 4 AS concepts, o_orderkey % 11 = 0 AS ambiguous, o_orderkey % 7 AS evidence, o_orderkey % 5 = 0 AS pair, o_totalprice > 100000 AS named,
        [1, 2, 3][o_orderkey % 3 + 1] AS b, [NULL, 2, NULL, 3, NULL][o_orderkey % 5 + 1] AS p, [NULL, 2, NULL, NULL, NULL, NULL][o_orderkey % 6 + 1] AS c, [NULL, 3, NULL, 2, NULL, NULL, NULL, NULL][o_orderkey % 8 + 1] AS g FROM orders),
    r AS (SELECT *, CASE WHEN ambiguous AND concepts < 2 THEN 0 WHEN concepts < 2 THEN CASE WHEN concepts >= 1 THEN coalesce(p, c, 0) ELSE 0 END WHEN evidence = 0 AND NOT pair AND g IS NULL THEN 0 ELSE greatest(b, coalesce(p, 0), coalesce(c, 0), coalesce(g, 0)) END AS r FROM s),
    l AS (SELECT *, ['Unknown', 'Low', 'Medium', 'High'][r + 1] AS level FROM r)"""


@query(f"{_SQL_SCORED} SELECT q, level, CAST(CASE WHEN pair THEN 0.88 WHEN level = 'Unknown' THEN 0.32 ELSE round(least(0.82, 0.48 + 0.06 * least(evidence, 5) + 0.03 * least(concepts, 5)), 2) END AS DOUBLE) AS confidence FROM l")
def combined_risk(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.select("q", "level", risk.confidence(F.col("level"), F.col("pair"), F.col("evidence"), F.col("concepts")).alias("confidence"))


@query(f"""{_SQL_SCORED} SELECT q, CASE WHEN pair THEN 'rule' ELSE substr(CASE level WHEN 'High' THEN '不建议' WHEN 'Medium' THEN '可以作' WHEN 'Low' THEN '当前证' ELSE CASE WHEN named THEN '目前存' ELSE '建议补' END END, 1, 3) END AS recommendation,
    CASE WHEN pair THEN 'a 与 b 存在 ' || level || ' 级用药风险。' WHEN level = 'Unknown' THEN '证据不足，暂不能给出确定性用药安全结论。' ELSE '基于当前上下文、知识图谱关系和检索证据，综合风险等级为 ' || level || '。' END AS conclusion FROM l""")
def recommendation(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    own = F.when(F.col("pair"), F.lit("rule"))
    text_ = risk.recommendation(F.col("level"), own, F.col("named"))
    return rows.select("q", F.when(F.col("pair"), text_).otherwise(F.substring(text_, 1, 3)).alias("recommendation"), risk.conclusion(F.col("level"), F.when(F.col("pair"), F.lit("a")), F.lit("b")).alias("conclusion"))


@query(f"""{_SQL_SCORED}, f AS (SELECT q, level, list_filter([CASE WHEN ambiguous THEN 'warning:ambiguous_names' END, CASE WHEN level = 'High' THEN 'danger:high_risk' END, CASE WHEN evidence = 0 THEN 'warning:no_evidence' END, CASE WHEN concepts < 2 THEN 'info:few_concepts' END,
    CASE WHEN p IS NOT NULL THEN CASE WHEN p = 3 THEN 'danger' ELSE 'warning' END || ':population' END, CASE WHEN c IS NOT NULL THEN 'warning:condition' END], lambda x: x IS NOT NULL) AS f FROM l)
    SELECT q, array_to_string(f, ',') AS flags, level = 'Unknown' OR contains(array_to_string(f, ','), 'warning') AS downgraded FROM f""")
def safety_flags(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    flags = risk.safety_flags(*map(F.col, ("level", "evidence", "concepts", "ambiguous", "population", "condition")))
    rows = rows.withColumn("f", flags)
    return rows.select("q", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["level"], x["code"])), ",").alias("flags"), risk.downgraded(F.col("level"), F.col("f")).alias("downgraded"))


@query(f"""{_SQL_SCORED}, f AS (SELECT q, level, concepts, unnest(list_filter([CASE WHEN ambiguous THEN 'ambiguous_names' END, CASE WHEN level = 'High' THEN 'high_risk' END, CASE WHEN evidence = 0 THEN 'no_evidence' END,
    CASE WHEN concepts < 2 THEN 'few_concepts' END, CASE WHEN p IS NOT NULL THEN 'population' END, CASE WHEN c IS NOT NULL THEN 'condition' END], lambda x: x IS NOT NULL)) AS code FROM l)
    SELECT q, code, CASE code WHEN 'ambiguous_names' THEN CASE WHEN concepts >= 2 AND level <> 'Unknown' THEN 'N' || q || '未识别为明确药品，未纳入本次相互作用计算。' ELSE 'N' || q || '不是明确的具体药品名称，请补充具体名称后再判断。' END
    WHEN 'high_risk' THEN '存在高风险或禁忌线索，不建议自行合用。' WHEN 'no_evidence' THEN '未召回足够说明书/指南证据，结论已降级处理。' WHEN 'few_concepts' THEN '当前上下文少于两个明确药物，无法完整评估相互作用。' ELSE 'signal' END AS message FROM f""")
def safety_messages(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    rows = rows.select("q", "level", "concepts", F.explode(risk.safety_flags(*map(F.col, ("level", "evidence", "concepts", "ambiguous", "population", "condition")))).alias("f"))
    message = risk.flag_message(F.col("f.code"), F.concat(F.lit("N"), F.col("q").cast("string")), F.col("level"), F.col("concepts"), F.lit("signal"))
    return rows.select("q", F.col("f.code").alias("code"), message.alias("message"))


def _sourced(spark, sf_dir):
    return part_records(spark, sf_dir).withColumn("source", F.when(F.col("drug").startswith("r"), "labels"))


@query("""WITH d AS (SELECT p_name AS name, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS aliases, CASE WHEN p_name LIKE 'r%' THEN 'labels' ELSE 'local_dataset' END AS source FROM part GROUP BY p_name)
    SELECT 'Drug' AS label, name, source, aliases FROM d UNION ALL SELECT DISTINCT 'Source', source, NULL, NULL FROM d""")
def kg_drug_nodes(spark, sf_dir):
    return kg.drug_graph(_sourced(spark, sf_dir))[0].select("label", "name", "source", _text("aliases"))


@query("""SELECT DISTINCT p_name AS s_name, 'SUPPORTED_BY' AS rel, 'Source' AS o_label, CASE WHEN p_name LIKE 'r%' THEN 'labels' ELSE 'local_dataset' END AS o_name, CAST(0.6 AS DOUBLE) AS weight FROM part""")
def kg_supported_by(spark, sf_dir):
    return kg.drug_graph(_sourced(spark, sf_dir))[1].select("s_name", "rel", "o_label", "o_name", "weight")


@query("""SELECT DISTINCT p_brand AS s_name, CASE WHEN p_size % 2 = 0 THEN 'MAY_CAUSE' ELSE 'BELONGS_TO' END AS rel, p_type AS o_name, CAST(CASE WHEN p_size % 2 = 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS weight FROM part""")
def kg_static_edges(spark, sf_dir):
    """Brands and types as a rule table."""
    rows = table(spark, sf_dir, "part").select(F.lit("Drug").alias("s_label"), F.col("p_brand").alias("s_name"), F.when(F.col("p_size") % 2 == 0, "MAY_CAUSE").otherwise("BELONGS_TO").alias("rel"), F.lit("Risk").alias("o_label"), F.col("p_type").alias("o_name")).distinct()
    return kg.static_edges(rows, {"MAY_CAUSE": 0.8, "BELONGS_TO": 1.0}).select("s_name", "rel", "o_name", "weight")


@query("""WITH d AS (SELECT p_name AS drug, min(p_partkey) AS ord, list(DISTINCT p_brand) AS aliases FROM part GROUP BY p_name),
    r AS (SELECT ord, 0 AS p, drug, drug AS x FROM d UNION ALL SELECT ord, 1, drug, unnest(aliases) FROM d),
    v AS (SELECT ord, p, drug, lower(unnest(list_distinct([x, replace(x, '1', '2'), replace(x, '2', '1')]))) AS name FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, CASE WHEN p = 0 THEN -ord ELSE ord END) AS n FROM v),
    o AS (SELECT name, drug AS canonical, CASE WHEN p = 0 THEN 'knowledge_base' ELSE 'knowledge_base_alias' END AS source FROM k WHERE n = 1)
    SELECT * FROM o UNION ALL SELECT DISTINCT lower(p_type), 'T', 'interaction_ref' FROM part WHERE lower(p_type) NOT IN (SELECT name FROM o)""")
def alias_dictionary(spark, sf_dir):
    """Part names and their brands as names; types fill what is free."""
    extra = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.lit("T").alias("canonical"))
    return names.alias_dictionary(part_records(spark, sf_dir), extra, "1", "2")


@query("SELECT count(*) AS records, CAST(sum(p_size % 4) AS BIGINT) AS interactions FROM part")
def risk_totals(spark, sf_dir):
    return knowledge.risk_totals(table(spark, sf_dir, "part").select(F.array_repeat("p_type", (F.col("p_size") % 4).cast("int")).alias("interactions")))
