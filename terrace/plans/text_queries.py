"""Registered queries of text functions, term statistics and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms, text
from ..operators import chunking, knowledge, retrieval, risk, sessions
from ..sources import readers
from .common import HIGH, MEDIUM, sql_any, sql_list, sql_tokens, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Counting by document and term holds all terms of a task's documents, so these are dealt out in small parts by document.
_PIECE = "4m"

_TERMS = f"t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, array_to_string({sql_tokens('text')}, ' ') AS joined FROM documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("joined"))


@query(f"WITH {_TERMS} SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def doc_term_freq(spark, sf_dir):
    return retrieval.term_counts(table(spark, sf_dir, "documents", _PIECE), "doc_id", F.col("text"))


@query(f"SELECT doc_id, greatest(len({sql_tokens('text')}), 1) AS n_tokens FROM documents")
def doc_length(spark, sf_dir):
    return retrieval.document_lengths(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(f"""WITH {_TERMS}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS idf FROM df, n""")
def idf_smooth(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", _PIECE)
    counts = retrieval.term_counts(docs, "doc_id", F.col("text"))
    return retrieval.smooth_idf(counts, docs.agg(F.count("*").alias("n"))).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {_TERMS}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, n""")
def idf_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", _PIECE)
    counts = retrieval.term_counts(docs, "doc_id", F.col("text"))
    return retrieval.bm25_idf(counts, docs.agg(F.count("*").alias("n"))).withColumn("idf", F.round("idf", 6))


def _sql_windows(size: int, overlap: int, clean: str, blank: str) -> str:
    return rf"""
    WITH c AS (SELECT doc_id, {clean} AS x FROM documents),
    s AS (SELECT doc_id, x, unnest(CASE WHEN length(x) <= {size} THEN [1] ELSE generate_series(1, length(x), {size - overlap}) END) AS s FROM c),
    w AS (SELECT doc_id, s, {blank.format(f'substr(x, s, {size})')} AS chunk FROM s)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, chunk FROM w {"WHERE chunk <> ''" if blank != "{}" else ""}"""


@query(_sql_windows(160, 35, r"trim(regexp_replace(text, '\s+', ' ', 'g'))", "{}"))
def chunk_window_160(spark, sf_dir):
    return chunking.window_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


_SQL_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\n\s*-?\s*\d+\s*-?\s*\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(_sql_windows(700, 100, _SQL_CLEAN.format("text"), "trim({}, ' ' || chr(10))"))
def chunk_window_700(spark, sf_dir):
    return chunking.page_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"SELECT page_id, {_SQL_CLEAN.format('html')} AS cleaned FROM pages")
def clean_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_page(F.col("html")).alias("cleaned"))


_SQL_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(replace(text, '. ', '。'), '([。！？；;])', '\1' || chr(1), 'g'), '\x01|(?:\s*\d+[.)、]\s*)'), lambda x: trim(x, ' ;；。')), lambda x: length(x) >= 4)"


@query(rf"SELECT doc_id, unnest({_SQL_SENTENCES}) AS sentence FROM documents")
def sentence_split(spark, sf_dir):
    body = F.replace("text", F.lit(". "), F.lit("。"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(body)).alias("sentence"))


def sql_packed(units: str, name: str = "packed") -> str:
    """CTEs that pack ``units`` (key, i from 1, unit) as ``chunking.pack_units`` does: ``name`` (key, chunk_index, chunk)."""
    close = "trim(array_to_string(cur, '。'), '。') || '。'"
    extra = "(length(unit) + CASE WHEN len(cur) > 0 THEN 1 ELSE 0 END)"
    over = f"len(cur) > 0 AND n + {extra} > 360"
    cuts = "list_transform(generate_series(1, greatest(length(unit), 1), 360), lambda s: trim(substr(unit, s, 360)))"
    return f"""fold AS (SELECT key, 0 AS i, CAST([] AS VARCHAR[]) AS cur, 0 AS n, CAST([] AS VARCHAR[]) AS done FROM (SELECT DISTINCT key FROM {units})
        UNION ALL SELECT f.key, u.i, CASE WHEN length(unit) > 360 THEN [] WHEN {over} THEN [cur[-1], unit] ELSE list_append(cur, unit) END,
            CASE WHEN length(unit) > 360 THEN 0 WHEN {over} THEN length(cur[-1]) + {extra} ELSE n + {extra} END,
            CASE WHEN length(unit) > 360 THEN list_concat(CASE WHEN len(cur) > 0 THEN [{close}] ELSE [] END, {cuts}) WHEN {over} THEN [{close}] ELSE [] END FROM fold f JOIN {units} u ON u.key = f.key AND u.i = f.i + 1),
    made AS (SELECT key, i, 0 AS last, unnest(done) AS chunk, generate_subscripts(done, 1) AS j FROM fold
        UNION ALL SELECT key, i, 1, {close}, 1 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS r FROM fold) WHERE r = 1 AND len(cur) > 0),
    {name} AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY i, last, j) - 1 AS INTEGER) AS chunk_index, chunk FROM made WHERE length(trim(chunk)) >= 4)"""


@query(f"""WITH RECURSIVE s AS (SELECT doc_id AS key, {_SQL_SENTENCES} AS ss FROM documents), units AS (SELECT key, unnest(ss) AS unit, generate_subscripts(ss, 1) AS i FROM s), {sql_packed('units')}
    SELECT key AS doc_id, chunk_index, chunk FROM packed""")
def pack_units(spark, sf_dir):
    """Sentences packed into chunks of 360 characters."""
    body = F.replace("text", F.lit(". "), F.lit("。"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pack_units(text.sentences(body))).alias("chunk_index", "chunk"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(12288), ' '), '\|', '。', 'g'), '\?\?+', '？', 'g'), '\s+', ' ', 'g'), '([。；;]) +', '\1', 'g'), ' ;；。') AS normalized FROM documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(f"""SELECT doc_id, array_to_string(list_filter({sql_list(HIGH + MEDIUM)}, lambda w: contains(text, w)), ',') AS risk_terms,
CASE WHEN {sql_any('text', HIGH)} THEN 'High' WHEN {sql_any('text', MEDIUM)} THEN 'Medium' ELSE 'Low' END AS level FROM documents""")
def tag_and_risk_of_text(spark, sf_dir):
    body = F.col("text")
    level = F.when(text.contains_any(body, HIGH), "High").when(text.contains_any(body, MEDIUM), "Medium").otherwise("Low")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.present(body, HIGH + MEDIUM), ",").alias("risk_terms"), level.alias("level"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?s)(?:and.{0,19}the|the.{0,19}and)') AS near FROM documents""")
def near_terms(spark, sf_dir):
    """the within reach of and: a window of 22 characters around each and holds a whole the."""
    return table(spark, sf_dir, "documents").select("doc_id", text.near_terms(F.col("text"), ["and"], ["the"], 22).alias("near"))


_PART = "('0x' || substr(md5(source || lang), {}, 8))::BIGINT"
_FOLD = f"((({_PART.format(1)} % 384 * 256 + {_PART.format(9)}) % 384 * 256 + {_PART.format(17)}) % 384 * 256 + {_PART.format(25)}) % 384"


@query(f"SELECT doc_id, CAST({_FOLD} AS INTEGER) AS bucket FROM documents")
def hash_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.hash_bucket(F.concat("source", "lang")).alias("bucket"))


@query("""WITH r AS (SELECT doc_id, sha256('{"drug":"' || source || '","aliases":["' || lang || '"]}') AS h FROM documents), b AS (SELECT doc_id // 4096 AS b, sha256(string_agg(h, chr(10) ORDER BY doc_id)) AS h FROM r GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM b""")
def dataset_fingerprint(spark, sf_dir):
    """The fingerprint of all records' names: digests of ranges of rows, digested again."""
    return knowledge.names_fingerprint(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("drug"), F.array("lang").alias("aliases")))


_FORMS = ("ring", "bolt", "gear", "widget")


@query(rf"""WITH x AS (SELECT p_partkey, p_brand, lower(regexp_replace(p_name, '\s+', '', 'g')) AS x FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(x, '^.{{2,}}?(?:{"|".join(_FORMS)})$') THEN regexp_replace(x, '(?:{"|".join(_FORMS)})$', '') ELSE x END AS base, CASE WHEN p_brand LIKE '%1%' THEN replace(p_brand, '1', '2') ELSE p_brand END AS variant FROM x""")
def name_rules(spark, sf_dir):
    """Base names of part names without the form, and a spelling variant of the brand."""
    part = table(spark, sf_dir, "part")
    variants = text.spelling_variants(F.col("p_brand"), "1", "2")
    return part.select("p_partkey", text.base_name(F.col("p_name"), _FORMS).alias("base"), F.get(variants, F.when(F.col("p_brand").contains("1"), 1).otherwise(0)).alias("variant"))


@query(r"""SELECT page_id, url, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS n_chars, regexp_matches(upper(html), 'CONTRAINDICATIONS|INTERACTIONS|WARNINGS|PRECAUTIONS') AS safety FROM pages""")
def page_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.length(text.without_tags(F.col("html"))).cast("long").alias("n_chars"), readers.names_safety(F.col("html")).alias("safety"))


_SECTIONS = (("en", ("the ", "and ")), ("fr", ("les ", "que ")), ("de", ("der ", "und ")))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('lower(text)', w)} THEN '{n}'" for n, w in _SECTIONS) + " END AS section FROM documents")
def classify_section(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_section(F.col("text"), _SECTIONS).alias("section"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_payload_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", text.json_object(F.concat(F.lit("payload: "), "props"), "k bigint")["k"].alias("k"))


# --- names, ages, lists ------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '( and| the).*$', '', 's'), '\s+', '', 'g') AS cut, CASE WHEN length(regexp_replace(regexp_replace(text, '( and| the).*$', '', 's'), '\s+', '', 'g')) >= 2 THEN regexp_replace(regexp_replace(text, '( and| the).*$', '', 's'), '\s+', '', 'g') ELSE text END AS title FROM (SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 60) AS text FROM documents)")
def name_of_title(spark, sf_dir):
    """The first words of a text as a title and as a file's stem, up to a word that ends a name."""
    head = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 60)
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("h"))
    return rows.select("doc_id", F.coalesce(text.name_of_file(F.col("h"), " and| the"), F.regexp_replace(F.regexp_replace("h", "( and| the).*$", ""), r"\s+", "")).alias("cut"), text.name_of_title(F.col("h"), " and| the").alias("title"))


@query(r"SELECT p_partkey, regexp_replace(trim(p_name), '\s+', '', 'g') AS name FROM part")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_name(F.col("p_name")).alias("name"))


_TENS = "['', '十', '二十', '三十', '四十', '五十', '六十', '七十', '八十', '九十']"
_ONES = "['', '一', '二', '三', '四', '五', '六', '七', '八', '九']"


@query("SELECT c_custkey, CAST(c_custkey % 140 AS INTEGER) AS age, CASE WHEN c_custkey % 140 < 18 THEN '儿童' WHEN c_custkey % 140 BETWEEN 65 AND 130 THEN '老年人' END AS grp, CASE WHEN c_custkey % 99 < 17 THEN '儿童' WHEN c_custkey % 99 >= 64 THEN '老年人' END AS spelled_group, CAST(c_custkey % 99 + 1 AS INTEGER) AS spelled FROM customer WHERE c_custkey % 140 <= 130")
def ages(spark, sf_dir):
    """Customers' numbers as ages in digits and in words: read back from a sentence, with their groups."""
    number = (F.col("c_custkey") % 99 + 1).cast("int")
    digit = lambda n: F.element_at(F.array(*[F.lit(c) for c in ("", *"一二三四五六七八九")]), n.cast("int") + 1)
    tens = F.floor(number / 10)
    words = F.concat(F.when(tens == 1, "").otherwise(digit(tens)), F.when(tens > 0, "十").otherwise(""), digit(number % 10))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.ages(F.concat(F.lit("今年"), (F.col("c_custkey") % 140).cast("string"), F.lit("岁"))).alias("a"), text.ages(F.concat(F.lit("患者"), words, F.lit("岁"))).alias("b"))
    rows = rows.where("size(a) > 0").select("c_custkey", F.get("a", F.lit(0)).alias("age"), F.get("b", F.lit(0)).alias("spelled"))
    return rows.select("c_custkey", "age", text.age_group(F.col("age")).alias("grp"), "spelled", text.age_group(F.col("spelled")).alias("spelled_group"))


_NESTED = ("the", "other", "her", "tion", "ation", "ein", "eine")


@query(f"""WITH f AS (SELECT doc_id, list_filter({sql_list(_NESTED)}, lambda w: contains(text, w)) AS w FROM documents)
    SELECT doc_id, array_to_string(w, ',') AS present, array_to_string(list_sort(list_filter(w, lambda x: len(list_filter(w, lambda y: y <> x AND contains(y, x))) = 0)), ',') AS longest FROM f""")
def keyword_lists(spark, sf_dir):
    """Words in list order, and those that are not part of another word that occurs."""
    body = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.present(body, _NESTED), ",").alias("present"), F.array_join(text.longest_present(body, _NESTED), ",").alias("longest"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS cut FROM documents")
def section_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.truncated(F.col("text"), 300).alias("cut"))


@query("SELECT p_partkey, regexp_matches(lower(p_name || ' ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' mg' ELSE ' m' END), '[0-9]+\\s*(mg|毫克|片|粒)') AS asks FROM part")
def dosage_flag(spark, sf_dir):
    value = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "mg").otherwise("m"))
    return table(spark, sf_dir, "part").select("p_partkey", risk.asks_dosage(value).alias("asks"))


@query("SELECT o_orderkey AS q, CASE WHEN o_orderkey % 3 > 0 THEN 'now' || (o_orderkey % 3) ELSE 'memory' END AS drugs FROM orders")
def query_drugs(spark, sf_dir):
    """What a question mentions, else what its session does."""
    key = F.col("o_orderkey")
    now = F.when(key % 3 > 0, F.array(F.concat(F.lit("now"), (key % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select(key.alias("q"), F.array_join(sessions.query_drugs(now, F.array(F.lit("memory"))), ",").alias("drugs"))


@query("SELECT o_orderkey AS q, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0.86 WHEN o_orderkey % 3 = 0 THEN 0.35 ELSE 0.62 END AS DOUBLE) AS confidence FROM orders")
def report_confidence(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("q"), risk.report_confidence(F.when(key % 3 == 0, "Unknown").otherwise("Low"), key % 4 == 0).alias("confidence"))


# --- pages and chunks of sources ---------------------------------------------------------------------

_SQL_PAGE_DOCUMENTS = f"pd AS (SELECT source || '/' || lang || '.pdf' AS file, doc_id AS page, {_SQL_CLEAN.format('text')} AS text, lang AS title FROM documents)"


def _page_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return readers.page_documents(docs.select(F.concat("source", F.lit("/"), "lang", F.lit(".pdf")).alias("file"), F.col("doc_id").alias("page"), "text"))


@query(f"WITH {_SQL_PAGE_DOCUMENTS} SELECT title || '.pdf::page::' || page AS source_id, file AS source_path, title, CAST(page AS INTEGER) AS page, md5(text) AS text FROM pd WHERE text <> ''")
def page_documents(spark, sf_dir):
    """Documents as pages of a file per source and language."""
    return _page_documents(spark, sf_dir).select("source_id", "source_path", "title", "page", F.md5("text").alias("text"))


@query(f"""WITH {_SQL_PAGE_DOCUMENTS}, s AS (SELECT *, unnest(CASE WHEN length(text) <= 700 THEN [1] ELSE generate_series(1, length(text), 600) END) AS s FROM pd WHERE text <> ''),
    c AS (SELECT *, trim(substr(text, s, 700), ' ' || chr(10)) AS chunk FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s) - 1 AS i FROM c WHERE chunk <> '')
    SELECT title || '.pdf::page::' || page || '::chunk::' || i AS chunk_id, title AS drug, '正文' AS section, md5(chunk) AS text FROM n""")
def document_chunks(spark, sf_dir):
    """Chunks of 700 characters of those pages; the texts name no section, so all get the default one."""
    return readers.document_chunks(_page_documents(spark, sf_dir)).select("chunk_id", "drug", "section", F.md5("text").alias("text"))


@query(r"""WITH r AS (SELECT doc_id % 500 AS doc, doc_id AS ord, lang || CASE WHEN doc_id % 3 = 0 THEN ' warnings' ELSE ' other' END AS title, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 2500) AS content FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS n FROM r WHERE contains(upper(title), 'WARNINGS')) SELECT doc AS doc_id, ord, title, md5(content) AS content FROM n WHERE n <= 8""")
def safety_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("doc_id"), F.col("doc_id").alias("ord"), F.concat("lang", F.when(F.col("doc_id") % 3 == 0, " warnings").otherwise(" other")).alias("title"), F.col("text").alias("content"))
    return readers.safety_sections(rows).select("doc_id", "ord", "title", F.md5("content").alias("content"))
