"""Registered queries of readers and sinks: a table is written out in a format and read back by the library's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, knowledge, names
from ..sources import readers, store
from .common import sql_any, table
from .text_queries import SQL as TEXT
from .text_queries import _SQL_SENTENCES, sql_packed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: ``clean_page`` of a column, as the query ``clean_page_text`` has it.
def sql_clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '\n\s*-?\s*\d+\s*-?\s*\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- document files ----------------------------------------------------------------------------------


@query(f"SELECT 'T' || doc_id AS title, source AS drug, lang AS section, md5({sql_clean('text')}) AS text FROM documents WHERE {sql_clean('text')} <> ''")
def csv_documents(spark, sf_dir):
    """Documents as CSV with a header, quoted line breaks and all."""
    path = store.fresh(spark, "csv")
    _docs(spark, sf_dir).select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("drug"), F.col("lang").alias("section"), "text").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.read_csv_documents(spark, path).select("title", "drug", "section", F.md5("text").alias("text"))


@query(f"SELECT item_id, md5({sql_clean('text')}) AS text FROM benchmark")
def txt_documents(spark, sf_dir):
    """Benchmark texts as files of one text each."""
    path = store.fresh(spark, "txt")
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    found = readers.read_txt_documents(spark, path)
    return found.select(F.regexp_extract("source_path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text"))


@query(f"""WITH s AS (SELECT source, lang, arg_min(text, doc_id) AS text FROM documents GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS j FROM s)
    SELECT 'D ' || source AS title, source AS drug, lang AS section, CAST(j AS BIGINT) AS j, md5({sql_clean('text')}) AS text FROM o WHERE {sql_clean('text')} <> ''""")
def json_documents(spark, sf_dir):
    """One JSON object a source, with a section for each language."""
    path = store.fresh(spark, "json")
    firsts = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("content"))
    objects = firsts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("title"), "content"))).alias("sections"))  # a section for each of a few languages
    objects.select(F.col("source").alias("key"), F.col("source").alias("drug"), F.concat(F.lit("D "), "source").alias("title"), "sections").repartition("key").write.partitionBy("key").json(path)
    rows = readers.read_json_documents(spark, path)
    return rows.select("title", "drug", "section", F.element_at(F.split("source_id", "::"), -1).cast("long").alias("j"), F.md5("text").alias("text"))


def _folder(spark, sf_dir) -> str:
    """A folder of text files, CSV files, JSON files and files of no supported kind."""
    path = store.fresh(spark, "folder")
    rows = table(spark, sf_dir, "benchmark")
    rows.select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(f"{path}/txt")
    nations = table(spark, sf_dir, "nation")
    nations.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("drug"), F.lit("a title").alias("title"), F.lit("a text of a nation").alias("text")).repartition("key").write.partitionBy("key").json(f"{path}/json")
    nations.select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("title"), F.lit("a row of a nation").alias("text")).repartition("key").write.partitionBy("key").option("header", True).csv(f"{path}/csv")
    table(spark, sf_dir, "region").repartition("r_regionkey").write.partitionBy("r_regionkey").parquet(f"{path}/other")
    return path


@query("""WITH b AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT count(*) AS n FROM region), na AS (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS regions FROM nation)
    SELECT b.n + na.n + na.regions + r.n AS files, r.n AS skipped, 0 AS failed, 'csv:' || na.regions || '|json:' || na.n || '|txt:' || b.n AS by_type, (SELECT sum(greatest(1, ceil(length(text) / 600.0))) FROM benchmark) > 0 AS chunked FROM b, r, na""")
def ingestion_report(spark, sf_dir):
    """The report over a folder: files by type, skipped and failed ones."""
    path = _folder(spark, sf_dir)
    found = store.written(readers.read_documents(spark, path), "documents")
    report = readers.ingestion_report(readers.file_listing(spark, path), found, readers.document_chunks(found))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "|")
    return report.select("files", "skipped", "failed", kinds.alias("by_type"), (F.col("chunks") > 0).alias("chunked"))


@query("SELECT p_partkey, p_name AS name, p_brand AS brand, row_number() OVER (ORDER BY p_partkey) AS row FROM part")
def sheet_rows(spark, sf_dir):
    """Parts as exported sheets: a folder given twice is read once, ordinals run over all files."""
    path = store.fresh(spark, "sheets")
    table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias(" name "), F.col("p_brand").alias("brand")).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.read_sheet(spark, [path, path]).select(F.col("p_partkey").cast("long").alias("p_partkey"), "name", "brand", F.col("row").cast("long").alias("row"))


# --- records -----------------------------------------------------------------------------------------


@query("SELECT p_brand AS drug, count(*) AS source_row_count, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS aliases FROM part GROUP BY p_brand")
def knowledge_file(spark, sf_dir):
    """Records of brands as knowledge JSON, one object a file, written and read with their schema."""
    path = store.fresh(spark, "knowledge")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("drug")).agg(F.array_sort(F.collect_set("p_type")).alias("aliases"), F.count("*").cast("int").alias("source_row_count"))  # types are a fixed list
    rows.withColumn("key", F.col("drug")).repartition("key").write.partitionBy("key").json(path)
    return readers.read_knowledge(spark, path).select("drug", F.col("source_row_count").cast("long").alias("source_row_count"), F.array_join("aliases", "|").alias("aliases"))


@query("SELECT l_orderkey, l_linenumber, 'supplier' || l_suppkey AS subject, 'part' || l_partkey AS object, CAST(l_discount AS DOUBLE) AS confidence FROM lineitem")
def candidate_lines(spark, sf_dir):
    """Order lines as candidate JSON lines, with blank lines between the files' objects left to the reader."""
    path = store.fresh(spark, "candidates")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("R").alias("relation"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("object"), F.array(F.col("l_orderkey").cast("int"), F.col("l_linenumber").cast("int")).alias("source_rows"), F.col("l_discount").cast("double").alias("confidence"))
    readers.write_json(rows, path)
    found = readers.read_candidates(spark, path)
    return found.select(F.get("source_rows", F.lit(0)).cast("long").alias("l_orderkey"), F.get("source_rows", F.lit(1)).cast("long").alias("l_linenumber"), "subject", "object", "confidence")


@query("SELECT p_type AS alias, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS targets, 'review' AS source FROM part GROUP BY p_type")
def override_file(spark, sf_dir):
    """Alias overrides as JSON; no file means none."""
    path = store.fresh(spark, "overrides")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("alias")).agg(F.array_sort(F.collect_set("p_name")).alias("targets"), F.lit("review").alias("source"))
    rows.withColumn("key", F.col("alias")).repartition("key").write.partitionBy("key").json(path)
    found = readers.read_overrides(spark, path).select("alias", "targets", "source").unionByName(readers.read_overrides(spark, None))
    return found.select("alias", F.array_join("targets", "|").alias("targets"), "source")


@query(TEXT["chunk_window_700"])
def chunk_export(spark, sf_dir):
    """Chunks written by partitions of their language and read back."""
    path = store.fresh(spark, "chunks")
    chunks = chunking.page_chunks(_docs(spark, sf_dir), "doc_id", "text").join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    readers.write_table(chunks, path, ["lang"])
    return spark.read.parquet(path).select("doc_id", "chunk_index", "chunk")


# --- record rules ------------------------------------------------------------------------------------

_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({0}, ''), chr(12288), ' '), '\|', '。', 'g'), '\?\?+', '？', 'g'), '\s+', ' ', 'g'), '([。；;]) +', '\1', 'g'), ' ;；。')"


def _sql_name(x: str) -> str:
    return f"regexp_replace({_NORMAL.format(x)}, '\\s+', '', 'g')"


@query(f"""WITH c AS (SELECT {_sql_name('source')} AS drug, doc_id AS row, unnest(['L', 'T']) AS title, unnest([{_NORMAL.format('lang')}, {_NORMAL.format('text')}]) AS text FROM documents)
    SELECT drug, title, row, md5(text) AS text FROM c WHERE drug <> ''""")
def section_cells(spark, sf_dir):
    """Rows unpivoted into cells of sections under the normalised name."""
    rows = _docs(spark, sf_dir).select(F.col("source").alias("name"), F.lit("").alias("title_text"), F.col("doc_id").alias("row"), "lang", "text")
    return knowledge.section_rows(rows, {"lang": "L", "text": "T"}).select("drug", "title", "row", F.md5("text").alias("text"))


@query(f"""WITH p AS (SELECT {_sql_name('p_brand')} AS drug, {_sql_name('p_type')} AS own, {_sql_name("p_brand || ' ' || p_name")} AS long FROM part),
    a AS (SELECT drug, own AS alias FROM p WHERE own <> '' AND own <> drug UNION SELECT drug, long FROM p WHERE contains(long, drug) AND long <> drug)
    SELECT drug, array_to_string(list_sort(list(alias)), '|') AS aliases FROM a GROUP BY drug""")
def title_aliases(spark, sf_dir):
    """Brands other than the name, and titles that hold the name, as aliases."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", F.concat_ws(" ", "p_brand", "p_name").alias("title"))
    return knowledge.aliases(rows, "p_brand", "p_type", "title").select("drug", F.array_join("aliases", "|").alias("aliases"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, ',', '，'), '\n\s*-?\s*\d+\s*-?\s*\n', chr(10), 'g'), '([，、；。])\n([^\n])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents""")
def clean_guideline_text(spark, sf_dir):
    """Guideline cleaning: lines broken after a comma are joined."""
    return _docs(spark, sf_dir).select("doc_id", text.clean_guideline(F.replace("text", F.lit(","), F.lit("，"))).alias("cleaned"))


def _sql_items(x: str) -> str:
    """Numbered items of a collapsed text, else its sentences, else the text."""
    split = lambda pattern: f"list_filter(list_transform(string_split_regex({x}, '{pattern}'), lambda v: trim(v, ' ;；。')), lambda v: length(v) >= 4)"
    items = split(r"(?:^|[。；;]\s*|\n+)\s*(?:\d+|[一二三四五六七八九十]+)[.、)]\s*")
    plain = _SQL_SENTENCES.replace("replace(text, '. ', '。')", x)
    return f"CASE WHEN {x} = '' THEN [] WHEN len({items}) > 1 THEN {items} WHEN len({plain}) > 0 THEN {plain} ELSE [{x}] END"


_SQL_BODY = r"trim(regexp_replace(replace(text, '. ', '。1.'), '\s+', ' ', 'g'))"


@query(f"WITH x AS (SELECT doc_id, {_SQL_BODY} AS x FROM documents), i AS (SELECT doc_id, {_sql_items('x')} AS items FROM x) SELECT doc_id, len(items) AS n_items, md5(array_to_string(items, '|')) AS items FROM i")
def numbered_items(spark, sf_dir):
    """Items of texts whose sentences are numbered."""
    items = text.numbered_items(F.replace("text", F.lit(". "), F.lit("。1.")))
    return _docs(spark, sf_dir).select("doc_id", F.size(items).cast("long").alias("n_items"), F.md5(F.array_join(items, "|")).alias("items"))


_TAGGED = (("old", ("old", "age")), ("young", ("und", "que")))


@query(f"""WITH RECURSIVE v AS (SELECT doc_id AS key, lang AS title, replace(text, '. ', '。1.') AS body, {_SQL_BODY} AS x FROM documents),
    w AS (SELECT *, title = 'es' OR length(body) <= 360 AS whole FROM v), it AS (SELECT key, {_sql_items('x')} AS items FROM w WHERE NOT whole), units AS (SELECT key, unnest(items) AS unit, generate_subscripts(items, 1) AS i FROM it), {sql_packed('units')},
    c AS (SELECT key, CAST(0 AS INTEGER) AS chunk_index, body AS chunk FROM w WHERE whole UNION ALL SELECT * FROM packed)
    SELECT key AS doc_id, chunk_index, md5(chunk) AS chunk, CASE WHEN whole THEN 'section' WHEN title = 'en' THEN 'clause' ELSE 'section_part' END AS chunk_type,
    concat_ws('|', CASE WHEN {sql_any('chunk', _TAGGED[0][1])} THEN 'old' END, CASE WHEN {sql_any('chunk', _TAGGED[1][1])} THEN 'young' END) AS population_tags, concat_ws('|', CASE WHEN contains(chunk, 'trash') THEN 'trash' END) AS risk_terms FROM c JOIN w USING (key)""")
def structured_chunks(spark, sf_dir):
    """Structure-first chunks of documents as sections of one variant: whole where short, else packed items; tagged."""
    sections = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("title"), F.array(F.replace("text", F.lit(". "), F.lit("。1."))).alias("texts"))
    rows = chunking.structured_chunks(sections, 360, ("es",), ("en",), _TAGGED, (), ("trash",))
    return rows.select("doc_id", "chunk_index", F.md5("text").alias("chunk"), "chunk_type", F.array_join("population_tags", "|").alias("population_tags"), F.array_join("risk_terms", "|").alias("risk_terms"))


@query(r"""WITH m AS (SELECT doc_id, text, regexp_replace('【' || lang || '】' || chr(10) || text, '(?m)(?:^|\n)\s*(?:【([^】]+)】|(\d+[.、]\s*[^\n]{2,20})|([^\n]{2,15})[：:]\s*$)', chr(1) || '\1\2\3' || chr(2), 'g') AS marked FROM documents),
    p AS (SELECT doc_id, unnest(list_filter(string_split(marked, chr(1)), lambda x: contains(x, chr(2)))) AS part, generate_subscripts(list_filter(string_split(marked, chr(1)), lambda x: contains(x, chr(2))), 1) AS i FROM m),
    s AS (SELECT doc_id, i, regexp_replace(lower(split_part(part, chr(2), 1)), '^\d+[.、]\s*', '') AS head, regexp_replace(substr(part, instr(part, chr(2)) + 1), '^\s+|\s+$', '', 'g') AS body FROM p),
    k AS (SELECT *, CASE WHEN contains(head, 'en') OR contains(head, 'the') THEN 'E' WHEN contains(head, 'fr') OR contains(head, 'de') THEN 'F' END AS title FROM s WHERE length(body) >= 10)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_index, title, length(body) AS n_chars FROM k WHERE title IS NOT NULL""")
def heading_sections(spark, sf_dir):
    """Documents under a heading of their language, split at headings."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("【"), "lang", F.lit("】\n"), "text").alias("body"))
    rows = chunking.heading_sections(docs, "doc_id", "body", (("E", ("en", "the")), ("F", ("fr", "de"))))
    # cleaning joins lines and drops page numbers; lengths before it are compared on texts without either
    return rows.select("doc_id", "section_index", "title", F.length("content").cast("long").alias("n_chars"))


@query(r"""WITH s AS (SELECT source, lang, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), d AS (SELECT source AS drug, lang AS section, doc_id, t, generate_series(1, CASE WHEN length(t) <= 160 THEN 1 ELSE length(t) END, 125) AS starts FROM s),
    e AS (SELECT drug, section, doc_id, t, unnest(starts) AS p, generate_subscripts(starts, 1) - 1 AS i FROM d)
    SELECT 'd' || doc_id || '::0::' || section || '::window::' || i AS chunk_id, md5(CASE WHEN length(t) <= 160 THEN t ELSE substr(t, p, 160) END) AS text, 'window' AS chunk_type FROM e""")
def retrieval_documents(spark, sf_dir):
    """Retrieval chunks of records of one section each, by windows."""
    chunks = F.array().cast(readers.CHUNK)
    section = F.struct(F.col("lang").alias("title"), F.col("text").alias("content"), chunks.alias("chunks"))
    records = _docs(spark, sf_dir).select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("drug"), F.array(section).alias("sections"))
    return chunking.retrieval_documents(records).select("chunk_id", F.md5("text").alias("text"), "chunk_type")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS name FROM benchmark),
    m AS (SELECT doc_id AS q, lang, regexp_extract(lower(text), '[a-z]{9,}') AS mention, regexp_extract(lower(text), '^[^a-z]*([a-z]+)', 1) AS normalized FROM documents)
    SELECT q, mention, coalesce(a.name, b.name) AS drug, coalesce(a.name, b.name) IS NULL AS ambiguous FROM m LEFT JOIN w a ON a.name = mention LEFT JOIN w b ON b.name = normalized WHERE lang <> 'fr'""")
def ambiguous_entities(spark, sf_dir):
    """Mentions of JSON payloads: the mention, then its normal form is looked up; French ones are in the past."""
    from .graph_queries import _words

    low = F.lower("text")
    item = F.struct(F.regexp_extract(low, "[a-z]{9,}", 0).alias("mention"), F.regexp_extract(low, "^[^a-z]*([a-z]+)", 1).alias("normalized"), F.when(F.col("lang") == "fr", "past").otherwise("current").alias("status"))
    payloads = _docs(spark, sf_dir).select(F.col("doc_id").alias("q"), F.concat(F.lit("answer: "), F.to_json(F.struct(F.array(item).alias("medications")))).alias("payload"))
    return names.payload_mentions(payloads, _words(spark, sf_dir))


@query("""WITH e AS (SELECT *, coalesce(value, 0) AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 300), g AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1) SELECT string_agg(event_type || ':' || n, '|' ORDER BY event_type) AS risk_distribution FROM g""")
def risk_distribution(spark, sf_dir):
    """How the last 300 events fall into levels: the limit is the operator."""
    from ..operators import metrics
    from .state_queries import _events

    rows = metrics.snapshot(metrics.last_events(_events(spark, sf_dir), 300))
    entries = F.array_sort(F.map_entries("risk_distribution"))
    return rows.select(F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "|").alias("risk_distribution"))
