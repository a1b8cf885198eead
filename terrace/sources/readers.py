"""Sources and sinks: knowledge JSON, candidate JSON lines, document files, sheets, pages; exports and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, names

CHUNK = "array<struct<text string, chunk_type string, variant_index int, chunk_index int, source_rows array<int>, population_tags array<string>, condition_tags array<string>, risk_terms array<string>>>"
KNOWLEDGE = (
    "drug string, aliases array<string>, source string, source_urls array<string>, source_files array<string>, approval_numbers array<string>, source_row_count int, "
    f"sections array<struct<title string, content string, source_rows array<int>, variant_count int, chunks {CHUNK}>>, "
    "interactions array<struct<`with` string, risk_level string, mechanism string, recommendation string>>"
)
CANDIDATE = "subject string, relation string, object string, object_type string, risk_level string, evidence_text string, section string, source_rows array<int>, source_urls array<string>, confidence double"
OVERRIDE = "alias string, targets array<string>, source string"
_DOCUMENT_JSON = "drug string, title string, text string, content string, aliases array<string>, sections array<struct<title string, content string>>"
SUFFIXES = ("json", "csv", "txt")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge file; a missing one is an error."""
    return spark.read.schema(KNOWLEDGE).json(path, multiLine=True, mode="FAILFAST")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATE).json(path)


def read_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """Alias overrides; no path means none."""
    if path is None:
        return spark.createDataFrame([], OVERRIDE)
    return spark.read.schema(OVERRIDE).json(path, multiLine=True, mode="FAILFAST")


def _file(column: str = "_metadata.file_path") -> tuple[Column, Column, Column]:
    """(path, name, stem) of the file a row is from."""
    path = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))
    name = F.element_at(F.split(path, "/"), -1)
    return path, name, F.regexp_replace(name, r"\.[^.]*$", "")


def _documents(rows: DataFrame, source_type: str, place: Column) -> DataFrame:
    out = rows.select(F.concat_ws("::", "name", F.lit(source_type), place).alias("source_id"), F.col("path").alias("source_path"), F.lit(source_type).alias("source_type"), "title", text.clean_page(F.col("body")).alias("text"), F.lit(None).cast("int").alias("page"), "drug", "section", "aliases")
    return out.where("text <> ''") if source_type != "txt" else out




def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Objects or lists of objects; sections win over a flat text or content."""
    p, n, s = _file()
    rows = spark.read.schema(_DOCUMENT_JSON).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.[jJ][sS][oO][nN]")
    rows = rows.select("*", p.alias("path"), n.alias("name"), s.alias("stem"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1).cast("string"))
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif("drug", F.lit("")), "stem")).withColumn("drug", F.coalesce("drug", F.lit("")))
    none = F.array().cast("array<string>")
    parts = rows.where("sections is not null").select("*", F.posexplode("sections").alias("j", "sec"))
    parts = parts.select("path", "name", "title", "drug", F.coalesce("aliases", none).alias("aliases"), F.coalesce("sec.title", F.lit("")).alias("section"), F.coalesce("sec.content", F.lit("")).alias("body"), F.concat_ws("::", "i", F.col("j").cast("string")).alias("place"))
    flat = rows.where("sections is null").select("path", "name", "title", "drug", none.alias("aliases"), F.lit("").alias("section"), F.coalesce(F.nullif("text", F.lit("")), "content", F.lit("")).alias("body"), F.col("i").alias("place"))
    return _documents(parts.unionByName(flat), "json", F.col("place"))


def read_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows with text, content or section_content, in that order; rows without count in the row number."""
    p, n, s = _file()
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    column = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    first = lambda *cs: F.coalesce(*[column(c) for c in cs], F.lit(""))
    out = rows.select(p.alias("path"), n.alias("name"), F.coalesce(column("title"), column("drug"), s).alias("title"), first("drug").alias("drug"), first("section", "section_title").alias("section"), first("text", "content", "section_content").alias("body"), F.monotonically_increasing_id().alias("_at"))
    out = out.withColumns({"i": (F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1).cast("string"), "aliases": F.array().cast("array<string>")})
    return _documents(out, "csv", F.col("i"))


def read_txt_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file; Spark passes over files of no bytes."""
    p, n, s = _file()
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]")
    rows = rows.select(p.alias("path"), n.alias("name"), s.alias("title"), F.lit("").alias("drug"), F.lit("").alias("section"), F.col("value").alias("body"), F.array().cast("array<string>").alias("aliases"))
    return _documents(rows, "txt", F.lit("0"))


def page_documents(pages: DataFrame) -> DataFrame:
    """Documents of pages(file, page, text): blank pages are left out, numbers stay."""
    path = F.col("file")
    name = F.element_at(F.split(path, "/"), -1)
    rows = pages.select(F.concat_ws("::", name, F.lit("page"), F.col("page").cast("string")).alias("source_id"), path.alias("source_path"), F.lit("page").alias("source_type"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), text.clean_page(F.coalesce("text", F.lit(""))).alias("text"), F.col("page").cast("int").alias("page"), F.lit("").alias("drug"), F.lit("").alias("section"), F.array().cast("array<string>").alias("aliases"))
    return rows.where("text <> ''")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(file, text): the pages of each file in order, with an empty line between."""
    rows = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return rows.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All supported files under a folder."""
    return read_json_documents(spark, path).unionByName(read_csv_documents(spark, path)).unionByName(read_txt_documents(spark, path))


def document_chunks(documents: DataFrame, default: str = "正文") -> DataFrame:
    """Chunks of 700 characters; the section is the document's own, else what its whole text says, else ``default``."""
    section = F.coalesce(F.nullif("section", F.lit("")), text.first_section(F.col("text")), F.lit(default))
    drug = F.coalesce(F.nullif("drug", F.lit("")), text.name_of_title(F.col("title")))
    chunks = F.filter(F.transform(chunking.windows(F.col("text"), 700, 100), text.strip), lambda x: x != "")
    # the section is told from a whole text before it is cut: beside an explode it would be told again for each chunk
    rows = documents.select("source_id", "source_path", "source_type", "title", section.alias("section"), drug.alias("drug"), "page", chunks.alias("_chunks"))
    rows = chunking.in_rows(rows, "_chunks", "i", "text")
    return rows.select(F.concat_ws("::", "source_id", F.lit("chunk"), F.col("i").cast("string")).alias("chunk_id"), *[c for c in rows.columns if c != "i"])


def read_sheet(spark: SparkSession, paths: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Rows of exported sheets (CSV): each file once, lock files (~$) left out, row ordinals over all files from 1."""
    p, n, _ = _file()
    rows = spark.read.csv(list(dict.fromkeys(paths)), header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.csv")
    rows = rows.withColumnsRenamed({c: c.strip() for c in rows.columns})
    rows = rows.select("*", p.alias("source_file"), n.alias("_name"), F.monotonically_increasing_id().alias("_at")).where("_name not like '~$%'")
    # ordinals: a count per file, its running sum over the few files, and the place inside the file
    inside = rows.withColumn("_r", F.row_number().over(Window.partitionBy("source_file").orderBy("_at")))
    files = inside.groupBy("source_file").count()
    before = files.withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    out = inside.join(names.broadcast_if_small(before), "source_file").withColumn("row", F.col("_r") + F.col("_b")).drop("_r", "_b", "_at", "_name")
    return out.where(F.col("row") <= max_rows) if max_rows else out


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, length) of every file with content, supported or not."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def ingestion_report(listing: DataFrame, documents: DataFrame, chunks: DataFrame, supported: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row: files, skipped, failed (supported, but no document came of it), chunks, and files by type."""
    kind = F.when(F.col("suffix").isin(*supported), F.col("suffix"))
    read = documents.select("source_path").distinct().withColumn("read", F.lit(1))
    rows = listing.withColumn("kind", kind).join(read, F.col("path") == F.col("source_path"), "left")
    totals = rows.agg(F.count("*").alias("files"), F.count(F.when(F.col("kind").isNull(), 1)).alias("skipped"), F.count(F.when(F.col("kind").isNotNull() & F.col("read").isNull(), 1)).alias("failed"))
    by = rows.where("kind is not null and read is not null").groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("by_type"))
    return totals.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # one row each


SAFETY = "INTERACTIONS|CONTRAINDICATIONS|WARNINGS|PRECAUTIONS"


def names_safety(value: Column, words: str = SAFETY) -> Column:
    """Whether a title, or a page, has a safety word in either case."""
    return F.upper(value).rlike(words)


def safety_sections(sections: DataFrame, words: str = SAFETY, limit: int = 8, size: int = 2500) -> DataFrame:
    """The first sections of each document (doc_id, ord, title, content) whose title has a safety word, cut to size."""
    rows = sections.where(names_safety(F.col("title"), words)).withColumn("content", F.substring(text.collapse(F.col("content")), 1, size))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("n") <= limit).drop("n")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)
