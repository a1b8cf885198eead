"""Knowledge records: grouping rows, exact dedupe of section texts, record merges, exports and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import ordinals


def section_rows(rows: DataFrame, titles: dict[str, str], name: str = "name", title: str = "title_text") -> DataFrame:
    """(drug, title, title_order, text, row): non-empty cells of the section columns, one row each.

    ``titles`` maps columns to section titles in order; a row without a name takes its title; rows with neither go.
    """
    drug = F.coalesce(F.nullif(text.normalize_name(F.col(name)), F.lit("")), F.nullif(text.normalize_name(F.col(title)), F.lit("")))
    cells = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(i).alias("title_order"), text.normalize(F.col(c)).alias("text")) for i, (c, t) in enumerate(titles.items())])
    return rows.select(drug.alias("drug"), "row", F.explode(cells).alias("c")).where("drug is not null").select("drug", "c.*", "row")


def deduped_texts(cells: DataFrame, least: int = 4) -> DataFrame:
    """(drug, title, text_hash, text, first_row, rows): equal texts of a section once, in first-seen order of rows."""
    cells = cells.where(F.length("text") >= least).withColumn("text_hash", F.sha1(F.encode("text", "UTF-8")))
    return cells.groupBy("drug", "title", "text_hash").agg(F.min_by("text", "row").alias("text"), F.min("row").alias("first_row"), F.array_sort(F.collect_set("row")).alias("rows"))


def sections(texts: DataFrame) -> DataFrame:
    """(drug, title, texts, content, source_rows, variant_count): numbered content where a section has variants."""
    one = texts.groupBy("drug", "title").agg(F.array_sort(F.collect_list(F.struct("first_row", "text_hash", "text"))).alias("v"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("source_rows"))
    variants = F.transform("v", lambda x: x["text"])
    content = F.when(F.size("v") > 1, F.array_join(F.transform(variants, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).otherwise(F.get(variants, F.lit(0)))
    return one.select("drug", "title", variants.alias("texts"), content.alias("content"), "source_rows", F.size("v").alias("variant_count"))


def section_variants(texts: DataFrame) -> DataFrame:
    """(drug, title, variant_index, variant_count, content): the variants of a section as rows, numbered from 1 in first-seen
    order; the number stands in the content where there are several. A section of any size is spread over ranges, so none is
    ever one row or one task; ``sections`` makes one string of what is known to be small."""
    keyed = texts.withColumn("_key", F.to_json(F.struct("drug", "title")))
    rows = ordinals.numbered(keyed.select("_key", "drug", "title", "first_row", "text_hash", "text"), ["first_row", "text_hash"], "_key", "_n")
    counts = keyed.groupBy("_key").agg(F.count("*").alias("variant_count"))
    rows = rows.join(counts, "_key").withColumn("variant_index", F.col("_n") + 1)
    content = F.when(F.col("variant_count") > 1, F.concat(F.col("variant_index").cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    return rows.select("drug", "title", "variant_index", "variant_count", content.alias("content"))


def section_counts(texts: DataFrame) -> DataFrame:
    """(drug, title, variant_count) of sections, whose texts stay rows."""
    return texts.groupBy("drug", "title").agg(F.count("*").alias("variant_count"))


def aliases(rows: DataFrame, name: str, brand: str, title: str) -> DataFrame:
    """(drug, aliases): brands other than the name, and titles that contain it, sorted."""
    drug, own, long = text.normalize_name(F.col(name)), text.normalize_name(F.col(brand)), text.normalize_name(F.col(title))
    found = F.filter(F.array(F.when((own != "") & (own != drug), own), F.when(long.contains(drug) & (long != drug), long)), lambda x: x.isNotNull())
    return rows.select(drug.alias("drug"), found.alias("a")).where("drug <> ''").groupBy("drug").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("aliases"))


def source_lists(rows: DataFrame, key: str, columns: dict[str, int | None]) -> DataFrame:
    """Sorted distinct non-empty values per key, cut to the stated length after sorting; a column without a limit is whole.

    Values are ranked as rows and cut before they are gathered.
    """
    cell = lambda c: F.struct(F.lit(c).alias("c"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("v"))
    values = rows.select(F.col(key), F.explode(F.array(*map(cell, columns))).alias("x")).select(key, "x.c", "x.v").distinct()
    values = values.withColumn("_n", F.row_number().over(Window.partitionBy(key, "c").orderBy(F.col("v").asc_nulls_last())))
    most = F.create_map(*[F.lit(x) for c, n in columns.items() if n for x in (c, n)]) if any(columns.values()) else None
    if most is not None:
        values = values.where(F.coalesce(F.col("_n") <= F.try_element_at(most, F.col("c")), F.lit(True)))
    return values.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == c, F.col("v")))).alias(c) for c in columns])


def build_report(rows: DataFrame, records: DataFrame, skipped: Column) -> DataFrame:
    """One row of counts over the named rows and the built records(drug, title, variant_count)."""
    read = rows.agg(F.count(F.when(~skipped, 1)).alias("rows_read"), F.count(F.when(skipped, 1)).alias("rows_skipped"))
    built = records.agg(F.count_distinct("drug").alias("records"), F.count("*").alias("sections"), F.coalesce(F.sum("variant_count"), F.lit(0)).alias("variants"))
    return read.crossJoin(F.broadcast(built))  # one row each


def merge_new_wins(old: DataFrame, new: DataFrame, key: Sequence[str] = ("drug", "title")) -> DataFrame:
    """Rows of both tables, one per key: the new one's values at the old one's place; new keys after all old ones of the drug.

    Both have (*key, ord, content).
    """
    rows = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    out = rows.groupBy(*key).agg(F.max_by("content", F.struct("_p", "ord")).alias("content"), F.min(F.struct("_p", "ord")).alias("at"), F.max("_p").alias("from_new"))
    w = Window.partitionBy(key[0]).orderBy("at", *key[1:])
    return out.select(*key, "content", (F.col("from_new") == 1).alias("is_new"), (F.row_number().over(w) - 1).cast("long").alias("position"))


def merge_longer_wins(old: DataFrame, new: DataFrame, key: Sequence[str] = ("drug", "title")) -> DataFrame:
    """One row per key: a new text replaces the old one only if it is strictly longer; the first of equally long ones stays."""
    rows = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    best = F.max_by(F.struct("content", "_p"), F.struct(F.length("content"), -F.col("_p"), -F.col("ord")))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, "b.content", (F.col("b._p") == 1).alias("is_new"))


def merge_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(drug, aliases): those of old, then new ones that it lacks, in order."""
    left = old.select("drug", F.col("aliases").alias("a"))
    return left.join(new.select("drug", F.col("aliases").alias("b")), "drug", "full").select("drug", F.array_distinct(F.concat(F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>")))).alias("aliases"))


def append_source(old: Column, new: Column) -> Column:
    """``old + new`` unless old holds new as a substring."""
    return F.when(old.contains(new), old).otherwise(F.concat(old, F.lit(" + "), new))


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("drug", F.coalesce(F.nullif("drug", F.lit("")), text.name_of_title(F.col("title")))).where("drug <> ''")


def export_heads(chunks: DataFrame) -> DataFrame:
    """(drug, aliases, source, n_sections) of chunks: the first source, then each later one that is not a substring of what is
    there. A path counts where it is first seen, so only the distinct paths of a record are gathered."""
    rows = _named(chunks)
    paths = rows.groupBy("drug", "source_path").agg(F.min("ord").alias("ord"), F.count("*").alias("n")).groupBy("drug")
    heads = paths.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_path"))), lambda x: x["source_path"]).alias("p"), F.sum("n").alias("n_sections"))
    return heads.select("drug", F.array("drug").alias("aliases"), F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0)), append_source).alias("source"), "n_sections")


def export_rows(chunks: DataFrame) -> DataFrame:
    """(drug, position, title, content): the sections of each record as rows, numbered from 0 in chunk order; a record of any
    size is spread over ranges. ``export_records`` nests records that are known to be small."""
    rows = ordinals.numbered(_named(chunks).select("drug", "ord", "section", "text"), ["ord"], "drug", "position")
    return rows.select("drug", "position", F.col("section").alias("title"), F.col("text").alias("content"))


def export_records(chunks: DataFrame) -> DataFrame:
    """(drug, aliases, source, sections) of chunks(ord, drug, title, section, text, source_path), in chunk order."""
    rows = chunks.withColumn("drug", F.coalesce(F.nullif("drug", F.lit("")), text.name_of_title(F.col("title")))).where("drug <> ''")
    item = F.struct("ord", "source_path", "section", "text")
    rows = rows.groupBy("drug").agg(F.array_sort(F.collect_list(item)).alias("c"))
    paths = F.transform("c", lambda x: x["source_path"])
    source = F.aggregate(F.slice(paths, 2, F.size("c")), F.get(paths, F.lit(0)), append_source)
    parts = F.transform("c", lambda x: F.struct(x["section"].alias("title"), x["text"].alias("content")))
    return rows.select("drug", F.array("drug").alias("aliases"), source.alias("source"), parts.alias("sections"))


def rules_of(records: DataFrame) -> DataFrame:
    """(left, right, ord, risk_level, mechanism, recommendation) of records(ord, drug, interactions)."""
    rows = records.select("ord", "drug", F.posexplode("interactions").alias("i", "r"))
    return rows.select(F.col("drug").alias("left"), F.col("r.with").alias("right"), F.struct("ord", "i").alias("ord"), "r.risk_level", "r.mechanism", "r.recommendation")


def names_fingerprint(records: DataFrame) -> DataFrame:
    """One row: a fingerprint of the names of records(ord, drug, aliases) in order, to see whether an index is stale.

    Digests of buckets of rows are digested again, so no row meets all others.
    """
    row = F.sha2(F.to_json(F.struct("drug", F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"))), 256)
    parts = records.select("ord", row.alias("h")).groupBy(F.floor(F.col("ord") / 4096).alias("b")).agg(F.array_sort(F.collect_list(F.struct("ord", "h"))).alias("r"))
    parts = parts.select("b", F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def risk_totals(records: DataFrame) -> DataFrame:
    """One row (records, interactions) of records(interactions array, ...)."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size(F.coalesce("interactions", F.array()))), F.lit(0)).alias("interactions"))
