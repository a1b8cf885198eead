"""Operators on a table of questions: validity, query expansion, evidence scoping and assembly, traces."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms, text
from . import retrieval, risk


def valid(requests: DataFrame, least: int = 2, user: str = "default") -> DataFrame:
    """Requests(message, user_id) of at least ``least`` characters; a missing user is the default one."""
    return requests.where(F.length("message") >= least).withColumn("user_id", F.coalesce(F.nullif("user_id", F.lit("")), F.lit(user)))


def lookup(names: Column, table: Sequence[tuple[str, Sequence[str]]], keep_unknown: bool = True) -> Column:
    """The words of each name in order, duplicates included; a name without an entry stands for itself, or for nothing."""
    known = F.create_map(*[x for name, words in table for x in (F.lit(name), F.array(*map(F.lit, words)))])
    other = (lambda n: F.array(n)) if keep_unknown else (lambda n: F.array().cast("array<string>"))
    return F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(known, n), other(n))))


def evidence_query(message: Column, population: Column, conditions: Column, risks: Column, table=terms.POPULATION_QUERY) -> Column:
    """Message and context terms; words that the message has already count again."""
    return F.trim(F.concat_ws(" ", message, F.array_join(F.concat(F.array_distinct(lookup(population, table)), F.array_sort(F.array_distinct(conditions)), F.array_sort(F.array_distinct(risks))), " ")))


def population_query(message: Column, drugs: Column, population: Column, table=terms.POPULATION_QUERY, titles=terms.POPULATION_TITLES, tail: Sequence[str] = terms.POPULATION_QUERY_TAIL) -> Column:
    """As ``evidence_query`` for a population, each term once."""
    parts = F.concat(F.array(message), drugs, F.array_distinct(lookup(population, table)), lookup(population, titles, False), F.array(*map(F.lit, tail)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ")


def scoped_if_any(evidence: DataFrame, inside: Column) -> DataFrame:
    """Rows of a question that are inside its scope; all of them where none is."""
    w = Window.partitionBy("q")
    rows = evidence.withColumn("_in", F.coalesce(inside, F.lit(False)))
    return rows.withColumn("_any", F.max("_in").over(w)).where("_in or not _any").drop("_in", "_any")


def is_population_evidence(population: Column, body: Column, match=terms.POPULATION_MATCH, titles=terms.POPULATION_TITLES) -> Column:
    """True where section and snippet hold a word or a section title of one of the groups."""
    hits = F.lit(False)
    by_title = dict(titles)
    for name, words in match:
        hits = hits | (F.array_contains(population, name) & text.contains_any(body, [*words, *by_title.get(name, ())]))
    unknown = F.filter(population, lambda g: ~g.isin(*[n for n, _ in match]))
    return hits | F.exists(unknown, lambda g: F.contains(body, g))


def direct_evidence(questions: DataFrame, sections: DataFrame, size: int = 320, **tables) -> DataFrame:
    """(q, ord, drug, section, snippet, score 1.0): sections(ord, drug, section, content) of a question's drugs that are about its population."""
    asked = questions.where("size(population) > 0").select("q", "population", F.explode(F.array_distinct("drugs")).alias("drug"))
    rows = sections.join(asked, "drug").withColumn("snippet", F.substring("content", 1, size))
    rows = rows.where(is_population_evidence(F.col("population"), F.concat_ws(" ", "section", "snippet"), **tables))
    return rows.select("q", "ord", "drug", "section", "snippet", F.lit(1.0).alias("score"))


def first_direct(questions: DataFrame, sections: DataFrame, also: DataFrame, limit: int, key: Sequence[str] = ("source", "drug", "section"), size: int = 320, high=terms.POPULATION_HIGH, medium=terms.POPULATION_MEDIUM, titles=terms.POPULATION_TITLES, match=terms.POPULATION_MATCH) -> DataFrame:
    """(q, ord, *key, snippet, score 1.0): the rows of ``direct_evidence`` that ``assemble`` can show, which is the first
    ``limit`` of each question and drug in its order, and those that a row of ``also(q, *key, snippet)`` repeats.

    Questions of one population see the same rows of a drug: sections meet the pairs of population and drug, not the
    questions, and each snippet counts once a pair before anything is ranked.
    """
    same = F.unhex(F.md5(F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in key], F.trim(text.ordinal_stripped(F.col("snippet"))))))
    asked = questions.where("size(population) > 0").select("q", "population", F.explode(F.array_distinct("drugs")).alias("drug"))
    rows = sections.select("ord", *key, F.substring("content", 1, size).alias("snippet")).join(asked.select("population", "drug").distinct(), "drug")
    matches = is_population_evidence(F.col("population"), F.concat_ws(" ", "section", "snippet"), match, titles)
    rows = rows.where(matches).withColumn("_same", same).withColumn("score", F.lit(1.0))
    w = Window.partitionBy("population", "drug", "_same").orderBy("ord")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    titled = F.array_contains(lookup(F.col("population"), titles, False), F.col("section"))
    order = Window.partitionBy("population", "drug").orderBy(F.desc(retrieval.priority(matches, titled, F.col("snippet"), high, medium)), "ord")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    repeated = also.withColumn("_same", same).join(asked, ["q", "drug"]).select("population", "drug", "_same").distinct()
    kept = first.unionByName(rows.join(repeated, ["population", "drug", "_same"])).dropDuplicates(["population", "drug", "_same"])
    return kept.join(asked, ["population", "drug"]).select("q", "ord", *key, "snippet", "score")


def ordered_union(lists: Sequence[DataFrame], key: Sequence[str], snippet: str) -> DataFrame:
    """Rows of several lists(q, ord, ...), those of earlier lists first, each key once; ord is the new order."""
    rows = None
    for i, part in enumerate(lists):
        part = part.withColumn("_list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("_list", "ord"))).drop("_list")
    return retrieval.first_seen(rows, key, snippet)


def assemble(evidence: DataFrame, population_evidence: DataFrame, questions: DataFrame, concepts: DataFrame | None = None, limit: int = 12, high=terms.POPULATION_HIGH, medium=terms.POPULATION_MEDIUM, titles=terms.POPULATION_TITLES, match=terms.POPULATION_MATCH) -> DataFrame:
    """Population evidence before the rest, once each, by priority where a question has a population, spread over concepts.

    ``evidence(q, ord, source, drug, section, snippet, score)``, ``questions(q, population)``, ``concepts(q, drug, concept)``.
    """
    rows = ordered_union([population_evidence, evidence], ["source", "drug", "section"], "snippet")
    rows = rows.join(questions.select("q", "population"), "q")
    body = F.concat_ws(" ", "section", "snippet")
    titled = F.array_contains(lookup(F.col("population"), titles, False), F.col("section"))
    ranked = retrieval.prioritized(rows, is_population_evidence(F.col("population"), body, match, titles), titled, F.col("snippet"), high, medium)
    with_people = F.size("population") > 0
    plain = rows.select("q", F.col("ord").alias("_o"), F.col("score").alias("_s"))
    ranked = ranked.withColumn("_o", F.col("ord")).join(plain, ["q", "_o"])
    ranked = ranked.withColumns({"ord": F.when(with_people, F.col("position")).otherwise(F.col("_o")), "score": F.when(with_people, F.col("score")).otherwise(F.col("_s"))}).drop("position", "_o", "_s", "population")
    if concepts is not None:
        # of several groups with a shared candidate the last counts
        ranked = ranked.join(concepts.select("q", "drug", "concept"), ["q", "drug"], "left")
        ranked = ranked.withColumn("concept", F.coalesce("concept", "drug"))
    else:
        ranked = ranked.withColumn("concept", F.col("drug"))
    return retrieval.diversified(ranked, "concept", limit)


def concept_of(groups: DataFrame) -> DataFrame:
    """(q, drug, concept) of groups(q, i, concept, candidates): of groups that share a candidate the last counts."""
    rows = groups.select("q", "i", "concept", F.explode("candidates").alias("drug"))
    return rows.groupBy("q", "drug").agg(F.max_by("concept", "i").alias("concept"))


def family_counts(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q, concept, candidates, with_evidence): members of each group that the evidence names."""
    rows = groups.select("q", "concept", F.explode(F.array_distinct("candidates")).alias("drug"))
    named = evidence.select("q", "drug").distinct().withColumn("hit", F.lit(1))
    return rows.join(named, ["q", "drug"], "left").groupBy("q", "concept").agg(F.count("*").alias("candidates"), F.count("hit").alias("with_evidence"))


def consensus(groups: DataFrame, sections: DataFrame, title: str = "药物相互作用", size: int = 2000, high=terms.EVIDENCE_HIGH, medium=terms.EVIDENCE_MEDIUM) -> DataFrame:
    """(q, concept, agreed): every candidate has interaction text, and all texts give one level."""
    texts = sections.where((F.col("section") == title) & (F.coalesce("content", F.lit("")) != "")).select(F.col("drug").alias("q"), F.substring("content", 1, size).alias("snippet"))
    levels = risk.evidence_level(texts.select("q").distinct(), texts, F.col("snippet"), high, medium).select(F.col("q").alias("drug"), "level")
    rows = groups.select("q", "concept", F.explode("candidates").alias("drug")).join(levels, "drug", "left")
    return rows.groupBy("q", "concept").agg((F.bool_and(F.col("level").isNotNull()) & (F.count_distinct("level") == 1)).alias("agreed"))


def without_negated_groups(groups: DataFrame, questions: DataFrame, patterns=terms.NEGATIONS) -> DataFrame:
    """Groups(q, mention, ...) whose first mention does not begin within the reach of a negation that ends before it."""
    rows = groups.join(questions.select("q", text.lookup_name(F.col("message")).alias("_t")), "q")
    name = text.lookup_name(F.col("mention"))
    before = F.when(F.instr("_t", name) > 0, F.substring("_t", F.lit(1), F.instr("_t", name) - 1))
    near = F.lit(False)
    for pattern, reach in patterns:
        near = near | F.coalesce(before.rlike(rf"(?s){pattern}.{{0,{reach}}}$"), F.lit(False))
    return rows.where(~near).drop("_t")


def without_resolved(ambiguous: DataFrame, known: DataFrame) -> DataFrame:
    """Ambiguous(q, mention, normalized, found, ...) whose own resolution ``found`` meets none of known(q, names)."""
    rows = ambiguous.join(known.select("q", F.col("names").alias("_k")), "q", "left")
    return rows.where(~F.coalesce(F.arrays_overlap("found", "_k"), F.lit(False))).drop("_k")


def graph_limit(entities: Column) -> Column:
    return F.least(F.greatest(F.lit(80), 8 * F.size(entities)), F.lit(240))


def asks_graph(ambiguous: Column, concepts: Column) -> Column:
    """False where an ambiguous question has fewer than two concepts: the graph is not asked."""
    return ~(ambiguous & (concepts < 2))


def trace(questions: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """(q, trace array of (node, status, n)) from one table per step, in the order of ``counts``; a step without rows is empty."""
    rows = questions.select("q")
    for node, table in counts.items():
        rows = rows.join(table.groupBy("q").agg(F.count("*").alias(f"_{node}")), "q", "left")
    steps = [F.struct(F.lit(n).alias("node"), F.when(F.coalesce(f"_{n}", F.lit(0)) > 0, "done").otherwise("empty").alias("status"), F.coalesce(f"_{n}", F.lit(0)).alias("n")) for n in counts]
    return rows.select("q", F.array(*steps).alias("trace"))


def health(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, table in tables.items():
        n = table.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(F.broadcast(n))  # one row each
    return out


def embed(rows: DataFrame, value: str, function: Callable[[list[str]], list[list[float]]], batch: int = 16, normalize: bool = True) -> DataFrame:
    """rows with ``vec``: any function from texts to vectors, called with batches of texts on the executors."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        values = texts.fillna("").tolist()
        for i in range(0, len(values), batch):
            out += function(values[i : i + batch])
        if normalize:
            sizes = [np.linalg.norm(v) for v in out]
            out = [np.asarray(v, float) / (n or 1.0) for v, n in zip(out, sizes, strict=True)]
        return pd.Series(out)

    return rows.withColumn("vec", run(F.col(value)))


def source_references(rows: DataFrame, section_rows: DataFrame) -> DataFrame:
    """(drug, title, source_urls): the sorted distinct urls of rows(drug, row, url) that section_rows(drug, title, row) name.

    Both are long tables, joined by row; only distinct urls of a section are gathered.
    """
    wanted = section_rows.select("drug", "title", "row")
    urls = wanted.join(rows.where("coalesce(url, '') <> ''"), ["drug", "row"]).select("drug", "title", "url").distinct()
    urls = urls.groupBy("drug", "title").agg(F.array_sort(F.collect_list("url")).alias("source_urls"))
    sections = wanted.select("drug", "title").distinct()
    return sections.join(urls, ["drug", "title"], "left").withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))
