"""Graph construction and query on two tables: nodes(label, name, ...) and edges(s_label, s_name, rel, o_label, o_name, ...)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms, text
from . import names as names_

LABELS = ("Drug", "DrugClass", "Condition", "Population", "Risk", "Scenario")
RELATIONS = ("INTERACTS_WITH", "CONTRAINDICATED_FOR", "USE_WITH_CAUTION_IN")


def level_of_text(value: Column, high: Sequence[str] = terms.SECTION_HIGH, medium: Sequence[str] = terms.SECTION_MEDIUM) -> Column:
    return F.when(text.contains_any(value, high), "High").when(text.contains_any(value, medium), "Medium").otherwise("Low")


def relation_of(section: Column, value: Column, interaction: str = "药物相互作用", high=terms.SECTION_HIGH, medium=terms.SECTION_MEDIUM, action=terms.ACTION_WORDS, idle=terms.NON_ACTIONABLE) -> Column:
    """The relation a sentence of a section states, or null."""
    nothing = ~text.contains_any(value, [*high, *action]) & text.contains_any(value, idle)
    return F.when(nothing, F.lit(None)).when(section == interaction, "INTERACTS_WITH").when(text.contains_any(value, high), "CONTRAINDICATED_FOR").when(text.contains_any(value, medium), "USE_WITH_CAUTION_IN")


def _firsts(b: pa.RecordBatch) -> pa.RecordBatch:
    """Sentences of a batch that have objects: of those with equal beginnings and objects the first, so that copies stay where they are."""
    s, names = b.column("_s"), b.column("canonicals")
    tags = s.field("_tags")
    some = np.flatnonzero((pc.list_value_length(names).to_numpy(zero_copy_only=False) > 0) | (pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False) > 0))
    b = b.take(pa.array(some))
    s = b.column("_s")
    tags = s.field("_tags")
    listed = {"_names": b.column("canonicals")} | {c: pa.ListArray.from_arrays(tags.offsets, tags.values.field(c)) for c in ("object", "object_type")}
    same = {c: s.field(c) for c in ("_head", "subject", "relation", "section")} | {c: pc.binary_join(x, "\0") for c, x in listed.items()}
    codes = {c: x.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c, x in same.items()}
    order = pc.sort_indices(pa.table(codes | {"ord": s.field("ord"), "_i": s.field("_i")}), [(c, "ascending") for c in (*codes, "ord", "_i")], null_placement="at_start").to_numpy()
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in codes.values():
        new[1:] |= np.diff(x[order]) != 0
    return b.take(pa.array(np.sort(order[new])))


def candidates(
    sections: DataFrame, names: DataFrame, interaction: str = "药物相互作用", safety: Sequence[str] = terms.SAFETY_SECTIONS, split=text.sentences,
    classes=terms.DRUG_CLASSES, tables=(("Population", terms.POPULATION_TAGS), ("Condition", terms.CONDITION_TAGS), ("Risk", terms.RISK_EVENTS)), shown: int = 600, opening: bool = False, **words,
) -> DataFrame:
    """(subject, relation, object, object_type, risk_level, evidence_text, section, confidence) of sections(ord, drug, title, text).

    Interaction sentences point at the names (name, canonical) and classes they mention; others at tagged objects. Of
    equal (subject, relation, object, section, first 80 characters) the first counts. ``evidence_text`` has the first
    ``shown`` characters of the sentence. With ``opening`` only candidates of first sentences are given.
    """
    # outer explodes: for plain ones Spark splits each text, and looks for each tag, a second time to ask for the array's size
    rows = sections.where(F.col("title").isin(*safety)).select("ord", F.col("drug").alias("subject"), F.col("title").alias("section"), F.posexplode_outer(split(F.col("text"))).alias("_i", "sentence")).where("sentence is not null")
    rows = rows.withColumn("relation", relation_of(F.col("section"), F.col("sentence"), interaction, **words)).where("relation is not null")
    level = level_of_text(F.col("sentence"), words.get("high", terms.SECTION_HIGH), words.get("medium", terms.SECTION_MEDIUM))
    # what a candidate keeps of its sentence goes with its objects; sentences are neither joined nor shuffled
    head = F.unhex(F.md5(F.substring("sentence", 1, 80)))
    about = F.col("section") == interaction
    tagged = lambda table, kind, i: F.transform(text.tags(F.col("sentence"), table), lambda x: F.struct(x.alias("object"), F.lit(kind).alias("object_type"), F.lit(i).alias("_t")))
    none = F.array().cast("array<struct<object string, object_type string, _t int>>")
    other = F.concat(none, *[tagged(table, kind, i) for i, (kind, table) in enumerate(tables)])
    tags = F.when(about, tagged(classes, "DrugClass", 0)).otherwise(other)
    kept = F.struct("ord", "_i", "subject", "section", "relation", level.alias("risk_level"), F.substring("sentence", 1, shown).alias("evidence_text"), head.alias("_head"), tags.alias("_tags"))
    rows = names_.canonicals(rows.select(kept.alias("_s"), F.when(about, F.col("sentence")).alias("_said")), names, "_s", "_said", _firsts)
    # one row a sentence is dealt out; objects, of which a sentence can have many, part where equal beginnings have met
    same = ["subject", "relation", "section", "_head"]
    rows = rows.select("_s.*", "canonicals").repartition(*same)
    if opening:
        # beginnings that no first sentence has can neither be nor take the place of a candidate of one
        rows = rows.withColumn("_least", F.min("_i").over(Window.partitionBy("_head", *same[:-1]))).where("_least = 0")
    objects = F.concat(F.transform("canonicals", lambda x: F.struct(x.alias("object"), F.lit("Drug").alias("object_type"), F.lit(0).alias("_t"))), "_tags")
    out = rows.select("ord", "_i", *same, "risk_level", "evidence_text", F.explode_outer(objects).alias("_o")).where("_o is not null")
    out = out.select("*", "_o.*").drop("_o").where("object <> subject")
    # a name that is a class as well is a class; the hash comes first because rows are sorted, and those of a subject are many
    same = [*same, "object"]
    w = Window.partitionBy(F.xxhash64(*same), *same).orderBy("ord", "_i", "_t", F.desc("object_type"))
    out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1 and _i = 0" if opening else "_n = 1")
    confidence = F.when(F.col("object_type") == "Drug", 0.72).when(F.col("object_type") == "DrugClass", 0.62).otherwise(0.68)
    return out.select("ord", "_i", "subject", "relation", "object", "object_type", "risk_level", "evidence_text", "section", confidence.alias("confidence"))


def valid(rows: DataFrame, least: float = 0.0, relations: Sequence[str] = RELATIONS, types: Sequence[str] = LABELS) -> DataFrame:
    return rows.where(F.col("relation").isin(*relations) & F.col("object_type").isin(*types) & (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != "") & (F.coalesce("confidence", F.lit(0.0)) >= least))


def upsert_edges(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One edge per (subject, relation, object_type, object): the last candidate's attributes, weight by its level."""
    rest = [c for c in ("risk_level", "evidence_text", "section", "confidence") if c in rows.columns]
    last = rows.groupBy("subject", "relation", "object_type", "object").agg(F.max_by(F.struct(*rest), order).alias("a"), F.count("*").alias("n_candidates"))
    weight = F.when(F.col("a.risk_level") == "High", 1.3).when(F.col("a.risk_level") == "Medium", 1.1).otherwise(0.8)
    return last.select(F.lit("Drug").alias("s_label"), F.col("subject").alias("s_name"), F.col("relation").alias("rel"), F.col("object_type").alias("o_label"), F.col("object").alias("o_name"), weight.alias("weight"), *[F.col(f"a.{c}").alias(c) for c in rest], "n_candidates")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("s_label").alias("label"), F.col("s_name").alias("name")).union(edges.select("o_label", "o_name")).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges); zeros without edges."""
    n = nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    return n.select(F.when(F.col("edges") > 0, F.col("nodes")).otherwise(0).cast("long").alias("nodes"), "edges")


def rule_edges(rules: DataFrame) -> DataFrame:
    """Edges of pair rules(left, right, risk_level, ...): between the drugs by level, and from the left one to its risk."""
    level = F.col("risk_level")
    pair = rules.where("coalesce(right, '') <> ''").select(
        F.lit("Drug").alias("s_label"), F.col("left").alias("s_name"), F.when(level == "High", "CONTRAINDICATED_WITH").otherwise("INTERACTS_WITH").alias("rel"),
        F.lit("Drug").alias("o_label"), F.col("right").alias("o_name"), F.when(level == "High", 1.3).when(level == "Medium", 1.1).otherwise(0.9).alias("weight"), "risk_level",
    )
    risk = pair.select("s_label", "s_name", F.lit("MAY_CAUSE").alias("rel"), F.lit("Risk").alias("o_label"), F.coalesce("risk_level", F.lit("Unknown")).alias("o_name"), F.lit(0.8).alias("weight"), F.lit(None).cast("string").alias("risk_level"))
    return pair.union(risk).dropDuplicates(["s_label", "s_name", "rel", "o_label", "o_name"])


def static_edges(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Edges of a rule table(s_label, s_name, rel, o_label, o_name) with the weight of their type."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return rows.withColumn("weight", weight[F.col("rel")])


def neighbours(questions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int, labels: Sequence[str] = LABELS) -> DataFrame:
    """(q, ord, subject, rel, object, ...) of edges that touch a node whose name or alias is one of questions(q, entities).

    Edges come by weight, then names, at most ``limit`` per question. No question shows more edges of a node than that, so
    questions meet the first ``limit`` edges at each end of a node, not all of them. Of repeated edges the heaviest counts.
    """
    key = ["s_label", "s_name", "rel", "o_label", "o_name"]
    weight = F.coalesce("weight", F.lit(1.0))
    order = [weight.desc(), "s_name", "rel", "o_name", "s_label", "o_label"]
    rest = [c for c in edges.columns if c not in key]
    edges = edges.groupBy(*key).agg(F.max_by(F.struct(*rest), weight).alias("_a")).select(*key, *[F.col(f"_a.{c}").alias(c) for c in rest])
    asked = questions.select("q", F.explode(F.array_distinct("entities")).alias("_e")).where("_e <> ''").select("q", F.lower("_e").alias("_e"))
    known = nodes.where(F.col("label").isin(*labels))
    by_name = known.select("label", "name", F.lower("name").alias("_e"))
    if "aliases" in nodes.columns:
        by_name = by_name.union(known.select("label", "name", F.explode("aliases").alias("a")).select("label", "name", F.lower("a"))).distinct()
    start = asked.join(by_name, "_e").select("q", "label", "name").distinct()
    ends = []
    for label, name in (("s_label", "s_name"), ("o_label", "o_name")):
        near = edges.withColumn("_n", F.row_number().over(Window.partitionBy(label, name).orderBy(*order))).where(F.col("_n") <= limit)
        ends.append(near.select(F.col(label).alias("label"), F.col(name).alias("name"), *[F.col(c).alias(f"_{c}") for c in edges.columns]))
    rows = start.join(ends[0].union(ends[1]), ["label", "name"]).select("q", *[F.col(f"_{c}").alias(c) for c in edges.columns])
    # dealt by question once, for both
    rows = rows.repartition("q").dropDuplicates(["q", *key])
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("ord") <= limit)
    return rows.withColumnsRenamed({"s_name": "subject", "o_name": "object"}).withColumn("relation", relabel(F.col("rel")))


def relabel(relation: Column, labels: dict[str, str] = terms.RELATION_LABELS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, relation), F.lower(relation))


def relevant(relations: DataFrame, questions: DataFrame, dropped: str = "supported_by") -> DataFrame:
    """Relations between two drugs of the question, or between one of them and its context (population, conditions, risks)."""
    rows = relations.where(F.col("relation") != dropped).join(questions.select("q", "drugs", "context"), "q")
    mine = lambda c: F.array_contains("drugs", F.col(c))
    about = lambda c: F.array_contains("context", F.col(c))
    return rows.where((mine("subject") & mine("object")) | (mine("subject") & about("object")) | (about("subject") & mine("object"))).drop("drugs", "context")


def drug_graph(records: DataFrame, properties: Sequence[str] = ("aliases",), order: str = "ord", default: str = "local_dataset") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of records(drug, source, ..., ord): a Drug node per name with the last record's properties, a Source
    node per source, and a SUPPORTED_BY edge from each drug to every source that has named it."""
    known = records.where("coalesce(drug, '') <> ''").withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit(default)))
    kept = ("source", *properties)
    last = known.groupBy(F.col("drug").alias("name")).agg(F.max_by(F.struct(*kept), order).alias("p")).select(F.lit("Drug").alias("label"), "name", *[F.col(f"p.{c}").alias(c) for c in kept])
    pairs = known.select("drug", "source").distinct()
    nodes = last.unionByName(pairs.select(F.lit("Source").alias("label"), F.col("source").alias("name")).distinct(), allowMissingColumns=True)
    edges = pairs.select(F.lit("Drug").alias("s_label"), F.col("drug").alias("s_name"), F.lit("SUPPORTED_BY").alias("rel"), F.lit("Source").alias("o_label"), F.col("source").alias("o_name"), F.lit(0.6).alias("weight"))
    return nodes, edges
