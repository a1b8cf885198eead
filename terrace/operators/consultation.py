"""The whole chain of a question: names, retrieval, population retrieval, graph and rules, down to an answer.

All steps are DataFrame plans over a table of questions. Documents are tokenised in one pass for both retrievals of all
questions; the evidence and the graph relations are child tables, written once and read by every later step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms, text
from ..sources import store
from . import kg, names, questions, retrieval, risk

_NAMES = "array<string>"


@dataclass
class Wording:
    """The term lists and the wording that a chain works with; the defaults are the library's."""

    important: Sequence[str] = terms.IMPORTANT_SECTIONS
    risky: Sequence[str] = terms.RERANK_TERMS
    negations: Sequence[tuple[str, int]] = terms.NEGATIONS
    populations: Sequence[tuple[str, str]] = terms.POPULATION_WORDS
    conditions: Sequence[str] = terms.CONDITION_WORDS
    risks: Sequence[str] = terms.RISK_FACTOR_WORDS
    population_query: Sequence = terms.POPULATION_QUERY
    population_titles: Sequence = terms.POPULATION_TITLES
    population_match: Sequence = terms.POPULATION_MATCH
    population_tail: Sequence[str] = terms.POPULATION_QUERY_TAIL
    population_high: Sequence[str] = terms.POPULATION_HIGH
    population_medium: Sequence[str] = terms.POPULATION_MEDIUM
    condition_match: Sequence = terms.CONDITION_MATCH
    condition_high: Sequence[str] = terms.CONDITION_HIGH
    condition_medium: Sequence[str] = terms.CONDITION_MEDIUM
    evidence_high: Sequence[str] = terms.EVIDENCE_HIGH
    evidence_medium: Sequence[str] = terms.EVIDENCE_MEDIUM
    mechanisms: dict[str, str] = field(default_factory=lambda: terms.MECHANISMS)


@dataclass
class Answers:
    """``extracted`` and ``answers`` have a row per question; ``evidence`` and ``relations`` are their child tables."""

    extracted: DataFrame
    evidence: DataFrame
    relations: DataFrame
    answers: DataFrame


def extracted(asked: DataFrame, dictionary: DataFrame, wording: Wording, groups: DataFrame | None = None, ambiguous: DataFrame | None = None, memory: DataFrame | None = None) -> DataFrame:
    """(q, message, drugs, own, concepts, population, conditions, risk_factors, ambiguous array, memory_population,
    memory_conditions) of asked(q, message).

    ``groups(q, i, concept, candidates)`` are names with several candidates, ``ambiguous(q, mention)`` names without any.
    What a turn mentions goes before ``memory(q, drugs, population, conditions)``, the session's state; the memory columns
    have that state with the turn merged in, as flags use it.
    """
    rows = names.context(asked.select("q", "message"), wording.populations, wording.conditions, wording.risks)
    rows = rows.join(names.extract(asked, dictionary, wording.negations).withColumnRenamed("drugs", "own"), "q")
    none = F.array().cast(_NAMES)
    if groups is not None:
        members = groups.groupBy("q").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "candidates"))), lambda g: g["candidates"]))).alias("_c"), F.count("*").alias("_g"))
        rows = rows.join(members, "q", "left")
    else:
        rows = rows.withColumns({"_c": none, "_g": F.lit(0)})
    rows = rows.join(ambiguous.groupBy("q").agg(F.array_sort(F.collect_set("mention")).alias("ambiguous")), "q", "left") if ambiguous is not None else rows.withColumn("ambiguous", none)
    rows = rows.join(memory.select("q", *[F.col(c).alias(f"_m_{c}") for c in ("drugs", "population", "conditions")]), "q", "left") if memory is not None else rows.withColumns({f"_m_{c}": none for c in ("drugs", "population", "conditions")})
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_c", "ambiguous", "_m_drugs", "_m_population", "_m_conditions")}).withColumn("_g", F.coalesce("_g", F.lit(0)))
    now = F.array_distinct(F.concat("own", "_c"))
    signal = (F.size("own") > 0) | (F.col("_g") > 0) | (F.size("ambiguous") > 0)
    people = F.array_sort(F.array_union("population", merged_population(F.col("population"), F.col("_m_population"))))
    return rows.select(
        "q", "message", F.when(signal, now).otherwise(F.array_sort(F.array_union("own", "_m_drugs"))).alias("drugs"), "own", F.when(signal, F.size("own") + F.col("_g")).otherwise(F.size(F.array_union("own", "_m_drugs"))).alias("concepts"),
        (F.size("own") + F.col("_g")).alias("named"), people.alias("population"), F.array_sort(F.array_union("conditions", "_m_conditions")).alias("conditions"), F.array_sort(F.array_distinct("risk_factors")).alias("risk_factors"), "ambiguous",
    )


def merged_population(now: Column, before: Column, older: str = "老年人", younger: str = "儿童") -> Column:
    """The earlier groups that a turn leaves: one that names only the younger drops the older, and the reverse."""
    has = lambda label: F.array_contains(now, label)
    return F.filter(before, lambda x: ~(((x == older) & has(younger) & ~has(older)) | ((x == younger) & has(older) & ~has(younger))))


def evidence_of(asked: DataFrame, docs: DataFrame, wording: Wording, concepts: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """(q, position, ord, source, drug, section, snippet, score, population_hit): both retrievals, in their scopes, assembled.

    ``asked`` is ``extracted``; ``docs(ord, source, drug, section, text, snippet)`` are the passages. Questions with a
    population and names ask a second time with the population's words; both asks run in one retrieval.
    """
    n = F.size("drugs")
    plain = asked.select("q", F.lit(0).alias("kind"), questions.evidence_query(F.col("message"), F.col("population"), F.col("conditions"), F.col("risk_factors"), wording.population_query).alias("asked"), "drugs", F.least(F.greatest(F.lit(8), 2 * n), F.lit(24)).alias("k"))
    of_people = (F.size("population") > 0) & (n > 0)
    people = asked.where(of_people).select("q", F.lit(1).alias("kind"), questions.population_query(F.col("message"), F.col("drugs"), F.col("population"), wording.population_query, wording.population_titles, wording.population_tail).alias("asked"), "drugs", F.lit(limit).alias("k"))
    asks = store.written(plain.union(people).withColumnRenamed("q", "_q").withColumn("q", F.concat_ws(":", F.col("_q").cast("string"), F.col("kind").cast("string"))), "asks")
    found = retrieval.hybrid(docs, asks.select("q", "asked", "drugs", "k"), F.col("k"), 24, wording.important, wording.risky)
    found = store.written(found.join(asks.select("q", "_q", "kind", "drugs"), "q").drop("q").withColumnRenamed("_q", "q"), "found")
    mine = F.array_contains("drugs", F.col("drug"))
    columns = ["q", "ord", "source", "drug", "section", "snippet", "score"]
    general = questions.scoped_if_any(found.where("kind = 0"), mine).drop("ord").withColumnRenamed("rank", "ord").select(*columns)
    context = asked.select("q", "population")
    about = questions.is_population_evidence(F.col("population"), F.concat_ws(" ", "section", "snippet"), wording.population_match, wording.population_titles)
    retrieved = found.where("kind = 1").where(mine).join(context, "q").where(about).drop("ord").withColumnRenamed("rank", "ord").select(*columns)
    sections = docs.select("ord", "source", "drug", "section", F.col("snippet").alias("content"))
    direct = questions.first_direct(asked.where(of_people), sections, retrieved, limit, high=wording.population_high, medium=wording.population_medium, titles=wording.population_titles, match=wording.population_match).select(*columns)
    special = questions.assemble(retrieved, direct, context, concepts, limit, wording.population_high, wording.population_medium, wording.population_titles, wording.population_match)
    special = special.drop("ord").withColumnRenamed("position", "ord").select(*columns)
    out = questions.assemble(general, special, context, concepts, limit, wording.population_high, wording.population_medium, wording.population_titles, wording.population_match)
    return out.select("q", F.col("position").cast("long").alias("position"), "source", "drug", "section", "snippet", "score")


def relations_of(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, ord, subject, relation, object, risk_level, ...): what the graph says about a question's names and context."""
    asks = asked.where(~((F.size("ambiguous") > 0) & (F.size("drugs") < 2)))
    near = kg.neighbours(asks.select("q", F.col("drugs").alias("entities")), nodes, edges, 240)
    limit = asked.select("q", questions.graph_limit(F.col("drugs")).alias("_most"))
    near = near.join(limit, "q").where("ord <= _most").drop("_most")
    context = asked.select("q", "drugs", F.concat("population", "conditions", "risk_factors").alias("context"))
    return kg.relevant(near, context)


def answers_of(asked: DataFrame, evidence: DataFrame, relations: DataFrame, rules: DataFrame, wording: Wording, groups: DataFrame | None = None) -> DataFrame:
    """One row per question: level, mechanism, pair, confidence, conclusion, recommendation, flags, trace and answer.

    ``rules(left, right, risk_level, mechanism, recommendation, ord)``; ``evidence`` and ``relations`` are written tables.
    """
    say = wording.mechanisms
    singles = asked.select("q", F.posexplode("drugs").alias("i", "name"))
    if groups is not None:
        members = groups.select("q", F.explode("candidates").alias("name")).distinct()
        singles = singles.join(members, ["q", "name"], "left_anti")
        concepts = singles.select("q", "i", F.array("name").alias("candidates")).union(groups.select("q", (F.col("i") + 1_000_000).alias("i"), "candidates"))
    else:
        concepts = singles.select("q", "i", F.array("name").alias("candidates"))
    pair = risk.first_pair_across(concepts, risk.last_rules(rules)).select("q", "left", "right", F.coalesce("risk_level", F.lit(risk.MEDIUM)).alias("pair_level"), F.coalesce("mechanism", F.lit(say["pair"])).alias("pair_mechanism"), F.col("recommendation").alias("pair_text"))
    base = risk.evidence_level(asked.select("q"), evidence, F.col("snippet"), wording.evidence_high, wording.evidence_medium).select("q", F.col("level").alias("words"), "n_evidence")
    people = risk.population_signal(asked, evidence, wording.population_match, wording.population_high, wording.population_medium).select("q", F.col("level").alias("people"), "groups")
    near = risk.condition_signal(asked, evidence, wording.condition_match, wording.condition_high, wording.condition_medium).select("q", F.col("level").alias("near"), F.col("conditions").alias("near_conditions"))
    graph = risk.graph_signal(relations).select("q", F.col("level").alias("graph"), F.struct("subject", "relation", "object").alias("edge"))
    counted = relations.groupBy("q").agg(F.count("*").alias("n_relations"), F.min_by(F.struct("subject", "relation", "object"), "ord").alias("first_edge"))
    shown = evidence.where("position = 1").select("q", F.struct("drug", "section", "snippet").alias("first_evidence"))
    rows = asked
    for part in (pair, base, people, near, graph, counted, shown):
        rows = rows.join(part, "q", "left")
    if groups is not None:
        families = risk.family_flags(questions.family_counts(groups, evidence)).join(groups.select("q", F.col("concept"), "i"), "q").groupBy("q")
        rows = rows.join(families.agg(F.array_sort(F.collect_set("message")).alias("_families")), "q", "left")
    else:
        rows = rows.withColumn("_families", F.lit(None).cast(_NAMES))
    rows = rows.withColumns({"n_relations": F.coalesce("n_relations", F.lit(0)), "_pair": F.col("left").isNotNull(), "_amb": F.size("ambiguous") > 0})
    # without two concepts no pair rule is asked
    rows = rows.withColumn("_pair", F.col("_pair") & (F.col("concepts") >= 2))
    # a question without names has no base level of its own
    named = F.when(F.size("drugs") == 0, risk.UNKNOWN).when(F.col("_pair"), F.col("pair_level")).otherwise(F.col("words"))
    few = F.col("concepts") < 2
    with_names = lambda c: F.when(F.size("drugs") > 0, F.col(c))
    level = risk.combined(F.col("concepts"), F.col("_amb"), F.col("n_evidence"), F.col("_pair"), named, F.when(few, with_names("people")).otherwise(F.col("people")), F.when(few, with_names("near")).otherwise(F.col("near")), F.col("graph"))
    rows = rows.withColumn("level", level)
    said = lambda c, high: risk.filled(say[high], names=F.array_join(c, "、"))
    of_people = F.when(F.col("people") == risk.HIGH, said("groups", "population_high")).when(F.col("people").isNotNull(), said("groups", "population_medium"))
    of_conditions = F.when(F.col("near").isNotNull(), said("near_conditions", "condition"))
    of_graph = F.when(F.col("graph").isNotNull(), risk.filled(say["graph"], subject=F.col("edge.subject"), relation=F.col("edge.relation"), object=F.col("edge.object")))
    rows = rows.withColumns({"_people": of_people, "_near": of_conditions, "_graph": of_graph})
    by_words = F.when(F.col("n_evidence") == 0, say["no_evidence"]).when(F.col("words") == risk.HIGH, say["High"]).when(F.col("words") == risk.MEDIUM, say["Medium"]).otherwise(say["Low"])
    with_text = F.when(F.contains("pair_mechanism", F.coalesce("pair_text", F.lit(""))), F.col("pair_mechanism")).otherwise(F.concat_ws(" ", "pair_mechanism", "pair_text"))
    first = F.when(F.size("drugs") == 0, say["no_names"]).when(F.col("_pair"), with_text).otherwise(by_words)
    mechanism = first
    for part in ("_people", "_near", "_graph"):
        mechanism = F.when(F.col(part).isNotNull() & ~F.contains(mechanism, F.col(part)), F.concat(mechanism, F.lit(say["also"]), F.col(part))).otherwise(mechanism)
    alone = F.coalesce(with_names("_people"), with_names("_near"), F.lit(say["few"]))
    nothing = (F.col("n_evidence") == 0) & ~F.col("_pair") & F.col("graph").isNull()
    rows = rows.withColumn("mechanism", F.when(F.col("_amb") & few, say["ambiguous"]).when(few, alone).when(nothing, say["nothing"]).otherwise(mechanism))
    rows = rows.withColumns({
        "recommendation": F.when(F.col("_pair"), F.coalesce("pair_text", F.lit(say["pair_advice"]))).otherwise(risk.recommendation(F.col("level"), F.lit(None).cast("string"), F.size("drugs") > 0)),
        "confidence": risk.confidence(F.col("level"), F.col("_pair"), F.col("n_evidence"), F.col("n_relations")),
        "conclusion": risk.conclusion(F.col("level"), F.when(F.col("_pair"), F.col("left")), F.col("right")),
    })
    codes = risk.safety_flags(F.col("level"), F.col("n_evidence"), F.col("named"), F.col("_amb"), F.col("people"), F.col("near"))
    listed = F.array_join("ambiguous", "、")
    message = lambda f: risk.flag_message(f["code"], listed, F.col("level"), F.col("named"), F.when(f["code"] == "population", F.col("_people")).otherwise(F.col("_near")))
    flags = F.transform(codes, lambda f: F.struct(f["level"].alias("level"), f["code"].alias("code"), message(f).alias("message")))
    family = F.transform(F.coalesce("_families", F.array().cast(_NAMES)), lambda m: F.struct(F.lit("info").alias("level"), F.lit("family").alias("code"), m.alias("message")))
    # families come after ambiguous names, before all others
    rows = rows.withColumn("flags", F.concat(F.filter(flags, lambda f: f["code"] == "ambiguous_names"), family, F.filter(flags, lambda f: f["code"] != "ambiguous_names")))
    step = lambda node, n: F.struct(F.lit(node).alias("node"), F.lit("completed").alias("status"), n.cast("long").alias("n"))
    trace = F.array(step("extract_entities", F.col("named")), step("retrieve_evidence", F.col("n_evidence")), step("query_kg", F.col("n_relations")), step("assess_risk", F.size("flags")), step("prepare_answer", F.lit(1)))
    return rows.select("q", "drugs", "concepts", "level", "mechanism", "confidence", "conclusion", "recommendation", "flags", risk.downgraded(F.col("level"), F.col("flags")).alias("downgraded"), "n_evidence", "n_relations", trace.alias("trace"), risk.answer_text().alias("answer"))


def consult(asked: DataFrame, dictionary: DataFrame, docs: DataFrame, rules: DataFrame, nodes: DataFrame, edges: DataFrame, wording: Wording | None = None, groups: DataFrame | None = None, ambiguous: DataFrame | None = None, memory: DataFrame | None = None) -> Answers:
    """The chain over asked(q, message): one answer each, with its evidence and relations."""
    wording = wording or Wording()
    context = store.written(extracted(asked, dictionary, wording, groups, ambiguous, memory), "extracted")
    evidence = store.written(evidence_of(context, docs, wording, questions.concept_of(groups) if groups is not None else None), "evidence")
    relations = store.written(relations_of(context, nodes, edges), "relations")
    return Answers(context, evidence, relations, answers_of(context, evidence, relations, rules, wording, groups))


def analyze(asked: DataFrame, dictionary: DataFrame, docs: DataFrame, rules: DataFrame, wording: Wording | None = None, k: int = 8) -> DataFrame:
    """(q, drugs, level, conclusion, recommendation, confidence, limitations, n_evidence): the shorter chain of a single
    question over TF-IDF evidence and pair rules, without a graph."""
    wording = wording or Wording()
    found = names.extract(asked, dictionary, wording.negations)
    rows = asked.select("q", "message").join(found, "q")
    scored = retrieval.boosted(retrieval.tfidf(docs, rows, F.col("text"), F.col("message")), docs, rows, k, wording.important, 0.2, 0.25)
    evidence = retrieval.top_k(scored, k).join(docs.select("ord", "snippet"), "ord").select("q", "snippet")
    words = risk.evidence_level(rows.select("q"), evidence, F.col("snippet"), wording.evidence_high, wording.evidence_medium)
    pair = risk.first_pair(rows, risk.last_rules(rules)).select("q", "left", "right", F.coalesce("risk_level", F.lit(risk.MEDIUM)).alias("pair_level"), F.col("recommendation").alias("pair_text"))
    rows = rows.join(words, "q").join(pair, "q", "left")
    hit = F.col("left").isNotNull()
    rows = rows.withColumn("level", F.when(F.size("drugs") == 0, risk.UNKNOWN).when(hit, F.col("pair_level")).otherwise(F.col("level")))
    return rows.select("q", "drugs", "level", *risk.report(F.col("level"), F.col("left"), F.col("right"), F.col("pair_text"), F.col("n_evidence")), risk.limitations(F.size("drugs"), F.col("n_evidence"), F.col("message")).alias("limitations"), "n_evidence")
