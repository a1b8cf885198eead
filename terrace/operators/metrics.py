"""Rolling service metrics over the last events, and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_events(events: DataFrame, n: int = 300, order: str = "created_at", tie: str = "id", by: str | None = None) -> DataFrame:
    """The newest n rows, of the whole table or of each group; position 1 is the newest."""
    if by is None:
        rows = events.orderBy(F.desc(order), F.desc(tie)).limit(n)  # n rows: a top-n per task, then of those
        return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc(order), F.desc(tie))))
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return events.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def snapshot(events: DataFrame, by: str | None = None) -> DataFrame:
    """Count, means, p95, rates and risk distribution of (at most a few hundred) events.

    p95 is the sorted element min(n - 1, int(0.95 n)), which no SQL quantile gives. No events give zeros.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sorted_ = F.array_sort(F.collect_list("latency_ms"))
    index = F.least(F.size(sorted_) - 1, F.floor(F.size(sorted_) * 0.95).cast("int"))
    aggs = [
        F.count("*").alias("chat_count"), F.round(zero(F.avg("latency_ms")), 2).alias("avg_latency_ms"), F.round(zero(F.get(sorted_, index)), 2).alias("p95_latency_ms"),
        F.round(zero(F.avg("evidence_count")), 2).alias("avg_evidence_count"), F.round(zero(F.avg("kg_relation_count")), 2).alias("avg_kg_relation_count"),
        F.round(zero(F.avg(F.col("fallback_used").cast("int"))), 4).alias("fallback_rate"), F.round(zero(F.avg(F.col("downgraded").cast("int"))), 4).alias("downgrade_rate"),
    ]
    counts = events.groupBy(*([by] if by else []), "risk_level").count()
    spread = F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_level", "count"))))
    if by is None:
        return events.agg(*aggs).crossJoin(F.broadcast(counts.agg(spread.alias("risk_distribution"))))  # one row each
    return events.groupBy(by).agg(*aggs).join(counts.groupBy(by).agg(spread.alias("risk_distribution")), by)


def evidence_hit(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, evidence_hit): any expected term in any row, and any row of a drug of the case, if it has drugs."""
    rows = cases.join(evidence, "case_id", "left").withColumn("_t", F.concat_ws(" ", "drug", "section", "snippet"))
    term = F.bool_or(F.exists("expected_terms", lambda t: F.col("_t").contains(t)))
    mine = F.bool_or((F.size("drugs") == 0) | F.array_contains("drugs", F.col("drug")))
    return rows.groupBy("case_id").agg(F.coalesce(term & mine, F.lit(False)).alias("evidence_hit"))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Rates per variant and per (variant, group); group is null for the variant's total."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    correct = rate(F.col("predicted") == F.col("expected")).alias("accuracy")
    cols = [F.count("*").alias("total_cases"), correct, rate(F.col("evidence_hit")).alias("evidence_hit_rate"), rate(F.col("predicted") == "Unknown").alias("unknown_rate"), rate(F.col("fallback_used")).alias("fallback_rate")]
    return rows.groupingSets([["variant"], ["variant", "group"]], "variant", "group").agg(*cols)


def risk_distribution(rows: DataFrame, levels=("High", "Medium", "Low", "Unknown")) -> DataFrame:
    return rows.groupBy("variant").pivot("predicted", list(levels)).count().na.fill(0)
