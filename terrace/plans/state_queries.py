"""Registered queries of sessions, metrics, evaluation, ingestion and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import kg, metrics, sessions
from ..sources import store
from ..streaming import streams
from . import graph_queries as gq
from . import retrieval_queries as rq
from .common import HIGH, MEDIUM, questions, sql_any, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DRUGS, _CONDITIONS, _RISKS = ("tion", "lich", "elle", "ado"), ("the", "ein", "que"), ("er", "es")


def turns(spark, sf_dir):
    """Conversation turns with the words they mention; long messages stand for older, messages with u for younger people."""
    rows = table(spark, sf_dir, "conversations")
    body = F.col("text")
    people = F.filter(F.array(F.when(F.length("text") % 3 == 0, "older"), F.when(F.length("text") % 5 == 0, "younger"), F.when(body.contains("ö"), "other")), lambda x: x.isNotNull())
    return rows.select(F.col("conv_id").alias("session_id"), "turn", F.md5("text").alias("message"), text.present(body, _DRUGS).alias("drugs"), people.alias("population"), text.present(body, _CONDITIONS).alias("conditions"), text.present(body, _RISKS).alias("risk_factors"))


def _sql_set(words) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN bool_or(contains(text, '{w}')) OVER w THEN '{w}' END" for w in sorted(words)) + ")"


_SQL_STATES = f"""WITH t AS (SELECT conv_id AS session_id, turn, text, length(text) % 3 = 0 AS older, length(text) % 5 = 0 AS younger, contains(text, 'ö') AS other FROM conversations),
    s AS (SELECT session_id, turn, md5(text) AS last_question, {_sql_set(_DRUGS)} AS drugs, {_sql_set(_CONDITIONS)} AS conditions, {_sql_set(_RISKS)} AS risk_factors,
        coalesce(max(CASE WHEN older THEN turn END) OVER w, -1) > coalesce(max(CASE WHEN younger AND NOT older THEN turn END) OVER w, -1) AS ko,
        coalesce(max(CASE WHEN younger THEN turn END) OVER w, -1) > coalesce(max(CASE WHEN older AND NOT younger THEN turn END) OVER w, -1) AS ky, bool_or(other) OVER w AS kx
        FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    z AS (SELECT session_id, turn, drugs, conditions, risk_factors, last_question, concat_ws('|', CASE WHEN ko THEN 'older' END, CASE WHEN kx THEN 'other' END, CASE WHEN ky THEN 'younger' END) AS population FROM s)"""


def _states(spark, sf_dir):
    return sessions.snapshots(turns(spark, sf_dir), "older", "younger")


@query(f"{_SQL_STATES} SELECT session_id, turn, drugs, population, conditions, risk_factors, last_question FROM z")
def session_snapshot(spark: SparkSession, sf_dir: str):
    lists = ("drugs", "population", "conditions", "risk_factors")
    return _states(spark, sf_dir).select("session_id", "turn", *[F.array_join(c, "|").alias(c) for c in lists], "last_question")


def _sql_new(words, kind: str) -> str:
    return " UNION ALL ".join(f"SELECT conv_id AS session_id, min(turn) AS turn, '{kind}' AS event_type, '{w}' AS name FROM conversations WHERE contains(text, '{w}') GROUP BY conv_id" for w in words)


@query(f"WITH u AS ({_sql_new(_DRUGS, 'medication_mentioned')} UNION ALL {_sql_new(_CONDITIONS, 'condition_mentioned')}) SELECT session_id, turn, event_type, name, CAST(row_number() OVER (PARTITION BY session_id, turn ORDER BY event_type DESC, name) - 1 AS INTEGER) AS position FROM u")
def session_updates(spark, sf_dir):
    return sessions.memory_updates(_states(spark, sf_dir)).select("session_id", "turn", "event_type", "name", "position")


def _messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), F.concat(F.lit("user"), (F.col("conv_id") % 5).cast("string")).alias("user_id"), F.col("text").alias("message"),
        F.when(F.length("text") % 2 == 0, "High").otherwise("Low").alias("risk_level"), F.md5("text").alias("conclusion"), F.col("turn").alias("created_at"),
    )


@query("""SELECT conv_id AS session_id, arg_max(CASE WHEN length(text) % 2 = 0 THEN 'High' ELSE 'Low' END, turn) AS risk_level, arg_max(md5(text), turn) AS conclusion, count(*) AS n_messages FROM conversations GROUP BY conv_id""")
def session_latest(spark, sf_dir):
    return sessions.latest(_messages(spark, sf_dir), "session_id", ["created_at", "id"], ["risk_level", "conclusion"])


@query("""SELECT conv_id AS session_id, substr(arg_min(text, turn), 1, 32) AS title, arg_max(CASE WHEN length(text) % 2 = 0 THEN 'High' ELSE 'Low' END, turn) AS risk_level, max(turn) AS updated_at, count(*) AS n_messages
    FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, session_id DESC LIMIT 30""")
def session_list(spark, sf_dir):
    """A list of at most 30 sessions, newest first: the limit is the operator."""
    rows = sessions.newest(sessions.session_rows(_messages(spark, sf_dir)), 30)
    return rows.select("session_id", "title", "risk_level", "updated_at", "n_messages")


@query("""SELECT conv_id AS session_id, turn AS id, md5(text) AS conclusion, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""")
def session_detail(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    owned = rows.select("session_id", "user_id").distinct()
    out = sessions.session_detail(owned, rows.drop("user_id"), F.concat(F.lit("user"), (F.col("session_id") % 5).cast("string")))
    return out.select("session_id", "id", "conclusion", F.col("position").cast("long").alias("position"))


@query("""SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE NOT (conv_id % 5 = 1 AND conv_id % 3 = 0) GROUP BY conv_id""")
def session_delete(spark, sf_dir):
    """Messages left after user1 deletes every third session; others' sessions in the request stay."""
    rows = _messages(spark, sf_dir)
    owned = rows.select("session_id", "user_id").distinct()
    doomed = owned.where("session_id % 3 = 0").select("session_id", F.lit("user1").alias("user_id"))
    _, left = sessions.without_sessions(owned, rows, doomed)
    return left.groupBy("session_id").agg(F.count("*").alias("n"))


# --- versioned tables --------------------------------------------------------------------------------

_SQL_LEFT = "conv_id % 5 = 1 AND conv_id % 3 = 0"


def _history(spark, sf_dir):
    """Messages appended in two writes, the first of them twice; every third session deleted by user1, who owns a fifth."""
    rows = _messages(spark, sf_dir).join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role"), ["session_id", "id"])
    held = sessions.message_table(spark, store.fresh(spark, "messages"))
    asked, said = rows.where("role = 'user'"), rows.where("role <> 'user'")
    held.append(asked, "asked")
    held.append(said, "said")
    held.append(asked, "asked")
    doomed = rows.where("session_id % 3 = 0").select("session_id", F.lit("user1").alias("user_id"))
    held.delete(doomed, "deleted")
    held.delete(doomed, "deleted")
    return held


@query(f"SELECT conv_id AS session_id, turn AS id, 'user' || (conv_id % 5) AS user_id, md5(text) AS conclusion FROM conversations WHERE NOT ({_SQL_LEFT})")
def history_rows(spark, sf_dir):
    """What is left after appends, a repeated append and deletes by an owner and by others."""
    return _history(spark, sf_dir).read().select("session_id", "id", "user_id", "conclusion")


@query(f"""SELECT 1 AS version, 'asked' AS token, count(*) FILTER (role = 'user') AS n FROM conversations UNION ALL SELECT 2, 'said', count(*) FROM conversations
    UNION ALL SELECT 3, 'deleted', count(*) FILTER (NOT ({_SQL_LEFT})) FROM conversations UNION ALL SELECT 4, 'compacted', count(*) FILTER (NOT ({_SQL_LEFT})) FROM conversations UNION ALL SELECT 5, 'reset', 0""")
def history_versions(spark, sf_dir):
    """Every version of the table can be read: what each write left."""
    held = _history(spark, sf_dir)
    held.compact("compacted")
    held.reset("reset")
    out = None
    for version in range(1, held.version() + 1):
        part = held.read(version).agg(F.count("*").alias("n")).withColumn("version", F.lit(version))
        out = part if out is None else out.unionByName(part)
    return out.join(held.versions().withColumn("version", F.col("version").cast("int")), "version").select("version", "token", "n")


# --- metrics -----------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.coalesce("value", F.lit(0.0)).alias("latency_ms"), F.col("event_type").alias("risk_level"), "event_type",
        (F.col("user_id") % 9).cast("int").alias("evidence_count"), (F.col("user_id") % 4).cast("int").alias("kg_relation_count"), (F.col("event_type") == "error").alias("fallback_used"), (F.col("user_id") % 7 == 0).alias("downgraded"),
    )


def _sql_metrics(group: str, source: str) -> str:
    by = f"{group}, " if group else ""
    return f"""SELECT {by}count(*) AS chat_count, round(avg(v), 2) AS avg_latency_ms, round(list_sort(list(v))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1], 2) AS p95_latency_ms,
        round(avg(user_id % 9), 2) AS avg_evidence_count, round(avg(user_id % 4), 2) AS avg_kg_relation_count, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 4) AS fallback_rate, round(avg(CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END), 4) AS downgrade_rate
        FROM {source} {'GROUP BY ' + group if group else ''}"""


_METRICS = ("chat_count", "avg_latency_ms", "p95_latency_ms", "avg_evidence_count", "avg_kg_relation_count", "fallback_rate", "downgrade_rate")


@query(f"WITH e AS (SELECT *, coalesce(value, 0) AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 300) {_sql_metrics('', 'e')}")
def chat_metrics(spark, sf_dir):
    """Metrics over the last 300 events: the limit is the operator."""
    return metrics.snapshot(metrics.last_events(_events(spark, sf_dir), 300)).select(*_METRICS)


@query(f"WITH e AS (SELECT *, coalesce(value, 0) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 300) {_sql_metrics('event_type', 'e')}")
def chat_metrics_by_type(spark, sf_dir):
    return metrics.snapshot(metrics.last_events(_events(spark, sf_dir), 300, by="event_type"), by="event_type").select("event_type", *_METRICS)


@query("SELECT event_type, event_id AS id, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def recent_events(spark, sf_dir):
    rows = metrics.last_events(_events(spark, sf_dir), 10, by="event_type")
    return rows.select("event_type", "id", F.col("position").cast("long").alias("position"))


# --- evaluation --------------------------------------------------------------------------------------


def _sql_level(source: str, name: str) -> str:
    return f"""{name} AS (SELECT q, CASE WHEN bool_or({sql_any('text', HIGH)}) THEN 'High' WHEN bool_or({sql_any('text', MEDIUM)}) THEN 'Medium' ELSE 'Low' END AS predicted,
        bool_or({sql_any("drug || ' ' || section || ' ' || text", ('tion', 'lich'))}) AND bool_or(list_contains(drugs, drug)) AS hit FROM {source} GROUP BY q)"""


_SQL_VARIANTS = f"""{rq._SQL_RERANKED}, ta AS (SELECT d.q, c.drug, section, c.text, drugs FROM dense d JOIN corpus c USING (ord) JOIN questions qq ON qq.q = d.q WHERE rank <= 8),
    tb AS (SELECT fr.q, drug, section, fr.text, qq.drugs FROM fr JOIN questions qq ON qq.q = fr.q WHERE rank <= 8), tc AS (SELECT re.q, drug, section, re.text, qq.drugs FROM re JOIN questions qq ON qq.q = re.q WHERE rank <= 8),
    {_sql_level('ta', 'la')}, {_sql_level('tb', 'lb')}, {_sql_level('tc', 'lc')},
    rows_ AS (SELECT 'A' AS variant, * FROM la UNION ALL SELECT 'B', * FROM lb UNION ALL SELECT 'C', * FROM lc),
    al AS (SELECT v.variant, q.q, 'g' || (q.q % 4) AS grp, CASE WHEN q.q % 2 = 0 THEN 'High' ELSE 'Low' END AS expected, coalesce(predicted, 'Unknown') AS predicted, coalesce(hit, false) AS hit
        FROM questions q CROSS JOIN (SELECT unnest(['A', 'B', 'C']) AS variant) v LEFT JOIN rows_ r ON r.q = q.q AND r.variant = v.variant)"""


@query(f"""{_SQL_VARIANTS} SELECT variant, grp AS "group", count(*) AS total_cases, round(avg(CASE WHEN predicted = expected THEN 1 ELSE 0 END), 4) AS accuracy, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 4) AS evidence_hit_rate,
    round(avg(CASE WHEN predicted = 'Unknown' THEN 1 ELSE 0 END), 4) AS unknown_rate, round(avg(CASE WHEN predicted = 'Low' THEN 1 ELSE 0 END), 4) AS fallback_rate FROM al GROUP BY GROUPING SETS ((variant), (variant, grp))""")
def ablation_summary(spark, sf_dir):
    """Three variants on the benchmark texts: vectors only, fused without re-ranking, re-ranked."""
    return metrics.evaluation_summary(_evaluated(spark, sf_dir))


@query(f"""{_SQL_VARIANTS} SELECT variant, count(*) FILTER (predicted = 'High') AS "High", count(*) FILTER (predicted = 'Medium') AS "Medium", count(*) FILTER (predicted = 'Low') AS "Low", count(*) FILTER (predicted = 'Unknown') AS "Unknown"
    FROM al GROUP BY variant""")
def ablation_distribution(spark, sf_dir):
    """Levels of each variant as a table."""
    rows = metrics.risk_distribution(_evaluated(spark, sf_dir))
    return rows.select(*[F.col(c) if c == "variant" else F.col(c).cast("long").alias(c) for c in rows.columns])


def _evaluated(spark, sf_dir):
    asked = questions(spark, sf_dir)
    docs = rq.corpus(spark, sf_dir)
    # three variants of the same two lists, which are made once
    dense = store.written(rq._dense_list(spark, sf_dir, 32), "dense")
    fused = store.written(rq.fused(spark, sf_dir, dense), "fused")
    lists = {"A": dense.join(docs, "ord"), "B": fused, "C": rq.reranked(spark, sf_dir, fused)}
    parts = None
    for name, ranked in lists.items():
        rows = ranked.where("rank <= 8").select(F.lit(name).alias("variant"), F.col("q"), "drug", "section", F.col("text").alias("snippet"))
        parts = rows if parts is None else parts.unionByName(rows)
    names = spark.createDataFrame([(v,) for v in lists], "variant string")  # three rows
    cases = asked.crossJoin(F.broadcast(names)).select("q", "variant", F.concat_ws("-", "variant", F.col("q").cast("string")).alias("case_id"), "drugs", F.array(F.lit("tion"), F.lit("lich")).alias("expected_terms"))
    evidence = parts.withColumn("case_id", F.concat_ws("-", "variant", F.col("q").cast("string"))).drop("q", "variant")
    hits = metrics.evidence_hit(evidence, cases.drop("q", "variant"))
    level = F.when(F.bool_or(text.contains_any(F.col("snippet"), HIGH)), "High").when(F.bool_or(text.contains_any(F.col("snippet"), MEDIUM)), "Medium").otherwise("Low")
    levels = evidence.groupBy("case_id").agg(level.alias("predicted"))
    rows = cases.join(hits, "case_id").join(levels, "case_id", "left").select(
        "variant", F.concat(F.lit("g"), (F.col("q") % 4).cast("string")).alias("group"), F.when(F.col("q") % 2 == 0, "High").otherwise("Low").alias("expected"),
        F.coalesce("predicted", F.lit("Unknown")).alias("predicted"), "evidence_hit", (F.coalesce("predicted", F.lit("Unknown")) == "Low").alias("fallback_used"),
    )
    return rows


@query("""SELECT CASE WHEN predicted = toxic THEN 'right' ELSE 'wrong' END AS verdict, count(*) AS n FROM (SELECT CASE WHEN contains(text, 'trash') OR contains(text, 'pathetic') THEN 1 ELSE 0 END AS predicted, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def label_accuracy(spark, sf_dir):
    """A word rule against the labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    guess = text.contains_any(F.col("text"), ("trash", "pathetic")).cast("int")
    return rows.groupBy(F.when(guess == F.col("toxic"), "right").otherwise("wrong").alias("verdict")).agg(F.count("*").alias("n"))


# --- streams -----------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """A stream of one table's files, and fresh places for its output and state in the shared folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = store.fresh(spark, "stream")
    folder = path if spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1 else f"{sf_dir}/{name}*.parquet"
    return spark.readStream.schema(schema).parquet(folder), f"{place}/out", f"{place}/state"


def _last(spark, out: str, key: str):
    rows = spark.read.parquet(out)
    columns = [c for c in rows.columns if c not in (key, "_batch", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("s")).select(key, "s.*")


@query("""WITH e AS (SELECT *, coalesce(value, 0) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events)
    SELECT event_type, count(*) AS n, round(avg(v), 4) AS avg_value, list_sort(list(v))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95_value FROM e WHERE n <= 300 GROUP BY event_type""")
def stream_metrics(spark, sf_dir):
    """The state after all events have arrived."""
    events, out, state = _stream(spark, sf_dir, "events")
    streams.run_available(streams.rolling_metrics(events.select("event_type", "event_id", "value")), out, state, "update")
    return _last(spark, out, "event_type").withColumn("avg_value", F.round("avg_value", 4))


@query(f"{_SQL_STATES} SELECT session_id, turn, drugs, population, conditions FROM z")
def stream_sessions(spark, sf_dir):
    """Session states from a stream of turns; the same rows as session_snapshot."""
    rows, out, state = _stream(spark, sf_dir, "conversations")
    body = F.col("text")
    people = F.filter(F.array(F.when(F.length("text") % 3 == 0, "older"), F.when(F.length("text") % 5 == 0, "younger"), F.when(body.contains("ö"), "other")), lambda x: x.isNotNull())
    said = rows.select(F.col("conv_id").alias("session_id"), "turn", text.present(body, _DRUGS).alias("drugs"), people.alias("population"), text.present(body, _CONDITIONS).alias("conditions"))
    streams.run_available(streams.session_states(said, "older", "younger"), out, state)
    return spark.read.parquet(out).select("session_id", "turn", *[F.array_join(c, "|").alias(c) for c in ("drugs", "population", "conditions")])


def _sql_ingest() -> str:
    from .text_queries import SQL as TEXT

    return TEXT["chunk_window_700"]


@query(_sql_ingest())
def stream_ingest(spark, sf_dir):
    docs, out, state = _stream(spark, sf_dir, "documents")
    streams.run_available(streams.ingested_chunks(docs), out, state)
    return spark.read.parquet(out).select("doc_id", "chunk_index", "chunk")


@query(_sql_ingest())
def stream_ingest_once(spark, sf_dir):
    """All documents delivered, then delivered again after a restart, and once more in another order: chunks come once."""
    place = store.fresh(spark, "deliveries")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for number in range(3):
        delivered = docs.where("doc_id is not null").orderBy("doc_id") if number == 2 else docs
        delivered.write.parquet(f"{place}/in/{number}")
        if number == 0:  # what comes again is what was delivered: its texts are in files of many tasks, and not dealt out again
            docs = spark.read.schema(docs.schema).parquet(f"{place}/in/0")
        arriving = spark.readStream.schema(docs.schema).parquet(f"{place}/in/*").withColumn("arrived", F.col("_metadata.file_modification_time"))
        streams.run_available(streams.ingested_chunks(arriving, arrived="arrived"), f"{place}/out/{number}", f"{place}/state", closing=False)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/out")
    return out.select("doc_id", "chunk_index", "chunk")


@query(gq.SQL["kg_upsert_edges"])
def stream_edges(spark, sf_dir):
    """The edges of kg_upsert_edges, merged into a stored table batch by batch; the last batch is delivered twice."""
    place = store.fresh(spark, "edges")
    rows = kg.valid(gq._orders_candidates(spark, sf_dir, dealt=True), 0.2).select("subject", "relation", "object_type", "object", "risk_level", F.col("confidence").cast("double").alias("confidence"), "ord")
    held = streams.edge_table(spark, f"{place}/table", 16)
    sink = streams.edge_upserts(held)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    for number in range(3):  # a delivery is a folder of as many files as its tasks write: one file is one task's work at both ends
        rows.where(F.pmod(F.xxhash64("ord"), F.lit(3)) == number).write.parquet(f"{place}/in/{number}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{place}/in/*")
        streams.run_available(arriving, f"{place}/out", f"{place}/state", sink=twice)
    weight = F.when(F.col("risk_level") == "High", 1.3).when(F.col("risk_level") == "Medium", 1.1).otherwise(0.8)
    return held.read().select(F.col("subject").alias("s_name"), F.col("relation").alias("rel"), F.col("object_type").alias("o_label"), F.col("object").alias("o_name"), weight.alias("weight"), "risk_level", "n_candidates")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Hourly windows under a watermark; complete once the stream has ended, so the last windows are updates."""
    events, out, state = _stream(spark, sf_dir, "events")
    streams.run_available(streams.windowed_metrics(events), out, state, "update")
    rows = spark.read.parquet(out)
    best = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean"), "_batch").alias("s"))
    return best.select(F.unix_timestamp("start").alias("start"), "event_type", "s.n", F.round("s.mean", 4).alias("mean"))
