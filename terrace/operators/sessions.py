"""Session state over turns, and the tables of sessions, messages and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.versioned import Versioned


def snapshots(turns: DataFrame, older: str = "老年人", younger: str = "儿童") -> DataFrame:
    """Running state of turns(session_id, turn, message, drugs, population, conditions, risk_factors) after each turn.

    Sets only grow, but a turn with ``younger`` and not ``older`` drops an earlier ``older`` and the reverse. That fold has a
    closed form: a label stays while its last turn is later than the last turn that had the other one alone. A value is in
    the state from its first turn on, so each session keeps its distinct values with their first turns, once, and a turn's
    state is those that came by then: work goes with turns and values, not with the square of a session's length.
    """
    lists = ("drugs", "population", "conditions", "risk_factors")

    def named(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(c).alias("kind"), v.alias("value")))

    values = F.concat(*map(named, lists))
    firsts = turns.select("session_id", "turn", F.explode(values).alias("v")).groupBy("session_id", "v.kind", "v.value").agg(F.min("turn").alias("first"))
    known = firsts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "first"))).alias("_known"))
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    has = lambda label: F.array_contains("population", label)
    last = lambda cond: F.coalesce(F.max(F.when(cond, F.col("turn"))).over(w), F.lit(-1))
    keep_older = last(has(older)) > last(has(younger) & ~has(older))
    keep_younger = last(has(younger)) > last(has(older) & ~has(younger))
    rows = turns.select("session_id", "turn", F.col("message").alias("last_question"), keep_older.alias("_o"), keep_younger.alias("_y")).join(known, "session_id", "left")
    by_now = lambda c: F.transform(F.filter("_known", lambda k: (k["kind"] == c) & (k["first"] <= F.col("turn"))), lambda k: k["value"])
    state = {c: F.coalesce(by_now(c), F.array().cast("array<string>")) for c in lists}
    people = F.filter(state["population"], lambda x: F.when(x == older, F.col("_o")).when(x == younger, F.col("_y")).otherwise(F.lit(True)))
    return rows.select("session_id", "turn", *[(people if c == "population" else state[c]).alias(c) for c in lists], "last_question")


def memory_updates(states: DataFrame) -> DataFrame:
    """(session_id, turn, position, event_type, name): drugs, then conditions, that a turn adds to the state."""
    w = Window.partitionBy("session_id").orderBy("turn")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.array().cast("array<string>"))
    new = lambda c, kind: F.transform(F.array_sort(F.array_except(c, before(c))), lambda x: F.struct(F.lit(kind).alias("event_type"), x.alias("name")))
    rows = states.select("session_id", "turn", new("drugs", "medication_mentioned").alias("a"), new("conditions", "condition_mentioned").alias("b"))
    return rows.select("session_id", "turn", F.posexplode(F.concat("a", "b")).alias("position", "e")).select("session_id", "turn", "position", "e.*")


def latest(messages: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the columns of its latest message."""
    return messages.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("m"), F.count("*").alias("n_messages")).select(key, "m.*", "n_messages")


def session_rows(messages: DataFrame, title_chars: int = 32, default: str = "新的用药咨询") -> DataFrame:
    """(session_id, title, risk_level, conclusion, created_at, updated_at, n_messages) of messages(id, session_id, message, ..., created_at)."""
    first = F.min_by("message", F.struct("created_at", "id"))
    last = lambda c: F.max_by(c, F.struct("created_at", "id"))
    title = F.coalesce(F.nullif(F.substring(first, 1, title_chars), F.lit("")), F.lit(default))
    return messages.groupBy("session_id").agg(title.alias("title"), last("risk_level").alias("risk_level"), last("conclusion").alias("conclusion"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("n_messages"))


def newest(rows: DataFrame, limit: int = 30, order: str = "updated_at", tie: str = "session_id") -> DataFrame:
    """A user-facing list: at most 1 to 100 rows, newest first."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(min(max(limit, 1), 100))


def session_detail(sessions: DataFrame, messages: DataFrame, user: Column | str, schema: str | None = None) -> DataFrame:
    """Messages of the sessions that a user owns, in order; the stored JSON is parsed and gets the session's id."""
    own = sessions.where(F.col("user_id") == user).select("session_id")
    rows = messages.join(own, "session_id")
    if schema:
        rows = rows.withColumn("response", F.from_json("response_json", schema).withField("session_id", F.col("session_id")))
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return rows.withColumn("position", F.row_number().over(w))


def without_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without doomed(session_id, user_id); only the owner's sessions go, with their messages."""
    gone = sessions.join(doomed, ["session_id", "user_id"], "left_semi").select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def query_drugs(now: Column, memory: Column) -> Column:
    """The drugs a question is about: those it mentions, else those of the session."""
    return F.when(F.size(now) > 0, now).otherwise(memory)


MESSAGES = "id long, session_id long, user_id string, message string, risk_level string, conclusion string, created_at long"
HISTORY = "id long, user_id string, question string, report string, created_at long"


def message_table(spark: SparkSession, path: str, schema: str = MESSAGES) -> Versioned:
    """Messages by session; session rows follow from them (``session_rows``). A session goes with its messages, by its owner."""
    return Versioned(spark, path, StructType.fromDDL(schema), ["session_id"])


def history_table(spark: SparkSession, path: str, schema: str = HISTORY) -> Versioned:
    """Analyses by id: created by an append, deleted by id (and owner)."""
    return Versioned(spark, path, StructType.fromDDL(schema), ["id"])


def history(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The newest analyses."""
    return newest(rows, limit, "created_at", "id")


def history_entry(rows: DataFrame, entry: int) -> DataFrame:
    return rows.where(F.col("id") == entry)
