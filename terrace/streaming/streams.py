"""Streaming forms of rolling metrics, session state and ingestion; each gives what the batch operator gives."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators import chunking
from ..sources.versioned import Versioned

METRIC_OUT = "event_type string, n long, avg_value double, p95_value double"
_KEPT = StructType([StructField("event_id", LongType()), StructField("value", DoubleType())])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """The newest ``size`` events of a key by event_id, in a list state; a key that is idle for ``idle`` ms loses it."""

    def __init__(self, size: int, idle: int | None):
        self.size, self.idle = size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("newest", _KEPT, ttlDurationMs=self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {e: v for e, v in self.kept.get()}
        for frame in rows:  # no more than ``size`` events are held beside a batch
            kept.update(zip(frame["event_id"].tolist(), frame["value"].fillna(0.0).tolist(), strict=True))
            if len(kept) > self.size:
                kept = {e: kept[e] for e in heapq.nlargest(self.size, kept)}
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        self.kept.put(sorted(kept.items()))
        ordered = sorted(kept.values())
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(kept)], "avg_value": [math.fsum(ordered) / len(kept)], "p95_value": [ordered[min(len(kept) - 1, int(len(kept) * 0.95))]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({"event_type": [key[0]], "n": [0], "avg_value": [0.0], "p95_value": [0.0]})

    def close(self) -> None:
        pass


def rolling_metrics(events: DataFrame, size: int = 300, idle_hours: float | None = None) -> DataFrame:
    """Per event_type, mean and p95 of the newest ``size`` values by event_id after each micro-batch; events(event_type,
    event_id, value). Which events come in which micro-batch, in what order or how often makes no difference. Events without
    an id are left out.

    With ``idle_hours`` the state has that time to live, and a timer reports a type without events once, with n = 0. Timers
    need a stream that goes on; one that stops when it has caught up (``run_available``) would wait for them forever.
    """
    rows = events.where("event_id is not null").select("event_type", "event_id", "value")
    idle = None if idle_hours is None else int(idle_hours * 3_600_000)
    return rows.groupBy("event_type").transformWithStateInPandas(_Newest(size, idle), METRIC_OUT, "Update", "None" if idle is None else "ProcessingTime")


SESSION_STATE = "drugs array<string>, population array<string>, conditions array<string>"
SESSION_OUT = "session_id long, turn long, drugs array<string>, population array<string>, conditions array<string>, new_drugs array<string>, new_conditions array<string>"


def session_states(turns: DataFrame, older: str = "老年人", younger: str = "儿童") -> DataFrame:
    """State after each turn of turns(session_id, turn, drugs, population, conditions), and what the turn added."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drugs, people, conditions = (set(x) for x in (state.get if state.exists else ((), (), ())))
        out = []
        for t in pd.concat(list(batches)).sort_values("turn").itertuples():
            now = set(t.population)
            if younger in now and older not in now:
                people.discard(older)
            if older in now and younger not in now:
                people.discard(younger)
            people |= now
            new_d, new_c = sorted(set(t.drugs) - drugs), sorted(set(t.conditions) - conditions)
            drugs |= set(t.drugs)
            conditions |= set(t.conditions)
            out.append((key[0], t.turn, sorted(drugs), sorted(people), sorted(conditions), new_d, new_c))
        state.update((sorted(drugs), sorted(people), sorted(conditions)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION_OUT.split(", ")])

    return turns.groupBy("session_id").applyInPandasWithState(update, SESSION_OUT, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


def ingested_chunks(documents: DataFrame, key: str = "doc_id", value: str = "text", arrived: str | None = None, within: str = "7 days") -> DataFrame:
    """Chunks of documents as they arrive; the same as in batch.

    With ``arrived``, the time at which a document came, one that comes again ``within`` that time gives no second chunks:
    documents are known by a hash of key and content, kept until the watermark has passed them, also over a restart.
    """
    if arrived:
        known = F.sha1(F.concat_ws("\n", F.col(key).cast("string"), F.col(value)))
        documents = documents.withColumn("_hash", known).withWatermark(arrived, within).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")
    return chunking.page_chunks(documents, key, value)


EDGES = "subject string, relation string, object_type string, object string, risk_level string, confidence double, ord long, n_candidates long"


def edge_table(spark: SparkSession, path: str, groups: int = 64) -> Versioned:
    """Stored edges by subject."""
    return Versioned(spark, path, StructType.fromDDL(EDGES), ["subject"], groups)


def last_of_edges(rows: DataFrame) -> DataFrame:
    """One row per (subject, relation, object_type, object): the attributes of its last candidate and their number. As the last
    one is known by its own order, it does not matter in which batches candidates came.

    The hash comes first because this aggregate sorts, and names that begin alike are slow to compare.
    """
    key = ["subject", "relation", "object_type", "object"]
    last = rows.groupBy(F.xxhash64(*key).alias("_k"), *key).agg(F.max(F.struct("ord", "confidence", "risk_level")).alias("a"), F.sum("n_candidates").alias("n_candidates"))
    return last.select(*key, "a.risk_level", "a.confidence", "a.ord", "n_candidates")


def edge_upserts(table: Versioned) -> Callable[[DataFrame, int], None]:
    """A sink that merges valid candidates(subject, relation, object_type, object, risk_level, confidence, ord) into stored
    edges: only the groups of the batch's subjects are written again, and a batch that comes again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        # candidates go in as they are: old edges and new candidates are aggregated together, once
        table.merge(batch.withColumn("n_candidates", F.lit(1).cast("long")), last_of_edges, f"batch-{number}")

    return write


def windowed_metrics(events: DataFrame, lateness: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event-time windows of events(ts, event_type, value): count and mean, closed by a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, closing: bool = True) -> None:
    """Process what is there, then stop; each micro-batch is a Parquet folder named by its number, so a repeat replaces it.

    State is kept in RocksDB, which list states, timers and a time to live need; the session's own settings are left as they
    were. Without ``closing`` there is no last batch without data under the new watermark: state that it has passed goes with
    the next data. That is for streams which return nothing for state that ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = stream.sparkSession.conf
    settings = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB} | ({} if closing else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    before = {name: conf.get(name) for name in settings}
    for name, setting in settings.items():
        conf.set(name, setting)
    try:
        stream.writeStream.foreachBatch(sink or write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, setting in before.items():
            conf.set(name, setting)
