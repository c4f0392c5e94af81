"""Processing status as a state machine: one state per document, which expires, can be cleared, and survives restarts.

The state of a document is a single value in the state store, with a timer 24 hours of event time after its last event.
An event after a longer pause starts a new spell, whether or not the timer has fired by then; a clearing drops the state
and keeps only its time, until that expires too, so that late events of before don't revive the document. So the
store holds the documents of one day. Each batch gives the rows of the documents that changed, and what they add to the
running metrics, as sums that can be merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgergraph.operators.status import FINAL
from ledgergraph.session import scratch_folder
from ledgergraph.streaming.runs import compact, latest_rows

KEEP = 24 * 3600 * 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["at", "at_id", "status", "progress", "entities", "relationships", "stage", "error", "retries", "start", "end", "updates", "cleared"]
STATE = ("at long, at_id long, status string, progress double, entities long, relationships long, stage string, error string, "
         "retries long, start long, end long, updates long, cleared long")
SUMS = ["begun", "done", "failed", "sum_entities", "sum_relationships", "spent"]
COLUMNS = ["document_id", "kind", "status", "progress", "entities_processed", "relationships_processed", "current_stage", "last_error", "retry_count",
           "start_time", "end_time", "expires", "updates", *SUMS, "peak", "errors"]
ROWS = ("document_id string, kind string, status string, progress double, entities_processed long, relationships_processed long, current_stage string, "
        "last_error string, retry_count long, start_time long, end_time long, expires long, updates long, begun long, done long, failed long, "
        "sum_entities long, sum_relationships long, spent long, peak long, errors string")


USED = ["at", "clears", "event_id", "status", "stage", "progress", "entities_processed", "relationships_processed", "error_message"]


def _in_order(frames: Iterable[pd.DataFrame]) -> list[dict]:
    """The events of one document in the order of their times, clearings after events, ids; missing values are None and come last.

    Groups are small and many, so they are taken as plain lists: sorting and casting a frame costs more than the events do.
    """
    rows = []
    for frame in frames:
        for values in zip(*[frame[c].tolist() for c in USED], strict=True):
            rows.append({c: None if v is None or v != v else v for c, v in zip(USED, values, strict=True)})
    return sorted(rows, key=lambda e: [(e[c] is None, e[c] or 0) for c in USED[:3]])


class Tracker(StatefulProcessor):
    """Rows of kind ``live``, ``cleared`` (both with the sums of the batch) and ``expired``. Times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = _in_order(rows)
        state = dict(zip(FIELDS, self.value.get(), strict=True)) if self.value.exists() else None
        timer, out, sums, errors = self._timer(state), [], dict.fromkeys([*SUMS, "peak"], 0), {}
        for e in events:
            if state and state["cleared"] is not None and e["at"] <= state["cleared"]:
                continue
            if e["clears"]:
                if state and state["at"] is not None and e["at"] - state["at"] >= KEEP:
                    out.append(self._row(key, "expired", state))
                if state is None or state["at"] is None or state["at"] <= e["at"]:
                    state = dict.fromkeys(FIELDS) | {"cleared": e["at"]}
                continue
            if state and state["at"] is not None and e["at"] - state["at"] >= KEEP:
                out.append(self._row(key, "expired", state))
                state = None
            state = self._add(state, e, sums, errors)
        self.value.update(tuple(state[f] for f in FIELDS))
        new = self._timer(state)
        if timer != new:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new)
        counts = json.dumps(errors) if errors else None
        out.append(self._row(key, "live" if state["at"] is not None else "cleared", state) | sums | {"errors": counts})
        yield pd.DataFrame([[r.get(c) for c in COLUMNS] for r in out], columns=COLUMNS, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = dict(zip(FIELDS, self.value.get(), strict=True)) if self.value.exists() else None
        out = []
        if state and self._timer(state) <= expiredTimerInfo.getExpiryTimeInMs():
            out = [self._row(key, "expired", state)] if state["at"] is not None else []
            self.value.clear()
        yield pd.DataFrame([[r.get(c) for c in COLUMNS] for r in out], columns=COLUMNS, dtype=object)

    def close(self) -> None:
        pass

    @staticmethod
    def _timer(state: dict | None) -> int | None:
        return None if state is None else ((state["cleared"] if state["at"] is None else state["at"]) + KEEP) // 1000

    @staticmethod
    def _add(state: dict | None, e: dict, sums: dict, errors: dict) -> dict:
        if state is None or state["at"] is None:
            cleared = state["cleared"] if state else None
            state = dict.fromkeys(FIELDS) | {"start": e["at"], "retries": 0, "updates": 0, "cleared": cleared}
            sums["begun"] += 1
        state["updates"] += 1
        state["start"] = min(state["start"], e["at"])
        if state["at"] is None or (e["at"], e["event_id"]) > (state["at"], state["at_id"]):
            state |= {"at": e["at"], "at_id": e["event_id"], "status": e["status"], "progress": e["progress"],
                      "entities": e["entities_processed"], "relationships": e["relationships_processed"]}
            state["stage"] = e["stage"] if e["stage"] is not None else state["stage"]
            state["error"] = e["error_message"] if e["error_message"] is not None else state["error"]
        if e["error_message"] is not None:
            state["retries"] += 1
            errors[e["error_message"]] = errors.get(e["error_message"], 0) + 1
        if e["status"] in FINAL:
            state["end"] = max(state["end"] or e["at"], e["at"])
        if e["status"] == "completed":
            spent = e["at"] - state["start"]
            sums["done"] += 1
            sums["sum_entities"] += e["entities_processed"] or 0
            sums["sum_relationships"] += e["relationships_processed"] or 0
            sums["spent"] += spent
            sums["peak"] = max(sums["peak"], spent)
        sums["failed"] += e["status"] == "failed"
        return state

    @staticmethod
    def _row(key: Any, kind: str, s: dict) -> dict:
        shown = ["status", "progress", "entities", "relationships", "stage", "error", "retries", "start", "end"]
        out = {"document_id": key[0], "kind": kind} | dict(zip(COLUMNS[2:11], (s[f] for f in shown), strict=True))
        return out | {"expires": None if s["at"] is None else s["at"] + KEEP, "updates": s["updates"]}


def track(events: DataFrame, cleared: DataFrame | None = None, late: str = "0 seconds") -> DataFrame:
    """The rows of :class:`Tracker` for streams of events and of clearings (document_id, ts)."""
    columns = ["document_id", "ts", "event_id", "status", "stage", "progress", "entities_processed", "relationships_processed", "error_message"]
    rows = events.select(*columns, F.lit(False).alias("clears"))
    if cleared is not None:
        rows = rows.unionByName(cleared.select("document_id", "ts", F.lit(0).cast("long").alias("event_id"), F.lit(True).alias("clears")), allowMissingColumns=True)
    rows = rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    return rows.groupBy("document_id").transformWithStateInPandas(Tracker(), ROWS, "Update", "EventTime")


def run_tracker(stream: DataFrame, folder: str | None = None, every: int = 8) -> str:
    """Run a stream of :func:`track` over what is there; run again with the same folder it goes on where it stopped.

    Each batch writes its rows to ``folder/table`` and its sums to ``folder/sums``; every few batches the table of states is
    compacted. A batch that is run again replaces its own rows. Returns the folder.
    """
    spark: SparkSession = stream.sparkSession
    folder = folder or scratch_folder(spark, "tracker")

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/table/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(ROWS).parquet(path)
        rows.agg(*[F.sum(c).alias(c) for c in SUMS], F.max("peak").alias("peak")).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
        counts = rows.select(F.explode(F.from_json("errors", "map<string,long>")).alias("error_message", "n"))
        counts.groupBy("error_message").agg(F.sum("n").alias("errors")).write.mode("overwrite").parquet(f"{folder}/errors/batch={number}")
        if number % every == every - 1:
            compact(spark, f"{folder}/table", ["document_id"])

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # a query keeps the setting that it starts with
    try:
        query = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True).foreachBatch(write).start())
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    query.awaitTermination()
    return folder


def _times(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("start_time", "end_time", "expires")})


def live_states(spark: SparkSession, folder: str) -> DataFrame:
    """The states that have neither expired nor been cleared: the newest row of each document."""
    shown = COLUMNS[:COLUMNS.index("updates") + 1]
    rows = latest_rows(spark, f"{folder}/table", ["document_id"], order=[F.col("kind") != "expired"]).where("kind = 'live'")
    return _times(rows.select(*shown).drop("kind"))


def expired_states(spark: SparkSession, folder: str) -> DataFrame:
    """All states that have expired, one for each spell."""
    return _times(spark.read.parquet(f"{folder}/table").where("kind = 'expired'").drop("kind", "batch", *SUMS, "peak", "errors"))


def running_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the metrics of all batches so far; a spell counts as a document."""
    s = spark.read.parquet(f"{folder}/sums").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.max("peak").alias("peak"))
    n, t = F.col("done"), F.col("spent") / 1e6
    return s.select(
        F.col("begun").alias("total_documents"), n.alias("processed_documents"), F.col("failed").alias("failed_documents"),
        F.col("sum_entities").alias("total_entities"), F.col("sum_relationships").alias("total_relationships"),
        F.when(n > 0, t / n).alias("average_processing_time"), (F.col("peak") / 1e6).alias("peak_processing_time"),
        F.when(F.col("begun") > 0, n / F.col("begun")).alias("success_rate"), F.when(n > 0, F.col("sum_entities") / n).alias("average_entities_per_document"),
        F.when(n > 0, F.col("sum_relationships") / n).alias("average_relationships_per_document"), F.when(t > 0, n * 3600 / t).alias("processing_speed"))


def running_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How often each error message came, over all batches so far."""
    return spark.read.parquet(f"{folder}/errors").groupBy("error_message").agg(F.sum("errors").alias("errors"))
