"""Processing status: current state, history, stage times, metrics, reports. Works on a batch or a stream of events.

The state of a document is made of aggregates only (last, first, count), so one expression serves both: in batch as
a plain aggregation, in a stream as a stateful one. Events may come late or out of order: the last one is the one
with the greatest (ts, event_id), and the first time of a stage is a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.catalog import kinds

FINAL = ["completed", "failed"]


def state_columns() -> list[Column]:
    """The aggregates that make up the state of a document."""
    at = F.struct("ts", "event_id")

    def last(value, when: Column) -> Column:
        return F.max_by(F.when(when, value), F.when(when, at))
    status = F.col("status")
    always = F.lit(True)
    return [
        last(F.struct("status", "progress", "entities_processed", "relationships_processed"), always).alias("now"),
        last(F.col("stage"), F.col("stage").isNotNull()).alias("current_stage"),
        last(F.col("error_message"), F.col("error_message").isNotNull()).alias("last_error"),
        F.count_if(F.col("error_message").isNotNull()).alias("retry_count"),
        F.min("ts").alias("start_time"), F.max(F.when(status.isin(*FINAL), F.col("ts"))).alias("end_time"),
        *[F.min(F.when(F.col("stage") == s, F.col("ts"))).alias(f"{s}_at") for s in kinds.STAGES],
        F.count("*").alias("updates"),
    ]


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def spread_out(state: DataFrame, keys: list[str]) -> DataFrame:
    """State rows with the last values as columns and the duration in seconds."""
    return state.select(
        *keys, "now.*", "current_stage", "last_error", "retry_count", "start_time", "end_time",
        seconds(F.col("start_time"), F.col("end_time")).alias("processing_duration"),
        *[f"{s}_at" for s in kinds.STAGES], "updates")


def current(events: DataFrame) -> DataFrame:
    """The present state of every document."""
    return spread_out(events.groupBy("document_id").agg(*state_columns()), ["document_id"])


def sessions(events: DataFrame, keep: str = "24 hours") -> DataFrame:
    """State per document and spell of activity; a spell ends when nothing came for ``keep``, and its state goes."""
    state = events.groupBy("document_id", F.session_window("ts", keep).alias("w")).agg(*state_columns())
    return spread_out(state, ["document_id", "w"]).withColumn("expires", F.col("w.end")).drop("w")


def history(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events in a time range, both ends included, either left open."""
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return events


def clear(events: DataFrame, cleared: DataFrame) -> DataFrame:
    """Events that still count after documents were cleared (document_id, cleared_at): only later ones do."""
    last = cleared.groupBy("document_id").agg(F.max("cleared_at").alias("_at"))
    return (events.join(last, "document_id", "left").filter(F.col("_at").isNull() | (F.col("ts") > F.col("_at")))
            .drop("_at"))


def stage_durations(events: DataFrame) -> DataFrame:
    """First time of each stage of each document and the seconds until the next stage's first time.

    The window sees one row per stage, so at most as many rows per document as there are stages.
    """
    first = (events.filter(F.col("stage").isNotNull()).groupBy("document_id", "stage")
             .agg(F.min(F.struct("ts", "event_id")).alias("f")))
    w = Window.partitionBy("document_id").orderBy("f")
    return first.select("document_id", "stage", F.col("f.ts").alias("first_seen"),
                        seconds(F.col("f.ts"), F.lead("f.ts").over(w)).alias("seconds"))


def processing_metrics(events: DataFrame) -> DataFrame:
    """One row: documents, results, times, averages and speed. Every completion counts."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    done = F.col("status") == "completed"
    docs = events.groupBy("document_id").agg(
        F.min(micros).alias("start"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(done).alias("done"),
        F.sum(F.when(done, F.col("entities_processed"))).alias("entities"),
        F.sum(F.when(done, F.col("relationships_processed"))).alias("relationships"),
        F.sum(F.when(done, micros.cast("decimal(20,0)"))).alias("ends"), F.max(F.when(done, micros)).alias("last_end"))
    # The times of all completions of a document: sum of their ends less its start, as many times.
    spent = (F.col("ends") - F.col("start").cast("decimal(20,0)") * F.col("done")).cast("double") / 1e6
    n, t = F.col("processed_documents"), F.col("_t")
    row = docs.agg(
        F.count("*").alias("total_documents"), F.sum("done").alias("processed_documents"),
        F.sum("failed").alias("failed_documents"), F.sum("entities").alias("total_entities"),
        F.sum("relationships").alias("total_relationships"), F.sum(spent).alias("_t"),
        (F.max(F.col("last_end") - F.col("start")) / 1e6).alias("peak_processing_time"))
    return row.select(
        "total_documents", "processed_documents", "failed_documents", "total_entities", "total_relationships",
        F.when(n > 0, t / n).alias("average_processing_time"), "peak_processing_time",
        (n / F.col("total_documents")).alias("success_rate"),
        F.when(n > 0, F.col("total_entities") / n).alias("average_entities_per_document"),
        F.when(n > 0, F.col("total_relationships") / n).alias("average_relationships_per_document"),
        F.when(t > 0, n * 3600 / t).alias("processing_speed"))


def error_counts(events: DataFrame) -> DataFrame:
    return events.filter("error_message IS NOT NULL").groupBy("error_message").agg(F.count("*").alias("errors"))


def performance(states: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row on the documents that started in a time range."""
    s = started(states, start, end)
    done = F.col("status") == "completed"
    row = s.agg(F.count("*").alias("total_documents"), F.count_if(done).alias("completed_documents"),
                F.count_if(F.col("status") == "failed").alias("failed_documents"),
                F.coalesce(F.sum(F.when(done, F.col("processing_duration"))), F.lit(0.0)).alias("total_processing_time"))
    n, t = F.col("completed_documents"), F.col("total_processing_time")
    return row.select("*", F.when(F.col("total_documents") > 0, n / F.col("total_documents")).otherwise(0.0).alias("success_rate"),
                      F.when(n > 0, t / n).otherwise(0.0).alias("average_processing_time"),
                      F.when(t > 0, n * 3600 / t).otherwise(0.0).alias("documents_per_hour"))


def started(states: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        states = states.filter(F.col("start_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        states = states.filter(F.col("start_time") <= F.lit(end).cast("timestamp_ntz"))
    return states


def stage_distribution(states: DataFrame, stages: DataFrame) -> DataFrame:
    """Documents per current stage, with a zero for stages that have none."""
    n = states.groupBy(F.col("current_stage").alias("stage")).agg(F.count("*").alias("documents"))
    return stages.join(n, "stage", "left").fillna(0, ["documents"])


def error_distribution(states: DataFrame) -> DataFrame:
    """Failed documents per last error."""
    return states.filter("status = 'failed' AND last_error IS NOT NULL").groupBy("last_error").agg(
        F.count("*").alias("documents"))


def daily_runs(events: DataFrame, days: int = 7) -> DataFrame:
    """Runs of the last days before the newest event: documents touched, completed and failed per day."""
    newest = events.agg(F.max("ts")).scalar()
    recent = events.filter(F.col("ts") >= newest - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("batch_id")).agg(
        F.count_distinct("document_id").alias("documents"),
        F.count_if(F.col("status") == "completed").alias("processed_documents"),
        F.count_if(F.col("status") == "failed").alias("failed_documents"))
