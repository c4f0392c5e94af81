"""Streams of status events and metric facts: sources, state, windows, and an updatable table as the sink."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgergraph.operators import status
from ledgergraph.session import scratch_folder


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the parquet files in a folder (or of a glob), as they come."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").parquet(folder))


def status_state(events: DataFrame) -> DataFrame:
    """The running state of every document, for update mode. Partial states are combined before the shuffle."""
    return status.current(events)


def expiring_state(events: DataFrame, keep: str = "24 hours", late: str = "24 hours") -> DataFrame:
    """State per document that is dropped, and given out, ``keep`` after the last event; repeated events count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return status.sessions(once, keep)


def running_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Status changes per time window and status."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "status")
            .agg(F.count("*").alias("updates"), F.sum("entities_processed").alias("entities"))
            .select(F.col("w.start").alias("start"), "status", "updates", "entities"))


def metric_windows(facts: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Metric statistics per tumbling window."""
    return (facts.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "metric_type")
            .agg(F.count("*").alias("facts"), F.avg("value").alias("mean"), F.min("value").alias("min"),
                 F.max("value").alias("max"), F.stddev_samp("value").alias("std"))
            .select(F.col("w.start").alias("start"), "metric_type", "facts", "mean", "min", "max", "std"))


def sliding_windows(facts: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean and spread (population) per metric over sliding windows."""
    return (facts.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "metric_type")
            .agg(F.count("*").alias("facts"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "metric_type", "facts", "mean", "std"))


def watch(facts: DataFrame, windows: DataFrame, times: float = 2.0) -> DataFrame:
    """Facts far from the mean of the sliding window that ended at the start of their day.

    ``facts`` may be a stream; ``windows`` is the table that the sliding windows are written to. It has one row per
    metric and day.
    """
    day = F.date_trunc("day", "ts")
    known = windows.select(F.col("metric_type").alias("_m"), F.col("end").alias("_day"), "mean", "std")
    rows = facts.withColumn("_d", day).join(known, (F.col("metric_type") == F.col("_m")) & (F.col("_d") == F.col("_day")))
    return rows.filter(F.abs(F.col("value") - F.col("mean")) > F.col("std") * times).drop("_m", "_day", "_d")


def watch_live(facts: DataFrame, same: DataFrame, times: float = 2.0, length: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Facts far from the mean of the sliding window that ended at the start of their day, all in one stream.

    ``facts`` and ``same`` are two readings of one stream. The windows of the one are joined with the facts of the other in
    an interval of event time, with watermarks on both sides: a fact waits until its window is complete, and
    neither is kept longer than the interval.
    """
    w = (same.withWatermark("ts", late).groupBy(F.window("ts", length, "1 day").alias("w"), F.col("metric_type").alias("_m"))
         .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))
    windows = w.select(F.window_time("w").alias("_upto"), "_m", "mean", "std")
    rows = facts.withWatermark("ts", late)
    in_day = (F.col("metric_type") == F.col("_m")) & (F.col("ts") > F.col("_upto")) & (F.col("ts") <= F.col("_upto") + F.expr("INTERVAL 1 DAY"))
    return rows.join(windows, in_day).filter(F.abs(F.col("value") - F.col("mean")) > F.col("std") * times).drop("_m", "_upto")


def run_to_table(stream: DataFrame, mode: str, folder: str | None = None) -> str:
    """Run a stream over what is there and append each batch's rows, with the batch number, to a parquet table.

    Returns the folder of the table. A batch that is run again after a failure replaces its own part only.
    """
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return f"{folder}/table"


def latest_rows(spark: SparkSession, folder: str, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The last written row of each key of a table of updates; ``order`` tells rows of one batch apart.

    Reads the newest base that :func:`compact` has written, and the batches after it.
    """
    upto, base = _newest_base(spark, folder)
    rows = spark.read.parquet(folder)
    if base is not None:
        rows = rows.where(F.col("batch") > upto).unionByName(spark.read.parquet(base).select(*rows.columns))
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*cols), F.struct("batch", *[o.alias(f"o{i}") for i, o in enumerate(order or [])]))
    return rows.groupBy(*keys).agg(newest.alias("z"), F.max("batch").alias("batch")).select(*keys, "z.*", "batch").drop("batch")


def _newest_base(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    try:
        rows = spark.read.schema("upto long, base string").parquet(f"{folder}-bases/manifest").orderBy(F.desc("upto")).head(1)
    except AnalysisException:
        rows = []
    return (rows[0].upto, f"{folder}-bases/{rows[0].base}") if rows else (-1, None)


def compact(spark: SparkSession, folder: str, keys: list[str]) -> None:
    """Write the last row of each key, as of the batches there are, as a new base.

    Readers change over when the manifest names it, in one write. Rows keep the number of their batch.
    """
    upto, base = _newest_base(spark, folder)
    rows = spark.read.parquet(folder)
    newest = rows.agg(F.max("batch")).first()[0]
    if newest is None or newest == upto:
        return
    fresh = rows.where((F.col("batch") > upto) & (F.col("batch") <= newest))
    if base is not None:
        fresh = fresh.unionByName(spark.read.parquet(base).select(*rows.columns))
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    live = F.max_by(F.struct(*cols, "batch"), F.struct("batch", *([F.col("kind") != "expired"] if "kind" in cols else [])))
    name = f"base-{uuid.uuid4().hex}"
    fresh.groupBy(*keys).agg(live.alias("z")).select(*keys, "z.*").write.parquet(f"{folder}-bases/{name}")
    spark.createDataFrame([(int(newest), name)], "upto long, base string").coalesce(1).write.mode("append").parquet(f"{folder}-bases/manifest")
