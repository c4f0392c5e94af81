"""Queries on processing status, in batch and as streams (S1-S9), stage times (F9), metrics (E13, E14, E17), B9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgergraph.catalog import frames, kinds
from ledgergraph.operators import status as s
from ledgergraph.plans import sql
from ledgergraph.plans.quality import FACTS
from ledgergraph.plans.registry import query
from ledgergraph.session import scratch_folder
from ledgergraph.sources import bindings as b
from ledgergraph.sources.tables import table
from ledgergraph.streaming import runs, tracker

STATUS = f"WITH {sql.STATUS}"
TEXT, SQLT = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def stamp(c, name=None):
    return F.date_format(c, TEXT).alias(name or c)


def _now(source: str = "status") -> str:
    return f"""now AS (
  SELECT document_id, max_by(status, (ts, event_id)) AS status, max_by(progress, (ts, event_id)) AS progress,
    max_by(entities_processed, (ts, event_id)) AS entities_processed,
    max_by(stage, (ts, event_id)) FILTER (stage IS NOT NULL) AS current_stage,
    max_by(error_message, (ts, event_id)) FILTER (error_message IS NOT NULL) AS last_error,
    count(error_message) AS retry_count, min(ts) AS start_time,
    max(ts) FILTER (status IN ('completed', 'failed')) AS end_time,
    min(ts) FILTER (stage = 'entity_extraction') AS entity_extraction_at,
    min(ts) FILTER (stage = 'graph_storage') AS graph_storage_at, count(*) AS updates
  FROM {source} GROUP BY document_id)"""


NOW_COLUMNS = f"""document_id, status, progress, entities_processed, current_stage, last_error, retry_count,
  strftime(start_time, '{SQLT}') AS start_time, strftime(end_time, '{SQLT}') AS end_time,
  round(CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) / 1000000, 6) AS processing_duration,
  strftime(entity_extraction_at, '{SQLT}') AS entity_extraction_at, strftime(graph_storage_at, '{SQLT}') AS graph_storage_at,
  updates"""


def _shown(states):
    return states.select("document_id", "status", "progress", "entities_processed", "current_stage", "last_error",
                         "retry_count", stamp("start_time"), stamp("end_time"),
                         F.round("processing_duration", 6).alias("processing_duration"),
                         stamp("entity_extraction_at"), stamp("graph_storage_at"), "updates")


def _stream(spark, sf):
    """The events as a stream. Event time must be a TIMESTAMP there; the table's times are taken as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, sf, "events").schema
    return runs.file_stream(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(STATUS + f"""
SELECT document_id, strftime(min(ts), '{SQLT}') AS registered_at, count(*) AS registrations FROM status
WHERE status = 'pending' GROUP BY document_id""")
def s1_registered_documents(spark, sf):
    return (b.status_events(spark, sf).filter("status = 'pending'").groupBy("document_id")
            .agg(stamp(F.min("ts"), "registered_at"), F.count("*").alias("registrations")))


@query(STATUS + ", " + _now() + f" SELECT {NOW_COLUMNS} FROM now")
def s2_status_stream(spark, sf):
    """The state of every document, kept by a stream in update mode; the table holds the last row of each."""
    stream = runs.status_state(b.status_from_events(_stream(spark, sf)))
    return _shown(runs.latest_rows(spark, runs.run_to_table(stream, "update"), ["document_id"]))


@query(STATUS + ", " + _now() + f" SELECT {NOW_COLUMNS} FROM now")
def s3_current_status(spark, sf):
    return _shown(s.current(b.status_events(spark, sf)))


@query(STATUS + f"""
SELECT event_id, document_id, strftime(ts, '{SQLT}') AS ts, status, stage FROM status
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def s4_status_history(spark, sf):
    """The appended log, read for a range of time."""
    h = s.history(b.status_events(spark, sf), "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return h.select("event_id", "document_id", stamp("ts"), "status", "stage")


SPELLS = STATUS + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh
  FROM status WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
spell AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS no FROM g)"""


@query(SPELLS + f"""
SELECT document_id, strftime(min(ts), '{SQLT}') AS start_time, strftime(max(ts) + INTERVAL 24 HOUR, '{SQLT}') AS expires,
  max_by(status, (ts, event_id)) AS status, count(error_message) AS retry_count, count(*) AS updates
FROM spell GROUP BY document_id, no""")
def s5_expiring_status(spark, sf):
    """State per document and spell of activity; it expires a day after the last update."""
    r = s.sessions(b.status_events(spark, sf))
    return r.select("document_id", stamp("start_time"), stamp("expires"), "status", "retry_count", "updates")


@query(SPELLS + f""", e AS (SELECT document_id, no, max(ts) + INTERVAL 24 HOUR AS expires, count(*) AS updates FROM spell GROUP BY ALL)
SELECT document_id, strftime(expires, '{SQLT}') AS expires, updates FROM e
WHERE expires <= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)""")
def s5_expired_stream(spark, sf):
    """The states that a stream has dropped by the end of the table, with repeated events counted once.

    Watermarks are kept in milliseconds, as the ends of the spells are compared with them.
    """
    stream = runs.expiring_state(b.status_from_events(_stream(spark, sf)))
    out = spark.read.parquet(runs.run_to_table(stream, "append"))
    return out.select("document_id", stamp("expires"), "updates")


# Every third failure clears its document. A spell ends by a clearing or a pause of a day; rows are the last event of each spell.
TRACKED = STATUS + """, ev AS (SELECT *, 0 AS clears FROM status UNION ALL SELECT *, 1 FROM status WHERE status = 'failed' AND event_id % 3 = 0),
o AS (SELECT *, lag(ts) OVER w AS past, lag(clears) OVER w AS cleared, lead(ts) OVER w AS next FROM ev
  WINDOW w AS (PARTITION BY document_id ORDER BY ts, clears, event_id)),
spell AS (SELECT *, sum(CASE WHEN past IS NULL OR cleared = 1 OR ts - past >= INTERVAL 24 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY document_id ORDER BY ts, event_id) AS no FROM o WHERE clears = 0),
sums AS (SELECT document_id, no, min(ts) AS start_time, max(ts) FILTER (status IN ('completed', 'failed')) AS end_time,
  max_by(stage, (ts, event_id)) FILTER (stage IS NOT NULL) AS current_stage, count(error_message) AS retry_count, count(*) AS updates
  FROM spell GROUP BY ALL),
ends AS (SELECT s.document_id, s.no, status, progress, entities_processed, ts + INTERVAL 24 HOUR AS expires, next, ts AS last_at FROM spell s
  QUALIFY row_number() OVER (PARTITION BY s.document_id, s.no ORDER BY ts DESC, event_id DESC) = 1),
states AS (SELECT e.*, start_time, end_time, current_stage, retry_count, updates, CASE
    WHEN next IS NULL THEN CASE WHEN expires > (SELECT max(ts) FROM status) THEN 'live' ELSE 'expired' END
    WHEN next - last_at >= INTERVAL 24 HOUR THEN 'expired' ELSE 'ended' END AS kind FROM ends e JOIN sums USING (document_id, no))"""
SLICES = 3


def _tracked(spark, sf):
    """The folder of a tracker that has read the events in slices of time, with a restart after each of them."""
    schema = table(spark, sf, "events").schema
    events = table(spark, sf, "events")
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    width = ((high or 0) - (low or 0)) // SLICES + 1
    no = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low or 0)) / width)
    folder, parts = scratch_folder(spark, "slices"), scratch_folder(spark, "tracker")
    for i in range(SLICES):
        events.where(no == i).write.parquet(f"{folder}/slice-{i}")
        rows = b.status_from_events(runs.file_stream(spark, folder, schema, files_per_batch=10_000).withColumn("ts", F.col("ts").cast("timestamp")))
        again = b.status_from_events(runs.file_stream(spark, folder, schema, files_per_batch=10_000).withColumn("ts", F.col("ts").cast("timestamp")))
        tracker.run_tracker(tracker.track(rows, again.where("status = 'failed' AND event_id % 3 = 0")), parts, every=2)
    return parts


@query(TRACKED + f"""
SELECT document_id, status, progress, entities_processed, current_stage, retry_count, strftime(start_time, '{SQLT}') AS start_time,
  strftime(end_time, '{SQLT}') AS end_time, strftime(expires, '{SQLT}') AS expires, updates FROM states WHERE kind = 'live'""")
def s2_tracked_status(spark, sf):
    """The live states of a stream that expires and clears them, read from its compacted table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    t = tracker.live_states(spark, _tracked(spark, sf))
    return t.select("document_id", "status", "progress", "entities_processed", "current_stage", "retry_count",
                    stamp("start_time"), stamp("end_time"), stamp("expires"), "updates")


@query(TRACKED + f"""
SELECT document_id, status, strftime(expires, '{SQLT}') AS expires, retry_count, updates FROM states WHERE kind = 'expired'""")
def s5_tracked_expiry(spark, sf):
    """The states that have expired while the stream ran."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return tracker.expired_states(spark, _tracked(spark, sf)).select("document_id", "status", stamp("expires"), "retry_count", "updates")


@query(TRACKED + """, done AS (SELECT s.*, CAST(epoch_us(s.ts) - epoch_us(u.start_time) AS DOUBLE) / 1000000 AS t
  FROM spell s JOIN sums u USING (document_id, no) WHERE status = 'completed')
SELECT (SELECT count(*) FROM sums) AS total_documents, count(*) AS processed_documents,
  (SELECT count(*) FROM spell WHERE status = 'failed') AS failed_documents, CAST(sum(entities_processed) AS BIGINT) AS total_entities,
  CAST(sum(relationships_processed) AS BIGINT) AS total_relationships, round(avg(t), 3) AS average_processing_time,
  round(max(t), 3) AS peak_processing_time, round(count(*) / (SELECT count(*) FROM sums), 6) AS success_rate,
  round(avg(entities_processed), 6) AS average_entities_per_document, round(count(*) * 3600 / sum(t), 6) AS processing_speed,
  (SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT error_message || ':' || count(*) AS e FROM spell WHERE error_message IS NOT NULL
    GROUP BY error_message)) AS errors FROM done""")
def s6_tracked_metrics(spark, sf):
    """Processing metrics as the stream keeps them: sums of each batch, merged; a spell counts as a document."""
    folder = _tracked(spark, sf)
    e = tracker.running_errors(spark, folder).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "error_message", "errors"))), ";").alias("errors"))
    return tracker.running_metrics(spark, folder).select(
        e.scalar().alias("errors"), "total_documents", "processed_documents", "failed_documents", "total_entities", "total_relationships",
                    *[F.round(c, 3).alias(c) for c in ("average_processing_time", "peak_processing_time")],
                    *[F.round(c, 6).alias(c) for c in ("success_rate", "average_entities_per_document", "processing_speed")])


@query(STATUS + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, status, count(*) AS updates,
  CAST(sum(entities_processed) AS BIGINT) AS entities FROM status GROUP BY ALL""")
def s6_running_metrics_stream(spark, sf):
    stream = runs.running_counts(b.status_from_events(_stream(spark, sf)))
    t = runs.latest_rows(spark, runs.run_to_table(stream, "update"), ["start", "status"])
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "updates", "entities")


@query(STATUS + """, gone AS (SELECT document_id, max(ts) AS cleared_at FROM status WHERE status = 'failed' GROUP BY document_id),
rest AS (SELECT s.* FROM status s LEFT JOIN gone USING (document_id) WHERE cleared_at IS NULL OR ts > cleared_at), """
       + _now("rest") + " SELECT document_id, status, updates FROM now")
def s7_cleared_status(spark, sf):
    """Present states after every document was cleared at its last failure."""
    e = b.status_events(spark, sf)
    gone = e.filter("status = 'failed'").select("document_id", F.col("ts").alias("cleared_at"))
    return s.current(s.clear(e, gone)).select("document_id", "status", "updates")


@query(FACTS + """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, metric_type, count(*) AS facts, round(avg(value), 9) AS mean,
  round(min(value), 9) AS min, round(max(value), 9) AS max, round(stddev_samp(value), 9) AS std FROM facts GROUP BY ALL""")
def s8_metric_stream(spark, sf):
    stream = runs.metric_windows(b.facts_from_events(_stream(spark, sf)))
    t = runs.latest_rows(spark, runs.run_to_table(stream, "update"), ["start", "metric_type"])
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "metric_type", "facts",
                    *[F.round(c, 9).alias(c) for c in ("mean", "min", "max", "std")])


WATCHED = FACTS + """, ends AS (SELECT DISTINCT metric_type, date_trunc('day', ts) AS day FROM facts),
w AS (SELECT e.metric_type, e.day, avg(f.value) AS mean, stddev_pop(f.value) AS std FROM ends e JOIN facts f
  ON f.metric_type = e.metric_type AND f.ts >= e.day - INTERVAL 7 DAY AND f.ts < e.day GROUP BY ALL)
SELECT event_id, f.metric_type, value, round(mean, 9) AS mean, round(std, 9) AS std FROM facts f
JOIN w ON w.metric_type = f.metric_type AND w.day = date_trunc('day', f.ts) WHERE abs(value - mean) > 2 * std"""


@query(WATCHED)
def s9_anomaly_watch(spark, sf):
    """Facts far from the mean of the week before their day: sliding windows by one stream, watched by another."""
    slides = runs.sliding_windows(b.facts_from_events(_stream(spark, sf)))
    windows = runs.latest_rows(spark, runs.run_to_table(slides, "update"), ["start", "end", "metric_type"])
    facts = b.facts_from_events(_stream(spark, sf))
    out = spark.read.parquet(runs.run_to_table(runs.watch(facts, windows), "append"))
    return out.select("event_id", "metric_type", "value", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(WATCHED)
def s9_live_watch(spark, sf):
    """The same in one stream, which makes its own windows."""
    facts, same = (b.facts_from_events(_stream(spark, sf)) for _ in range(2))
    out = spark.read.parquet(runs.run_to_table(runs.watch_live(facts, same, late="0 seconds"), "append"))
    return out.select("event_id", "metric_type", "value", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(STATUS + f""", f AS (SELECT document_id, stage, min((ts, event_id)) AS f FROM status WHERE stage IS NOT NULL GROUP BY ALL),
g AS (SELECT document_id, stage, f, f[1] AS first_seen, lead(f[1]) OVER (PARTITION BY document_id ORDER BY f) AS next FROM f)
SELECT document_id, stage, strftime(first_seen, '{SQLT}') AS first_seen,
  round(CAST(epoch_us(next) - epoch_us(first_seen) AS DOUBLE) / 1000000, 6) AS seconds FROM g""")
def f9_stage_durations(spark, sf):
    return s.stage_durations(b.status_events(spark, sf)).select("document_id", "stage", stamp("first_seen"),
                                                                F.round("seconds", 6).alias("seconds"))


@query(STATUS + """, st AS (SELECT document_id, min(ts) AS start FROM status GROUP BY document_id),
d AS (SELECT s.*, CAST(epoch_us(s.ts) - epoch_us(st.start) AS DOUBLE) / 1000000 AS t FROM status s JOIN st USING (document_id)
  WHERE status = 'completed')
SELECT (SELECT count(*) FROM st) AS total_documents, count(*) AS processed_documents,
  (SELECT count(*) FROM status WHERE status = 'failed') AS failed_documents,
  CAST(sum(entities_processed) AS BIGINT) AS total_entities, CAST(sum(relationships_processed) AS BIGINT) AS total_relationships,
  round(avg(t), 3) AS average_processing_time, round(max(t), 3) AS peak_processing_time,
  round(count(*) / (SELECT count(*) FROM st), 6) AS success_rate,
  round(avg(entities_processed), 6) AS average_entities_per_document, round(count(*) * 3600 / sum(t), 6) AS processing_speed FROM d""")
def e13_processing_metrics(spark, sf):
    m = s.processing_metrics(b.status_events(spark, sf))
    return m.select("total_documents", "processed_documents", "failed_documents", "total_entities", "total_relationships",
                    F.round("average_processing_time", 3).alias("average_processing_time"),
                    F.round("peak_processing_time", 3).alias("peak_processing_time"),
                    *[F.round(c, 6).alias(c) for c in ("success_rate", "average_entities_per_document", "processing_speed")])


@query(STATUS + """ SELECT error_message, count(*) AS errors FROM status WHERE error_message IS NOT NULL GROUP BY ALL""")
def e13_error_counts(spark, sf):
    return s.error_counts(b.status_events(spark, sf))


PERIOD = ("2024-01-01 00:00:00", "2024-01-01 12:00:00")
STATES = STATUS + ", " + _now() + f""", st AS (SELECT *, CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) / 1000000 AS t
  FROM now WHERE start_time >= TIMESTAMP '{PERIOD[0]}' AND start_time <= TIMESTAMP '{PERIOD[1]}')"""


@query(STATES + """, r AS (SELECT count(*) AS n, count(*) FILTER (status = 'completed') AS c,
  count(*) FILTER (status = 'failed') AS f, coalesce(sum(t) FILTER (status = 'completed'), 0.0::DOUBLE) AS t FROM st)
SELECT n AS total_documents, c AS completed_documents, f AS failed_documents, round(t, 3) AS total_processing_time,
  round(CASE WHEN n > 0 THEN c / n ELSE 0 END, 6) AS success_rate,
  round(CASE WHEN c > 0 THEN t / c ELSE 0 END, 3) AS average_processing_time,
  round(CASE WHEN t > 0 THEN c * 3600 / t ELSE 0 END, 6) AS documents_per_hour FROM r""")
def e14_performance_report(spark, sf):
    p = s.performance(s.current(b.status_events(spark, sf)), *PERIOD)
    return p.select("total_documents", "completed_documents", "failed_documents",
                    *[F.round(c, 3).alias(c) for c in ("total_processing_time", "average_processing_time")],
                    *[F.round(c, 6).alias(c) for c in ("success_rate", "documents_per_hour")])


@query(STATUS + ", " + _now() + f""" SELECT stage, count(document_id) AS documents
FROM {sql.sql_values([(x,) for x in kinds.STAGES], 'g(stage)')} LEFT JOIN now ON current_stage = stage GROUP BY stage""")
def e14_stage_distribution(spark, sf):
    return s.stage_distribution(s.current(b.status_events(spark, sf)), frames.stages(spark))


@query(STATUS + ", " + _now() + """ SELECT last_error, count(*) AS documents FROM now
WHERE status = 'failed' AND last_error IS NOT NULL GROUP BY last_error""")
def e14_error_distribution(spark, sf):
    return s.error_distribution(s.current(b.status_events(spark, sf)))


@query(STATUS + """
SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(DISTINCT document_id) AS documents,
  count(*) FILTER (status = 'completed') AS processed_documents, count(*) FILTER (status = 'failed') AS failed_documents
FROM status WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM status) GROUP BY ALL""")
def e17_batch_history(spark, sf):
    return s.daily_runs(b.status_events(spark, sf), 7)
