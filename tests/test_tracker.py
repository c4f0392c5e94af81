"""The status tracker over restarts: expiry, clearing, late events, bounded state, compacted tables."""

import datetime as dt

from pyspark.sql import functions as F

from ledgergraph.streaming import runs, tracker

SCHEMA = "document_id string, event_id long, ts timestamp, status string, stage string, progress double, entities_processed long, relationships_processed long, error_message string"
START = dt.datetime(2024, 1, 1)


def event(doc, no, hours, status="processing", entities=1, error=None, stage=None):
    return (doc, no, START + dt.timedelta(hours=hours), status, stage, 0.5, entities, 2, error)


def test_tracker(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = str(tmp_path / "in")
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [event("a", 1, 0, "pending"), event("a", 2, 2, "completed", 5), event("b", 3, 1, error="x; 1:y"), event("gone", 4, 1)],
        [event("a", 5, 10, "failed", error="x; 1:y"), event("gone", 6, 12, "cleared"), event("late", 7, 13, stage="graph_storage")],
        [event("late", 8, 14, "completed", 7), event("gone", 9, 11), event("gone", 10, 15, "completed", 3)],
        [event(f"d{i}", 100 + i, 60 + i / 100) for i in range(50)],
        [event(f"e{i}", 200 + i, 120 + i / 100) for i in range(50)]]
    out = str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        source, other = (runs.file_stream(spark, folder, schema) for _ in range(2))
        stream = tracker.track(source.where("status <> 'cleared'"), other.where("status = 'cleared'").select("document_id", "ts"), late="2 hours")
        tracker.run_tracker(stream, out, every=2)
        if i == 2:
            live = {r.document_id: r for r in tracker.live_states(spark, out).collect()}
            assert set(live) == {"a", "b", "late", "gone"}
            assert (live["a"].status, live["a"].retry_count, live["a"].updates) == ("failed", 1, 3)
            assert (live["gone"].status, live["gone"].updates, live["gone"].start_time) == ("completed", 1, START + dt.timedelta(hours=15))
            assert (live["late"].current_stage, live["late"].status) == ("graph_storage", "completed")
    live = {r.document_id for r in tracker.live_states(spark, out).collect()}
    assert live == {f"e{i}" for i in range(50)}
    expired = {(r.document_id, r.updates) for r in tracker.expired_states(spark, out).collect()}
    assert expired == {("a", 3), ("b", 1), ("late", 2), ("gone", 1)} | {(f"d{i}", 1) for i in range(50)}
    m = tracker.running_metrics(spark, out).first()
    assert (m.total_documents, m.processed_documents, m.failed_documents, m.total_entities) == (105, 3, 1, 15)
    assert (m.average_processing_time, m.peak_processing_time) == (3600.0, 7200.0)
    assert {r.error_message: r.errors for r in tracker.running_errors(spark, out).collect()} == {"x; 1:y": 2}
    # what the store keeps is the documents of a day, not all that ever came
    kept = spark.read.format("statestore").option("stateVarName", "state").load(f"{out}/checkpoint").count()
    assert kept == 50
    upto, base = runs._newest_base(spark, f"{out}/table")
    assert base is not None and upto >= 3
    plain = spark.read.parquet(f"{out}/table").groupBy("document_id").agg(F.max_by("kind", F.struct("batch", F.col("kind") != "expired")).alias("kind"))
    assert {r.document_id for r in plain.where("kind = 'live'").collect()} == live
    tracker.run_tracker(tracker.track(runs.file_stream(spark, folder, schema).where("status <> 'cleared'"), runs.file_stream(spark, folder, schema).where("status = 'cleared'"), late="2 hours"), out)
    assert {r.document_id for r in tracker.live_states(spark, out).collect()} == live


def test_compaction(spark, tmp_path):
    folder = str(tmp_path / "table")
    for batch in range(6):
        spark.range(batch, batch + 3).select(F.col("id").alias("k"), F.lit(batch).alias("v")).write.parquet(f"{folder}/batch={batch}")
        want = {i: min(i, batch) for i in range(batch + 3)}
        if batch % 2:
            runs.compact(spark, folder, ["k"])
            runs.compact(spark, folder, ["k"])
        assert {r.k: r.v for r in runs.latest_rows(spark, folder, ["k"]).collect()} == want
    read = runs.latest_rows(spark, folder, ["k"])
    assert read.count() == 8 and all("batch=0" not in f for f in read.where("k >= 0").inputFiles() if "batch=5" in f)


def test_events_of_a_group_in_order():
    """Plain lists in the order of times, events before clearings, ids; the frames of a group may differ in their types."""
    import pandas as pd

    columns = [*tracker.USED, "ts"]
    a = pd.DataFrame([[5, True, 1, "failed", None, 0.5, float("nan"), 1, "x", pd.NaT], [5, False, 9, "pending", "s", None, 3.0, None, None, pd.NaT]], columns=columns)
    b = pd.DataFrame([[4, False, 7, "completed", None, 1.0, 2, 2, None, pd.NaT], [5, False, 8, "failed", None, 1.0, 2, 2, None, pd.NaT]], columns=columns)
    got = tracker._in_order(iter([a, b]))
    assert [(e["at"], e["clears"], e["event_id"]) for e in got] == [(4, False, 7), (5, False, 8), (5, False, 9), (5, True, 1)]
    assert got[3]["entities_processed"] is None and got[2]["progress"] is None and got[2]["entities_processed"] == 3
    assert all(set(e) == set(tracker.USED) for e in got)
