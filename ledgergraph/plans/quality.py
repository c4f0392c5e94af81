"""Queries on quality metrics (I), their trends and anomalies (F3-F7), and the validation summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgergraph.catalog import frames, rules
from ledgergraph.catalog.quality import ADVICE, METRIC_WEIGHTS
from ledgergraph.operators import quality as q
from ledgergraph.operators import sketches
from ledgergraph.operators import validation as v
from ledgergraph.plans import sql
from ledgergraph.plans.graph import near
from ledgergraph.plans.registry import query
from ledgergraph.plans.validation import CHECKS, ENDPOINTS, ENTITIES, RELATIONSHIPS
from ledgergraph.session import scratch_folder
from ledgergraph.sources import bindings as b

FACTS = f"WITH {sql.EVENT_FACTS}"
WEIGHTS = "weights AS (SELECT * FROM " + sql.sql_values(list(METRIC_WEIGHTS.items()), "w(metric_type, weight)") + ")"
LATEST = FACTS + f""", {WEIGHTS}, last AS (SELECT * FROM facts
  QUALIFY row_number() OVER (PARTITION BY metric_type, entity_type ORDER BY ts DESC, event_id DESC) = 1)"""
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _facts(spark, sf):
    return b.metric_facts(spark, sf)


def stamp(c):
    return F.date_format(c, STAMP).alias(c)


def _subject_sql(subjects: str) -> str:
    return f""", need AS (SELECT type, count(*) AS need FROM checks WHERE "check" = 'required' AND enabled AND kind {{}}
  GROUP BY type),
m AS (SELECT s.id, coalesce(any_value(need), 0) AS need, count(f.rule) AS n,
    count(f.rule) FILTER ("check" = 'required') AS missing, count(f.rule) FILTER ("check" = 'pattern') AS patterns,
    count(f.rule) FILTER ("check" IN ('range', 'metric_range')) AS ranges,
    coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER ("check" = 'required'), '') AS missing_fields
  FROM {subjects} s LEFT JOIN need USING (type) LEFT JOIN found f ON f.subject_id = s.id GROUP BY s.id)
SELECT id, round(CASE WHEN need > 0 THEN (need - missing) / need ELSE 1 END, 6) AS completeness,
  round(CASE WHEN n > 0 THEN 1 - patterns / n ELSE 1 END, 6) AS consistency,
  round(CASE WHEN n > 0 THEN 1 - ranges / n ELSE 1 END, 6) AS validity, missing_fields FROM m"""


def _rounded(m):
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("completeness", "consistency", "validity")],
                    F.array_join("missing", ",").alias("missing_fields"))


@query(ENTITIES + _subject_sql("vertices").format("IN ('entity', 'domain')"))
def i1_entity_quality(spark, sf):
    checks = frames.rule_checks(spark)
    valid = v.validate_entities(b.vertices(spark, sf), checks)
    return _rounded(q.subject_metrics(valid, checks.filter("kind <> 'relationship'")))


@query(RELATIONSHIPS + _subject_sql("edges").format("= 'relationship'"))
def i2_relationship_quality(spark, sf):
    checks = frames.rule_checks(spark)
    valid = v.validate_relationships(b.edges(spark, sf), checks)
    return _rounded(q.subject_metrics(valid, checks.filter("kind = 'relationship'")))


@query(ENDPOINTS + """, bad AS (SELECT id, CAST(st <> source_type AS INTEGER) + CAST(dt <> target_type AS INTEGER) AS n FROM ends)
SELECT type, 1 - coalesce(bad.n, 0) / 2 AS endpoint_validity, count(*) AS edges FROM edges LEFT JOIN bad USING (id)
GROUP BY ALL""")
def i2_endpoint_validity(spark, sf):
    edges = b.edges(spark, sf)
    bad = v.wrong_endpoints(edges, b.vertices(spark, sf), frames.rule_catalogue(spark))
    return (q.endpoint_validity(edges, bad).groupBy("type", "endpoint_validity").agg(F.count("*").alias("edges")))


@query(LATEST + """
SELECT metric_type, entity_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, threshold, confidence_score FROM last""")
def i3_latest_metrics(spark, sf):
    return q.latest(_facts(spark, sf)).withColumn("ts", stamp("ts"))


@query(LATEST + """
SELECT entity_type, round(sum(value * weight) / sum(weight), 9) AS score, count(*) AS metrics
FROM last JOIN weights USING (metric_type) GROUP BY entity_type""")
def i4_quality_score(spark, sf):
    return q.score(q.latest(_facts(spark, sf)), frames.metric_weights(spark)).withColumn("score", F.round("score", 9))


@query(LATEST + """
SELECT metric_type, entity_type, value, threshold FROM last WHERE value < threshold""")
def i5_below_threshold(spark, sf):
    """The list of weak metrics in the quality report."""
    return q.below_threshold(q.latest(_facts(spark, sf)))


@query(LATEST + """, i AS (SELECT *, threshold - value AS gap, (threshold - value) * weight AS impact_score
  FROM last LEFT JOIN weights USING (metric_type) WHERE value < threshold)
SELECT metric_type, entity_type, round(gap, 9) AS gap, round(impact_score, 9) AS impact_score,
  row_number() OVER (PARTITION BY entity_type ORDER BY impact_score DESC, metric_type) AS priority,
  round(sum(impact_score) OVER (PARTITION BY entity_type), 9) AS total_impact FROM i""")
def i6_impact(spark, sf):
    i = q.impact(q.latest(_facts(spark, sf)), frames.metric_weights(spark))
    return i.select("metric_type", "entity_type", "priority",
                    *[F.round(c, 9).alias(c) for c in ("gap", "impact_score", "total_impact")])


@query(LATEST + f"""
SELECT metric_type, entity_type, action, 'k=' || CAST(round(confidence_score * 100) AS INTEGER) AS detail,
  CASE WHEN value < cut THEN 'high' ELSE 'medium' END AS urgency
FROM last JOIN {sql.sql_values([(a, c, d) for a, _, c, d in ADVICE], 'a(metric_type, action, cut)')} USING (metric_type)
WHERE value < threshold AND CAST(round(confidence_score * 100) AS INTEGER) % 2 = 0""")
def i7_recommendations(spark, sf):
    """Advice on the weak metrics whose facts have the detail that it needs."""
    return q.recommendations(q.latest(b.detailed_facts(spark, sf))).drop("value")


@query(FACTS + """
SELECT metric_type, count(*) AS facts, TRUE AS quartiles_within, TRUE AS entities_within FROM facts
WHERE value IS NOT NULL GROUP BY metric_type""")
def i14_merged_sketches(spark, sf):
    """Quartiles and distinct events from sketches that were stored per day and merged, held against the whole table."""
    facts = _facts(spark, sf).where("value IS NOT NULL")
    folder = scratch_folder(spark, "sketches")
    sketches.daily(facts, ["metric_type"], "value", "event_id").write.parquet(folder)
    merged = sketches.merged(spark.read.parquet(folder), ["metric_type"])
    return sketches.held_against(merged, facts, ["metric_type"], "value", "event_id").select("metric_type", "facts", "quartiles_within", "entities_within")


def _bucket_query(name: str, unit: str, fmt: str) -> None:
    def fn(spark, sf):
        r = q.bucketed(_facts(spark, sf), unit)
        return r.select("metric_type", "bucket", *[F.round(c, 9).alias(c) for c in
                                                   ("mean", "min", "max", "std", "confidence", "lower", "upper")])
    fn.__name__, fn.__doc__ = name, f"Metric statistics per {unit}."
    query(FACTS + f"""
SELECT metric_type, {fmt} AS bucket, round(avg(value), 9) AS mean, round(min(value), 9) AS min, round(max(value), 9) AS max,
  round(stddev_samp(value), 9) AS std, round(avg(confidence_score), 9) AS confidence,
  round(avg(value) - stddev_samp(value), 9) AS lower, round(avg(value) + stddev_samp(value), 9) AS upper
FROM facts GROUP BY ALL""")(fn)


_bucket_query("i8_by_hour", "hour", "strftime(ts, '%Y-%m-%d %H')")
_bucket_query("i8_by_day", "day", "strftime(ts, '%Y-%m-%d')")
_bucket_query("i8_by_week", "week", "strftime(ts, '%G-W%V')")
_bucket_query("i8_by_month", "month", "strftime(ts, '%Y-%m')")

CORR = FACTS + """, h AS (SELECT metric_type, strftime(ts, '%Y-%m-%d %H') AS here, avg(value) AS v FROM facts GROUP BY ALL),
c AS (SELECT a.metric_type AS m1, b.metric_type AS m2, corr(a.v, b.v) AS correlation, count(*) AS points
  FROM h a JOIN h b USING (here) GROUP BY ALL)"""


@query(CORR + " SELECT m1, m2, round(correlation, 9) AS correlation, points FROM c")
def i9_correlations(spark, sf):
    return q.correlations(_facts(spark, sf)).withColumn("correlation", F.round("correlation", 9))


@query(CORR + " SELECT m1, m2, round(correlation, 9) AS correlation FROM c WHERE m1 < m2 AND abs(correlation) > 0.01")
def i10_correlation_network(spark, sf):
    net = q.correlation_network(q.correlations(_facts(spark, sf)), 0.01)
    return net.withColumn("correlation", F.round("correlation", 9))


@query(FACTS + " SELECT dayname(ts) AS day, hour(ts) AS hour, round(avg(value), 9) AS mean FROM facts GROUP BY ALL")
def i11_heat_map(spark, sf):
    return q.heat_map(_facts(spark, sf)).withColumn("mean", F.round("mean", 9))


@query(FACTS + """
SELECT coalesce(metric_type, 'all') AS metric_type, coalesce(entity_type, 'all') AS entity_type, count(*) AS facts,
  round(avg(value), 9) AS mean FROM facts GROUP BY ROLLUP (metric_type, entity_type)""")
def i12_hierarchy(spark, sf):
    return q.hierarchy(_facts(spark, sf)).withColumn("mean", F.round("mean", 9))


@query(FACTS + """
SELECT metric_type, CAST(dense_rank() OVER (ORDER BY metric_type) - 1 AS INTEGER) AS code,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last
FROM facts GROUP BY metric_type""")
def i13_category_codes(spark, sf):
    return q.category_codes(_facts(spark, sf)).select("metric_type", "code", stamp("first"), stamp("last"))


@query(FACTS + """
SELECT metric_type, min(value) AS min, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median,
  round(quantile_cont(value, 0.75), 9) AS q3, max(value) AS max FROM facts GROUP BY metric_type""")
def i14_quartiles(spark, sf):
    r = q.quartiles(_facts(spark, sf))
    return r.select("metric_type", "min", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3")], "max")


@query(LATEST + """, s AS (SELECT metric_type, entity_type, avg(value) AS a, stddev_pop(value) AS d FROM facts GROUP BY ALL),
h AS (SELECT metric_type, strftime(ts, '%Y-%m-%d %H') AS here, avg(value) AS v FROM facts GROUP BY ALL)
SELECT 'score' AS panel, count(DISTINCT entity_type) AS items FROM last
UNION ALL SELECT 'metrics', count(*) FROM last
UNION ALL SELECT 'trends', count(*) FROM s
UNION ALL SELECT 'correlations', count(DISTINCT (a.metric_type, b.metric_type)) FROM h a JOIN h b USING (here)
UNION ALL SELECT 'below_threshold', count(*) FROM last WHERE value < threshold
UNION ALL SELECT 'anomalies', count(*) FROM facts JOIN s USING (metric_type, entity_type) WHERE abs(value - a) > 2 * d
UNION ALL SELECT 'distribution', count(DISTINCT metric_type) FROM facts
UNION ALL SELECT 'benchmarks', count(*) FROM s""")
def i15_dashboard(spark, sf):
    return q.panel_counts(_facts(spark, sf), frames.metric_weights(spark))


@query(LATEST + """, st AS (SELECT metric_type, entity_type, avg(value) AS a, stddev_pop(value) AS d FROM facts GROUP BY ALL),
hr AS (SELECT metric_type, strftime(ts, '%Y-%m-%d %H') AS here, avg(value) AS v FROM facts GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY metric_type, entity_type ORDER BY ts, event_id) - 1 AS idx FROM facts),
panels AS (
  SELECT 'score' AS panel, entity_type AS item, sum(value * weight) / sum(weight) AS value FROM last JOIN weights USING (metric_type) GROUP BY entity_type
  UNION ALL SELECT 'metrics', metric_type || '|' || entity_type, value FROM last
  UNION ALL SELECT 'trends', metric_type || '|' || entity_type, CASE WHEN count(*) > 1 THEN regr_slope(value, idx) END FROM n GROUP BY metric_type, entity_type
  UNION ALL SELECT 'correlations', x.metric_type || '|' || y.metric_type, corr(x.v, y.v) FROM hr x JOIN hr y USING (here) GROUP BY x.metric_type, y.metric_type
  UNION ALL SELECT 'below_threshold', metric_type || '|' || entity_type, value FROM last WHERE value < threshold
  UNION ALL SELECT 'anomalies', CAST(event_id AS VARCHAR), value - a FROM facts JOIN st USING (metric_type, entity_type) WHERE abs(value - a) > 2 * d
  UNION ALL SELECT 'distribution', metric_type, quantile_cont(value, 0.5) FROM facts GROUP BY metric_type
  UNION ALL SELECT 'benchmarks', metric_type || '|' || entity_type, a FROM st)
SELECT panel, item, round(value, 8) AS value FROM panels""")
def i15_dashboard_rows(spark, sf):
    """What the panels of the dashboard show."""
    return q.panel_rows(_facts(spark, sf), frames.metric_weights(spark)).withColumn("value", F.round("value", 8))


@query(FACTS + """
SELECT entity_type, metric_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, confidence_score FROM facts""")
def i16_metric_series(spark, sf):
    """History in long form, as the bar, radar and three-axis charts take it."""
    return _facts(spark, sf).select("entity_type", "metric_type", stamp("ts"), "value", "confidence_score")


@query(FACTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY metric_type, entity_type ORDER BY ts, event_id) - 1 AS idx
  FROM facts)
SELECT metric_type, entity_type, count(*) AS points, max_by(value, idx) AS current_value, min(value) AS min_value,
  max(value) AS max_value, round(avg(value), 9) AS avg_value, round(stddev_pop(value), 9) AS std_dev,
  round(CASE WHEN count(*) > 1 THEN regr_slope(value, idx) END, 9) AS trend FROM n GROUP BY ALL""")
def f3_quality_trend(spark, sf):
    r = q.trend(_facts(spark, sf))
    return r.select("metric_type", "entity_type", "points", "current_value", "min_value", "max_value",
                    *[F.round(c, 9).alias(c) for c in ("avg_value", "std_dev", "trend")])


@query(FACTS + """
SELECT metric_type, entity_type, event_id, value, row_number() OVER (PARTITION BY metric_type, entity_type
  ORDER BY ts DESC, event_id DESC) AS position FROM facts QUALIFY position <= 30""")
def f4_last_points(spark, sf):
    return q.last_points(_facts(spark, sf)).select("metric_type", "entity_type", "event_id", "value",
                                                   F.col("position").cast("long").alias("position"))


@query(FACTS + """
SELECT metric_type, entity_type, event_id, value FROM (SELECT *, max(ts) OVER (PARTITION BY metric_type, entity_type) AS newest
  FROM facts) WHERE ts >= newest - INTERVAL 10 DAY""")
def f4_last_days(spark, sf):
    return q.last_days(_facts(spark, sf), 10).select("metric_type", "entity_type", "event_id", "value")


def _anomaly_sql(std: str) -> str:
    return FACTS + f""", s AS (SELECT metric_type, entity_type, avg(value) AS a, {std}(value) AS d FROM facts GROUP BY ALL)
SELECT event_id, metric_type, entity_type, value, round(a - 2 * d, 9) AS low, round(a + 2 * d, 9) AS high,
  round(value - a, 9) AS deviation, round(abs(value - a) / d, 6) AS z_score
FROM facts JOIN s USING (metric_type, entity_type) WHERE abs(value - a) > 2 * d"""


def _anomalies(spark, sf, spread):
    a = q.anomalies(_facts(spark, sf), spread)
    return a.select("event_id", "metric_type", "entity_type", "value",
                    *[F.round(c, 9).alias(c) for c in ("low", "high", "deviation")], F.round("z_score", 6).alias("z_score"))


@query(_anomaly_sql("stddev_pop"))
def f5_anomalies(spark, sf):
    return _anomalies(spark, sf, "population")


@query(_anomaly_sql("stddev_samp"))
def f6_anomalies_by_z_score(spark, sf):
    return _anomalies(spark, sf, "sample")


@query(LATEST + """, s AS (SELECT metric_type, entity_type, avg(value) AS average, max(value) AS best, min(value) AS worst
  FROM facts GROUP BY ALL)
SELECT metric_type, entity_type, value AS current, round(average, 9) AS average, best, worst, threshold,
  CASE WHEN value >= threshold THEN 'good' ELSE 'needs_improvement' END AS status FROM last JOIN s USING (metric_type, entity_type)""")
def f7_benchmarks(spark, sf):
    return q.benchmarks(_facts(spark, sf)).withColumn("average", F.round("average", 9))


@query(LATEST + f""", r AS (SELECT * FROM {sql.sql_values(rules.rule_rows(),
    'r(rule, kind, type, domain, source_type, target_type, enabled)')})
SELECT entity_type, round(sum(value * weight) / sum(weight), 9) AS score,
  (SELECT count(*) FROM r WHERE kind <> 'relationship') AS entity_rules,
  (SELECT count(*) FROM r WHERE kind = 'relationship') AS relationship_rules
FROM last JOIN weights USING (metric_type) GROUP BY entity_type""")
def e16_validation_summary(spark, sf):
    """Quality score with the number of rules behind it."""
    r = frames.rule_catalogue(spark)
    return q.score(q.latest(_facts(spark, sf)), frames.metric_weights(spark)).select(
        "entity_type", F.round("score", 9).alias("score"),
        r.filter("kind <> 'relationship'").agg(F.count("*")).scalar().alias("entity_rules"),
        r.filter("kind = 'relationship'").agg(F.count("*")).scalar().alias("relationship_rules"))
