"""Quality metrics: per entity and relationship, facts over time, scores, trends, anomalies, chart data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.catalog import quality
from ledgergraph.functions.ordering import first_n, places
from ledgergraph.operators import trends

SERIES = ["metric_type", "entity_type"]
ORDER = ["ts", "event_id"]


def subject_metrics(validated: DataFrame, checks: DataFrame) -> DataFrame:
    """Completeness, consistency and validity of each validated subject, and its missing fields."""
    need = checks.filter("check = 'required' AND enabled").groupBy("type").agg(F.count("*").alias("_need"))
    rows = validated.join(need, "type", "left").fillna(0, ["_need"])

    def n(*kinds: str) -> Column:
        return F.coalesce(F.size(F.filter("findings", lambda f: f["check"].isin(*kinds))), F.lit(0))
    total = F.coalesce(F.size("findings"), F.lit(0))

    def less(part: Column) -> Column:
        return F.when(total > 0, F.lit(1.0) - part / total).otherwise(1.0)
    missing = F.transform(F.filter("findings", lambda f: f["check"] == "required"), lambda f: f["field"])
    return rows.select(
        "id", F.when(F.col("_need") > 0, (F.col("_need") - n("required")) / F.col("_need")).otherwise(1.0).alias("completeness"),
        less(n("pattern")).alias("consistency"), less(n("range", "metric_range")).alias("validity"),
        F.array_sort(F.array_distinct(F.coalesce(missing, F.array().cast("array<string>")))).alias("missing"))


def endpoint_validity(edges: DataFrame, bad_ends: DataFrame) -> DataFrame:
    """1 minus half of the wrong ends of each edge; ``bad_ends`` are the findings on end points."""
    bad = bad_ends.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    return (edges.select("id", "type").join(bad, "id", "left")
            .select("id", "type", (F.lit(1.0) - F.coalesce("n", F.lit(0)) / 2).alias("endpoint_validity")))


def latest(facts: DataFrame) -> DataFrame:
    """The last fact of each series."""
    more = [c for c in ("details",) if c in facts.columns]
    last = F.max_by(F.struct("ts", "value", "threshold", "confidence_score", *more), F.struct(*ORDER))
    return facts.groupBy(*SERIES).agg(last.alias("z")).select(*SERIES, "z.*")


def score(last: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the metrics that are there, per entity type."""
    w = last.join(weights, "metric_type")
    return w.groupBy("entity_type").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("score"),
                                        F.count("*").alias("metrics"))


def trend(facts: DataFrame) -> DataFrame:
    return trends.summary(facts, SERIES, ORDER)


def last_points(facts: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` facts of each series."""
    return first_n(facts, SERIES, ["-ts", "-event_id"], n, F.col("event_id"))


def last_days(facts: DataFrame, days: int = 30) -> DataFrame:
    """The facts of the last days before the newest fact of the same series."""
    newest = facts.groupBy(*SERIES).agg(F.max("ts").alias("_newest"))
    return (facts.join(newest, SERIES).filter(F.col("ts") >= F.col("_newest") - F.make_interval(days=F.lit(days)))
            .drop("_newest"))


def anomalies(facts: DataFrame, spread: str = "population", times: float = 2.0) -> DataFrame:
    """Facts further than ``times`` standard deviations from the mean of their series, with the expected range.

    Means come from an aggregation and are joined back; a window would pull each series into one task.
    """
    std = {"population": F.stddev_pop, "sample": F.stddev_samp}[spread]
    stats = facts.groupBy(*SERIES).agg(F.avg("value").alias("mean"), std("value").alias("std"))
    rows = facts.join(stats, SERIES)
    off = F.col("value") - F.col("mean")
    return rows.filter(F.abs(off) > F.col("std") * times).select(
        "event_id", *SERIES, "ts", "value", (F.col("mean") - F.col("std") * times).alias("low"),
        (F.col("mean") + F.col("std") * times).alias("high"), off.alias("deviation"),
        (F.abs(off) / F.col("std")).alias("z_score"))


def benchmarks(facts: DataFrame) -> DataFrame:
    """Current, average, best and worst value of each series against its threshold."""
    last = F.max_by(F.struct("value", "threshold"), F.struct(*ORDER))
    out = facts.groupBy(*SERIES).agg(last.alias("z"), F.avg("value").alias("average"), F.max("value").alias("best"),
                                     F.min("value").alias("worst"))
    return out.select(*SERIES, F.col("z.value").alias("current"), "average", "best", "worst",
                      F.col("z.threshold").alias("threshold"),
                      F.when(F.col("z.value") >= F.col("z.threshold"), "good").otherwise("needs_improvement").alias("status"))


def impact(last: DataFrame, weights: DataFrame) -> DataFrame:
    """Metrics below their threshold: gap, weighted impact, place in the list of priorities of the entity type.

    A list holds at most one row per kind of metric, so the window is over a bounded group.
    """
    below = last.filter("value < threshold").join(weights, "metric_type", "left")
    rows = below.withColumn("gap", F.col("threshold") - F.col("value")).withColumn(
        "impact_score", F.col("gap") * F.coalesce("weight", F.lit(0.0)))
    w = Window.partitionBy("entity_type").orderBy(F.col("impact_score").desc(), "metric_type")
    total = F.sum("impact_score").over(Window.partitionBy("entity_type"))
    return rows.select(*SERIES, "value", "threshold", "gap", "impact_score", F.row_number().over(w).alias("priority"),
                       total.alias("total_impact"))


def recommendations(last: DataFrame) -> DataFrame:
    """Advice for the metrics that have one and the detail that it is about: action, urgency and the detail.

    ``last`` has the details of each metric as a map; advice without its detail is not given.
    """
    kind = F.col("metric_type")
    detail = reduce(lambda acc, a: F.when(kind == a[0], F.try_element_at("details", F.lit(a[1]))).otherwise(acc), quality.ADVICE, F.lit(None))
    action = reduce(lambda acc, a: F.when(kind == a[0], a[2]).otherwise(acc), quality.ADVICE, F.lit(None))
    cut = reduce(lambda acc, a: F.when(kind == a[0], a[3]).otherwise(acc), quality.ADVICE, F.lit(None).cast("double"))
    rows = last.filter("value < threshold").select(*SERIES, "value", action.alias("action"), detail.alias("detail"), cut.alias("_cut"))
    return (rows.filter("action IS NOT NULL AND detail IS NOT NULL AND detail <> ''").withColumn("urgency", F.when(F.col("value") < F.col("_cut"), "high").otherwise("medium"))
            .drop("_cut"))


def below_threshold(last: DataFrame) -> DataFrame:
    return last.filter("value < threshold").select(*SERIES, "value", "threshold")


def bucket(ts: Column, unit: str) -> Column:
    """Label of the hour, day, week (with its year) or month of a time."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
                        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])


def bucketed(facts: DataFrame, unit: str = "day") -> DataFrame:
    """Mean, least, greatest, spread (sample), confidence and bands per time bucket and metric."""
    out = facts.groupBy("metric_type", bucket(F.col("ts"), unit).alias("bucket")).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"), F.avg("confidence_score").alias("confidence"))
    return out.select("*", (F.col("mean") - F.col("std")).alias("lower"), (F.col("mean") + F.col("std")).alias("upper"))


def correlations(facts: DataFrame, unit: str = "hour") -> DataFrame:
    """Pearson correlation of every two metrics over the buckets that have both, in long form.

    Values are averaged per bucket first, so a bucket holds one row per kind of metric when it is joined to itself.
    """
    means = facts.groupBy("metric_type", bucket(F.col("ts"), unit).alias("at")).agg(F.avg("value").alias("v"))
    a = means.select(F.col("metric_type").alias("m1"), "at", F.col("v").alias("v1"))
    b = means.select(F.col("metric_type").alias("m2"), "at", F.col("v").alias("v2"))
    return a.join(b, "at").groupBy("m1", "m2").agg(F.corr("v1", "v2").alias("correlation"), F.count("*").alias("points"))


def correlation_network(corr: DataFrame, least: float = 0.5) -> DataFrame:
    """The pairs of different metrics, each once, that go together more than ``least`` either way."""
    return corr.filter((F.col("m1") < F.col("m2")) & (F.abs("correlation") > least)).select("m1", "m2", "correlation")


def heat_map(facts: DataFrame) -> DataFrame:
    """Mean value by day of the week and hour."""
    return facts.groupBy(F.date_format("ts", "EEEE").alias("day"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"))


def heat_map_wide(facts: DataFrame) -> DataFrame:
    """The same with one column per hour."""
    day = F.date_format("ts", "EEEE").alias("day")
    return facts.withColumn("hour", F.hour("ts")).groupBy(day).pivot("hour", list(range(24))).agg(F.avg("value"))


def hierarchy(facts: DataFrame) -> DataFrame:
    """Number and mean of facts by metric, by metric and entity type, and in all."""
    return facts.rollup(*SERIES).agg(F.count("*").alias("facts"), F.avg("value").alias("mean")).select(
        F.coalesce("metric_type", F.lit("all")).alias("metric_type"),
        F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "facts", "mean")


def category_codes(facts: DataFrame) -> DataFrame:
    """A dense code per metric type with the first and last time. The window runs over the distinct types only."""
    kinds = facts.groupBy("metric_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return kinds.withColumn("code", F.dense_rank().over(Window.orderBy("metric_type")) - 1)


def quartiles(facts: DataFrame, keys: tuple[str, ...] = ("metric_type",)) -> DataFrame:
    """Exact quartiles of each group, from the places of the values in order (linear between neighbours)."""
    ks = list(keys)
    ordered = places(facts.select(*ks, "value", "event_id"), ks, ["value", "event_id"], "place")
    sizes = ordered.groupBy(*ks).agg(F.max("place").alias("n"))
    rows = ordered.join(sizes, ks)
    out = []
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("n") - 1) * q
        low, high = F.floor(at), F.ceil(at)
        share = at - low
        weight = F.when(low == high, F.when(F.col("place") - 1 == low, 1.0)).when(F.col("place") - 1 == low, F.lit(1.0) - share) \
            .when(F.col("place") - 1 == high, share)
        out.append(F.sum(F.col("value") * weight).alias(name))
    return rows.groupBy(*ks).agg(F.min("value").alias("min"), *out, F.max("value").alias("max"))


def quartiles_approximate(facts: DataFrame, keys: tuple[str, ...] = ("metric_type",)) -> DataFrame:
    q = F.approx_percentile("value", [0.25, 0.5, 0.75], 10000)
    return facts.groupBy(*keys).agg(F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max")).select(
        *keys, "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "max")


def report(facts: DataFrame, weights: DataFrame) -> dict[str, DataFrame]:
    """The parts of the quality report and of the dashboard, one table per panel."""
    last = latest(facts)
    return {"score": score(last, weights), "metrics": last, "trends": trend(facts),
            "correlations": correlations(facts), "below_threshold": below_threshold(last),
            "anomalies": anomalies(facts), "distribution": quartiles(facts), "benchmarks": benchmarks(facts)}


# What each panel shows: the columns that name an item, and the number beside it.
PANELS = {"score": (["entity_type"], "score"), "metrics": (SERIES, "value"), "trends": (SERIES, "trend"), "correlations": (["m1", "m2"], "correlation"),
          "below_threshold": (SERIES, "value"), "anomalies": (["event_id"], "deviation"), "distribution": (["metric_type"], "median"),
          "benchmarks": (SERIES, "average")}


def panel_rows(facts: DataFrame, weights: DataFrame) -> DataFrame:
    """All panels of the dashboard in long form: panel, item, value."""
    parts = report(facts, weights)
    return reduce(DataFrame.unionByName, [
        parts[panel].select(F.lit(panel).alias("panel"), F.concat_ws("|", *keys).alias("item"), F.col(value).cast("double").alias("value"))
        for panel, (keys, value) in PANELS.items()])


def panel_counts(facts: DataFrame, weights: DataFrame) -> DataFrame:
    """Number of rows of each dashboard panel."""
    parts = [df.agg(F.count("*").alias("items")).select(F.lit(name).alias("panel"), "items")
             for name, df in report(facts, weights).items()]
    return reduce(DataFrame.unionByName, parts)
