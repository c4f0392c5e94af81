"""Trends of metrics over time, for one entity and for an industry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.functions.ordering import places, slopes
from ledgergraph.functions.values import get, number
from ledgergraph.session import checkpoint


def metric_points(edges: DataFrame) -> DataFrame:
    """The points on HAS_METRIC edges: entity, metric, ts, value, edge_id. Empty and zero values are left out."""
    props = F.col("properties")
    points = edges.filter(F.col("type") == "HAS_METRIC").select(
        F.col("src").alias("entity"), get(props, "type").alias("metric"), get(props, "timestamp").alias("ts"),
        number(get(props, "value")).alias("value"), F.col("id").alias("edge_id"))
    return points.filter((F.col("metric") != "") & (F.col("ts") != "") & (F.col("value") != 0))


def trailing(df: DataFrame, ts: Column, period: str) -> DataFrame:
    """Rows of the last "1y", "6m", "30d", … before the newest row of the table."""
    n, unit = re.fullmatch(r"(\d+)([ymd])", period).groups()
    span = F.make_interval(**{{"y": "years", "m": "months", "d": "days"}[unit]: F.lit(int(n))})
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(ts >= newest - span)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(0.0)


def summary(points: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Current, least, greatest, mean, spread (population), slope, growth and volatility of each series."""
    at = F.struct(*order)
    first, last = F.min_by(value, at), F.max_by(value, at)
    stats = points.groupBy(*keys).agg(
        F.count("*").alias("points"), last.alias("current_value"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.avg(value).alias("avg_value"), F.stddev_pop(value).alias("std_dev"),
        first.alias("_first"))
    stats = stats.select("*", _ratio(F.col("current_value") - F.col("_first"), F.col("_first")).alias("growth_rate"),
                         _ratio(F.col("std_dev"), F.col("avg_value")).alias("volatility")).drop("_first")
    return stats.join(slopes(points, keys, order, value).withColumnRenamed("slope", "trend"), keys)


def timeline(points: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Every point of every series with its place in time order, one row each."""
    return places(points.select(*keys, *order, value), keys, order, "place")


def industry_points(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Metric points of companies with the industry and the name of the company."""
    companies = vertices.filter("type = 'Company'").select(
        F.col("id").alias("entity"), "name", get(F.col("properties"), "industry").alias("industry"))
    return points.join(companies.filter("industry IS NOT NULL"), "entity")


def industry_trend(points: DataFrame) -> DataFrame:
    """Mean, slope and volatility of the industry means per timestamp: industry, metric, …"""
    keys = ["industry", "metric"]
    # The means are read three times below (statistics, sampling for the sort, sort) and are far fewer than the points.
    means = checkpoint(points.groupBy(*keys, "ts").agg(F.avg("value").alias("mean")))
    stats = means.groupBy(*keys).agg(F.count("*").alias("timestamps"), F.avg("mean").alias("industry_average"),
                                     F.stddev_pop("mean").alias("_std"))
    stats = stats.withColumn("volatility", _ratio(F.col("_std"), F.col("industry_average"))).drop("_std")
    return stats.join(slopes(means, keys, ["ts"], "mean").withColumnRenamed("slope", "industry_trend"), keys)


def industry_timeline(points: DataFrame) -> DataFrame:
    return points.groupBy("industry", "metric", "ts").agg(F.avg("value").alias("average"))


def industry_ranking(points: DataFrame) -> DataFrame:
    """Companies at the newest timestamp of their industry and metric, ranked by value, then id."""
    keys = ["industry", "metric"]
    newest = points.groupBy(*keys).agg(F.max("ts").alias("ts"))
    latest = points.join(newest, [*keys, "ts"]).select(*keys, "entity", "name", "ts", "value", "edge_id")
    return places(latest, keys, ["-value", "entity", "edge_id"], "rank").drop("edge_id")
