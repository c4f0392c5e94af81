"""Sketches that can be stored and merged: quantiles and distinct counts per day, rolled up without the rows.

A quantile sketch (KLL, k = 200) is right to within 1.7 per cent of the rank, a distinct count (HyperLogLog with 2^12
registers) to within 1.6 per cent, one standard error each; ``held_against`` allows three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
RANK_ERROR, COUNT_ERROR = 0.05, 0.05


def daily(facts: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """keys, day, rows, values (quantile sketch), items (distinct-count sketch): one row per key and day."""
    return facts.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.count("*").alias("rows"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"), F.hll_sketch_agg(item).alias("items"))


def merged(days: DataFrame, keys: list[str]) -> DataFrame:
    """keys, facts, quartiles, entities of any number of stored days."""
    sums = days.groupBy(*keys).agg(F.sum("rows").alias("facts"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("items").alias("items"))
    quartiles = F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(q) for q in QUARTILES]))
    return sums.select(*keys, "facts", quartiles.alias("quartiles"), F.hll_sketch_estimate("items").alias("entities"))


def held_against(estimates: DataFrame, facts: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """The estimates with whether they are within their errors: the share of the rows up to each quartile, and the distinct items."""
    rows = facts.join(estimates, keys)
    upto = [(F.count_if(F.col(value) <= F.col("quartiles")[i]) / F.count("*"), F.count_if(F.col(value) < F.col("quartiles")[i]) / F.count("*")) for i in range(3)]
    near = [(a >= q - RANK_ERROR) & (b <= q + RANK_ERROR) for (a, b), q in zip(upto, QUARTILES)]
    distinct = F.count_distinct(item)
    return rows.groupBy(*keys, "facts", "quartiles", "entities").agg(
        (near[0] & near[1] & near[2]).alias("quartiles_within"),
        (F.abs(F.first("entities") - distinct) <= F.greatest(distinct * COUNT_ERROR, F.lit(1.0))).alias("entities_within"))
