"""Order numbers and slopes inside groups of any size.

A window over a group pulls the group into one task, and one group may hold a third of the table. Here the
table is sorted as a whole by (keys, order): the range partitioning behind the sort spreads a large group over
many tasks. A row's number in its partition plus the number of rows of its group in earlier partitions is its
place in the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.session import checkpoint

GROUP_LIMIT = 500  # Spark limits groups before the shuffle up to spark.sql.optimizer.windowGroupLimitThreshold, 1000
_SHIFT = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def directions(order: list[str]) -> list[Column]:
    """Sort columns from names; a leading minus means descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _sorted_slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ordered = df.orderBy(*[F.col(k) for k in keys], *directions(order)).withColumn("_id", F.monotonically_increasing_id())
    return (ordered.withColumn("_slice", F.shiftright("_id", _SHIFT))
            .withColumn("_row", F.col("_id") - F.shiftleft("_slice", _SHIFT)).drop("_id"))


def slopes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Least-squares slope of ``value`` against its place 0..n-1 per group: keys..., slope (null for n = 1).

    ``order`` must name every row once, so that the sort has one result. One sort and two aggregations; the
    second one sees a row per group and slice only.
    """
    slices = (_sorted_slices(df.select(*keys, *[o.lstrip("-") for o in order], value), keys, order)
              .groupBy(*keys, "_slice")
              .agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.min("_row").alias("first"),
                   F.sum(F.col("_row") * F.col(value)).alias("rs")))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # sum(place * value) of a slice, from sum(row * value): place = row - first + offset
    placed = placed.withColumn("ps", F.col("rs") + (F.col("offset") - F.col("first")) * F.col("s"))
    total = placed.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"),
                                      F.sum("ps").alias("ps"))
    n = F.col("n")
    return total.select(*keys, F.when(n > 1, (F.col("ps") - (n - 1) / 2 * F.col("s")) * 12 / (n * (n * n - 1)))
                        .alias("slope"))


def places(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row in its group.

    The sorted rows are checkpointed, since their slice numbers are read twice and must agree.
    """
    rows = checkpoint(_sorted_slices(df, keys, order))
    starts = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    names = {k: f"_g{i}" for i, k in enumerate([*keys, "_slice"])}
    starts = starts.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(starts, reduce(lambda a, b: a & b, same)).select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_offset") + 1).alias(name))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int, unique: Column | None = None, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group with their place ``position``.

    For a small ``n`` the optimizer puts a group limit on both sides of the one shuffle, so a task sends at most n rows of
    a group. For more than its threshold the rows go in two rounds: round one keeps the first n of each (group, salt),
    round two sees at most salts * n rows per group.
    """
    if unique is not None and n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(salts)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*directions(order))
        df = salted.withColumn("_p", F.row_number().over(w1)).filter(F.col("_p") <= n).drop("_p", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*directions(order))
    return df.withColumn("position", F.row_number().over(w2)).filter(F.col("position") <= n)
