"""Readers of the star-schema tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Schemas read once per path: a graph query scans most tables, and looking into the files each time costs a job.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name!r}")
    path = os.path.join(folder, f"{name}.parquet")
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the session has cores.

    Work on text costs much more than reading it. A table of few files would run it in few tasks; then, and only
    then, the rows are dealt out anew. A large table has many splits already and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
