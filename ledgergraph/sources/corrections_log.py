"""The log of corrections as a table that only grows; the newest entry of a correction counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["correction_id", "subject_id", "strategy", "field", "params", "priority", "is_active"]


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def append(corrections: DataFrame, folder: str) -> None:
    """Add corrections as one batch. One writer at a time; a batch shows only when it is written whole."""
    spark = corrections.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    last = _entries(spark, folder).agg(F.max("batch")).first()[0] if there else 0
    corrections.select(*COLUMNS, F.lit((last or 0) + 1).cast("long").alias("batch")).write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The corrections as their newest entries have them."""
    newest = F.max_by(F.struct(*COLUMNS[1:]), "batch")
    return _entries(spark, folder).groupBy("correction_id").agg(newest.alias("z")).select("correction_id", "z.*")


def withdraw(spark: SparkSession, ids: DataFrame, folder: str) -> None:
    """Switch corrections off, by id: their entries are written again, inactive."""
    append(read(spark, folder).join(ids, "correction_id", "left_semi").withColumn("is_active", F.lit(False)), folder)
