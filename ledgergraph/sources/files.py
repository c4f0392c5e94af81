"""Files: listing, admission, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergraph.catalog import doctypes


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files below a folder (path, modificationTime, length, content). Content is read only if it is asked for."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(folder))


def admit(files: DataFrame, suffixes: list[str] | None = None, most: int = doctypes.MAX_FILE_BYTES) -> DataFrame:
    """Files (name, length) with ``accepted`` and the ``reason`` if not."""
    allowed = doctypes.ACCEPTED_SUFFIXES if suffixes is None else suffixes
    reason = F.when(~suffix(F.col("name")).isin(*allowed), "type").when(F.col("length") > most, "size")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def fingerprints(files: DataFrame) -> DataFrame:
    """Name, suffix, size and MD5 of every file (path, length, content), whatever its size: limits are a matter of
    admission, which names its reasons."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("name"), suffix(name).alias("suffix"), "length", F.md5("content").alias("md5"))
