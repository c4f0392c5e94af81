"""Document tables: search, look-up, create, patch, delete, analytics, text statistics, previews, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgergraph.functions.text import chunks, word_count


def search(docs: DataFrame, term: str | None = None, skip: int = 0, limit: int | None = 100) -> DataFrame:
    """Documents whose title holds a term, whatever the case, in order of id, one page of them."""
    if term is not None:
        docs = docs.filter(F.col("title").ilike(f"%{term}%"))
    docs = docs.orderBy("id").offset(skip)
    return docs if limit is None else docs.limit(limit)


def lookup(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents with the given ids; ids that are not there give nothing."""
    return docs.join(keys.select("id"), "id", "left_semi")


def create(rows: DataFrame, as_of: str | None = None) -> DataFrame:
    """New documents with both times set to now, or to a given time. To store them, append the result."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    return rows.withColumn("created_at", now).withColumn("updated_at", now)


DOCUMENT = ("id long, title string, content string, file_path string, file_type string, description string, "
            "created_at timestamp_ntz, updated_at timestamp_ntz")


def append(docs: DataFrame, folder: str) -> None:
    """Add documents to a stored table; columns that they don't have are null."""
    schema = DataType.fromDDL(DOCUMENT)
    docs.select(*[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).parquet(folder)


def patch(docs: DataFrame, patches: DataFrame, fields: list[str], as_of: str | None = None) -> DataFrame:
    """Documents after partial updates (id, patch map). Only keys of the patch change; a null value does overwrite."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    joined = docs.join(patches.select("id", F.col("patch").alias("_p")), "id", "left")
    hit = F.col("_p").isNotNull()

    def value(c: str):
        if c in fields:
            return F.when(hit & F.map_contains_key("_p", F.lit(c)), F.try_element_at("_p", F.lit(c))).otherwise(F.col(c)).alias(c)
        return F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
    return joined.select(*[value(c) for c in docs.columns])


def delete(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(keys.select("id"), "id", "left_anti")


def analytics(docs: DataFrame) -> DataFrame:
    """Number of documents and the newest one."""
    return docs.agg(F.count("*").alias("total"), F.max_by("id", F.struct("created_at", "id")).alias("latest_id"),
                    F.max_by("title", F.struct("created_at", "id")).alias("latest_title"))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.select("doc_id", word_count(t).alias("word_count"), F.length(t).alias("character_count"),
                       F.size(F.split(t, "\n", -1)).alias("line_count"))


def preview(docs: DataFrame, size: int = 500, most: int | None = 3, text: str = "text") -> DataFrame:
    """The text in pieces of ``size`` characters, the first ``most`` of them or all, with a label each."""
    pieces = chunks(F.col(text), size)
    if most is not None:
        pieces = F.slice(pieces, 1, most)
    rows = docs.select("doc_id", F.posexplode(pieces).alias("i", "value"))
    return rows.select("doc_id", F.concat(F.lit("Text Preview "), F.col("i") + 1).alias("field"), "value",
                       F.lit(1.0).alias("confidence"))


def export_csv(rows: DataFrame, folder: str) -> None:
    """Results as CSV files with a header. Quotes inside values are doubled, so that any reader gets them back."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def as_json_text(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text, for stores that take flat values."""
    return df.select(*[F.to_json(c).alias(c) if c in columns else F.col(c) for c in df.columns])
