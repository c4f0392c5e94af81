"""Exact token counts from a histogram of encoded lengths: one pass over the texts, then only lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.llm.common import pieces, stored, texts
from ledgergraph.llm.tokens import default_path, encoder

BUCKET = 4096


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id long, n_tokens long`` of every text; a null text has none."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ends = encoder(path).encode(batch.column(1))[1]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends, prepend=0))], names=["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per encoded length that occurs, with what holds for a context limit of that length.

    Returns n_tokens, n_docs (of this length), docs_from and tokens_from (documents at least this long, and all their
    tokens: suffix sums), docs_total, tokens_total, rank (share of documents that are at most this long: the quantile
    whose value n_tokens is) and truncated_total (tokens that remain if every document is cut to n_tokens). Every
    row counts, repeated ones too; null texts have length 0; an empty table gives an empty result; columns other than
    doc_id and text are ignored.

    Suffix sums run in two levels (buckets of ``BUCKET`` lengths, then lengths of a bucket), so no task sees more than
    a bucket's lengths or one number per bucket.
    """
    counted = stored(lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counted = counted.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("n", F.col("n_docs") * F.col("n_tokens"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    every = Window.partitionBy()
    buckets = counted.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("t"))
    buckets = buckets.select("bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
                             F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
                             F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.join(buckets, "bucket").select(
        "n_tokens", "n_docs", (F.col("docs_above") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("tokens_above") + F.sum("n").over(inside)).alias("tokens_from"), "docs_total", "tokens_total")
    return rows.select(
        "*", ((F.col("docs_total") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_total")).alias("rank"),
        (F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, truncated_total`` for any context limits, from a histogram's rows alone."""
    wanted = hist.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    longer = hist.select("n_tokens", "docs_from", "tokens_from", "tokens_total")
    per = F.expr("n_tokens >= limit")
    # The first length that reaches a limit has the suffix sums of the limit itself; limits are a short given list.
    found = longer.join(F.broadcast(wanted), per).groupBy("limit").agg(F.min_by(F.struct("docs_from", "tokens_from"), "n_tokens").alias("s"))
    total = hist.agg(F.max("tokens_total").alias("total"))
    return wanted.join(found, "limit", "left").crossJoin(total).select(
        "limit", F.coalesce(F.expr("total - s.tokens_from + limit * s.docs_from"), "total").alias("truncated_total"))


def quantile(hist: DataFrame, share: float) -> int | None:
    """The least length that at least this share of the documents don't exceed."""
    return hist.where(F.col("rank") >= share).agg(F.min("n_tokens")).first()[0]
