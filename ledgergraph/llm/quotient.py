"""Exact dedup: a counting quotient filter per partition, merged without loss, then a check of the bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import numbered, stored, texts

ROWS_PER_FILTER = 1_000_000
BROADCAST_ROWS = 2_000_000  # 16 MB of fingerprints


class QuotientFilter:
    """Distinct 64-bit fingerprints that share their ``block_bits`` leading bits, with counts.

    A fingerprint is cut into block, quotient and remainder. ``occupied`` marks quotients in use and ``run_ends`` the
    last slot of each quotient's run; a run holds sorted remainders, each with its count. The cut loses nothing, so a
    filter gives its fingerprints back and filters of the same block merge exactly, whatever their quotient bits.
    """

    def __init__(self, block: int, block_bits: int, fps: np.ndarray, counts: np.ndarray) -> None:
        self.block, self.block_bits = block, block_bits
        self.q = min(64 - block_bits, max(1, math.ceil(math.log2(max(2, len(fps))))))
        self.r = 64 - block_bits - self.q
        inner = fps << np.uint64(block_bits) >> np.uint64(block_bits) if block_bits else fps
        quotient = (inner >> np.uint64(self.r)).astype(np.int64)
        self.remainders = inner & np.uint64((1 << self.r) - 1)
        self.counts = counts.astype(np.uint64)
        self.occupied = np.zeros(1 << self.q, bool)
        self.occupied[quotient] = True
        self.run_ends = np.append(quotient[1:] != quotient[:-1], True) if len(fps) else np.zeros(0, bool)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, ascending: the runs are in order of quotient and each run in order of remainder."""
        run = np.cumsum(self.run_ends) - self.run_ends
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        top = np.uint64(self.block << (64 - self.block_bits) if self.block_bits else 0)
        return top | quotient << np.uint64(self.r) | self.remainders

    def to_bytes(self) -> bytes:
        many = self.counts > 1  # a counter follows only where a remainder came more than once
        width = (self.r + 7) // 8
        return b"".join([
            np.array([self.block, self.block_bits, self.q, len(self.counts), int(many.sum())], "<i8").tobytes(),
            np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), np.packbits(many).tobytes(),
            np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(),
            self.counts[many].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        f = cls.__new__(cls)
        f.block, f.block_bits, f.q, n, m = (int(x) for x in np.frombuffer(data, "<i8", 5))
        f.r, at = 64 - f.block_bits - f.q, 40

        def bits(count: int) -> np.ndarray:
            nonlocal at
            got = np.unpackbits(np.frombuffer(data, np.uint8, (count + 7) // 8, at), count=count).astype(bool)
            at += (count + 7) // 8
            return got

        f.occupied, f.run_ends, many = bits(1 << f.q), bits(n), bits(n)
        width = (f.r + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        f.remainders = wide.view("<u8").ravel().astype(np.uint64)
        f.counts = np.ones(n, np.uint64)
        f.counts[many] = np.frombuffer(data, "<u8", m, at + n * width)
        return f

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with all counts added; the inputs are sorted, so a stable sort merges their runs."""
        fps = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(fps, kind="stable")
        fps, counts = fps[order], counts[order]
        first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1]))
        return cls(filters[0].block, filters[0].block_bits, fps[first], np.add.reduceat(counts, first))


def partition_filters(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """``block long, filter binary``: for each partition of ``fp long`` one filter per block that it touches."""

    def blocks_of(fps: np.ndarray) -> pa.RecordBatch:
        fps, counts = np.unique(fps, return_counts=True)
        block = (fps >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(fps), np.int64)
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(fps)]
        made = [QuotientFilter(int(block[a]), block_bits, fps[a:b], counts[a:b]).to_bytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.record_batch({"block": block[cuts[:-1]], "filter": pa.array(made, pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if (n := n + batch.num_rows) >= ROWS_PER_FILTER:
                yield blocks_of(np.concatenate(held))
                held, n = [], 0
        if n:
            yield blocks_of(np.concatenate(held))

    return fingerprints.select("fp").mapInArrow(build, "block long, filter binary")


def merged_filters(filters: DataFrame) -> DataFrame:
    """One filter per block, from all partitions' filters of that block."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one = QuotientFilter.merged([QuotientFilter.from_bytes(x) for x in pdf["filter"]])
        return pd.DataFrame({"block": [one.block], "filter": [one.to_bytes()]})

    return filters.groupBy("block").applyInPandas(merge, "block long, filter binary")


def repeated(filters: DataFrame) -> DataFrame:
    """``fp long, n long``: the fingerprints that filters count more than once."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                f = QuotientFilter.from_bytes(data.as_py())
                many = f.counts > 1
                yield pa.record_batch({"fp": f.fingerprints()[many].view(np.int64), "n": f.counts[many].astype(np.int64)})

    return filters.select("filter").mapInArrow(decode, "fp long, n long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """:func:`duplicates` of any table with doc_id and text."""
    return duplicates(numbered(docs.select("doc_id", "text"))).drop("row")


def duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents with equal texts, one row per document. Reads row (a key of the row), doc_id and text.

    Returns row, doc_id, keep_id, group_size, kept, text_sha256. The row with the largest
    doc_id of a group stays, just one if that row is repeated. A null text counts as empty; a null id loses to any
    other and its group's keep_id is null only if all ids are; an empty table gives an empty result; other
    columns are ignored.

    Fingerprints that the merged filters count once need no more work. Texts of the others are compared byte by byte
    (they are grouping keys, so copies combine before the shuffle). Only then do equal digests stand for equal texts.
    """
    keyed = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = stored(keyed.select("row", "doc_id", F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("sha")), "digests")
    block_bits = min(24, max(4, math.ceil(math.log2(max(1, narrow.count() / ROWS_PER_FILTER)))))
    many = stored(repeated(merged_filters(partition_filters(narrow, block_bits))), "repeated")

    # Beyond the size that is safe to broadcast the texts are dealt out by fingerprint instead.
    listed = many.select("fp")
    listed = F.broadcast(listed) if many.count() <= BROADCAST_ROWS else listed
    verified = (texts(docs).select(F.xxhash64("text").alias("fp"), "text").join(listed, "fp", "left_semi")
                .groupBy("fp", "text").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("fp", F.sha2("text", 256).alias("sha"))
                .agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
                .withColumn("sound", F.assert_true(F.col("texts") == 1, F.lit("two texts share a SHA-256 digest")))
                .where(F.col("sound").isNull()).drop("sound", "texts"))
    last = (narrow.join(listed, "fp", "left_semi").groupBy("fp", "sha")
            .agg(F.max(F.struct("doc_id", "row")).alias("last")))
    classes = verified.join(last, ["fp", "sha"]).where(F.col("group_size") > 1)
    return (narrow.join(classes, ["fp", "sha"], "left")
            .select("row", "doc_id", F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("last").isNull() | (F.col("row") == F.col("last.row"))).alias("kept"),
                    F.col("sha").alias("text_sha256")))
