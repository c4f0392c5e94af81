"""Helpers shared by the operators: narrow inputs, tables in the shared folder, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergraph.session import scratch_folder

BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id long, text string`` of any table that has these columns; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """Adds a number that is unique per row, also for repeated rows, and gapped."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def addressed(docs: DataFrame, name: str = "row") -> DataFrame:
    """Adds the place of each row in its file, which is the same however often and in whatever cuts the files are read.

    Rows that don't come straight from files are written to a table first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, "rows")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.withColumn(name, place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and go on from the written copy, which outlives executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``limit`` bytes, or one row, in each.

    After the last one, the worker gives memory back that Arrow keeps for reuse; the worker lives on for other stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(value_lengths(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def value_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column, 0 for nulls."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of other than space and 0x09-0x0D) of each text in one flat array, and where each text's words end."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(column)
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():  # blanks at the ends of a text give empty pieces
        ends = np.concatenate([[0], np.cumsum(mask)])[ends]
        flat = flat.filter(full)
    return flat, ends.astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the slices [start, start + length) one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


class Lookup:
    """An open-addressing hash table from numbers of 0 to 2^63 - 1 to values; ``room`` keys fit without a rebuild.

    Between a third and two thirds of the places are taken, so a table of 8-byte values has 24 to 48 bytes a key.
    """

    def __init__(self, dtype: type, room: int = 0) -> None:
        self.size = 0
        self._empty(max(1024, int(room / 0.6) + 1), dtype)

    def _empty(self, places: int, dtype: type) -> None:
        self.keys, self.values = np.full(places, -1, np.int64), np.zeros(places, dtype)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ from each other and from those that are there."""
        self.size += len(keys)
        if self.size > 0.65 * len(self.keys):
            old, kept = self.keys >= 0, (self.keys, self.values)
            self._empty(int(self.size / 0.35), kept[1].dtype)
            self._place(kept[0][old], kept[1][old])
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._first(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            slot, who = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = keys[free[who]], values[free[who]]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], self._next(at[left])

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return (mixed * np.uint64(len(self.keys)) >> np.uint64(32)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        at = at + 1
        at[at == len(self.keys)] = 0
        return at

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 for unknown ones), and the places of the unknown ones."""
        at = self._first(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], self.values.dtype.type(0))
        unknown = [np.flatnonzero(held < 0)]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = self._next(at)
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            unknown.append(todo[held < 0])
            more = ~hit & (held >= 0)
            todo, at = todo[more], at[more]
        return out, np.sort(np.concatenate(unknown))
