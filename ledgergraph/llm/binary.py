"""Token ids in binary files of fixed-width packed ids, with block offsets for random access.

A file holds, in this order: the packed blocks (``BLOCK`` ids each, the last one shorter); for each document its
id (int64) and the file's number of ids before it (int64); for each block its byte offset (int64); and a footer of
six int64: magic, width in bits, ids per block, ids, documents, blocks. All numbers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.llm.common import pieces, texts
from ledgergraph.llm.tokens import default_path, encoder
from ledgergraph.session import scratch_folder

BLOCK = 1 << 16
MAGIC = 0x3142504B4F54
ROWS = 4096


def width_for(vocabulary: int) -> int:
    """The bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(bits, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def open_folder(folder: str):
    """The file system of a folder, local or remote, and the folder's path on it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class Writer:
    """Writes one file, block by block."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.rest, self.ids, self.offsets, self.docs = np.zeros(0, np.uint32), 0, [], []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        starts = self.ids + np.cumsum(lengths) - lengths
        self.docs.append(np.stack([doc_ids, starts], axis=1).astype("<i8"))
        self.ids += int(lengths.sum())
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        self._blocks(self.rest[:whole])
        self.rest = self.rest[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCK):
            self.offsets.append(self.out.tell())
            self.out.write(pack(ids[at:at + BLOCK], self.width))

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        docs = np.concatenate([*self.docs, np.zeros((0, 2), "<i8")])
        self.out.write(docs.tobytes())
        self.out.write(np.array([*self.offsets, MAGIC, self.width, BLOCK, self.ids, len(docs), len(self.offsets)], "<i8").tobytes())
        self.out.close()
        return len(docs), self.ids


class Reader:
    """Random access to one file: documents, or any slice of ids."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        magic, self.width, self.block, self.ids, docs, blocks = np.frombuffer(source.read_at(48, size - 48), "<i8").tolist()
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        tail = size - 48 - 8 * blocks
        self.offsets = np.append(np.frombuffer(source.read_at(8 * blocks, tail), "<i8"), tail - 16 * docs)
        table = np.frombuffer(source.read_at(16 * docs, tail - 16 * docs), "<i8").reshape(-1, 2)
        self.doc_ids, self.starts = table[:, 0], np.append(table[:, 1], self.ids)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids start..stop of the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        first = int(self.offsets[a])
        data = self.source.read_at(int(self.offsets[b]) - first, first)
        count = min(b * self.block, self.ids) - a * self.block
        if self.block * self.width % 8 == 0:
            ids = unpack(data, self.width, count)
        else:
            raise ValueError("blocks must fill whole bytes")
        return ids[start - a * self.block:stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_ids(docs: DataFrame, folder: str, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, in ascending doc_id order.

    Each task of a range sort by doc_id (nulls first, then by a hash of the text) writes one file under a name of its own, so that
    a repeated task leaves a file that nobody lists. Returns the manifest, stored in the folder and in file order:
    part, path, n_docs, n_ids, first_id (ids in all files before).
    """
    tokenizer = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encode = None, encoder(tokenizer)
        for batch in pieces(batches):
            if writer is None:
                system, base = open_folder(folder)
                name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                system.create_dir(base, recursive=True)
                writer = Writer(system.open_output_stream(f"{base}/{name}"), width_for(max(encode.size, end_id + 1)))
            ids, ends = encode.encode(batch.column(1))
            at = np.arange(1, len(ends) + 1)
            marked = np.full(len(ids) + len(ends), end_id, np.uint32)
            keep = np.ones(len(marked), bool)
            keep[ends + at - 1] = False
            marked[keep] = ids
            writer.add(batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), np.diff(ends + at, prepend=0), marked)
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.record_batch({"part": [TaskContext.get().partitionId()], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = texts(docs).withColumn("tie", F.xxhash64("text"))  # ranges are drawn from samples of the keys, so no texts there
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    made = rows.select("doc_id", "text").mapInArrow(write, "part long, path string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/files")
    files = docs.sparkSession.read.parquet(f"{folder}/files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (uint32 bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['path']}") as source:
                    file = Reader(source)
                    for a in range(0, len(file.doc_ids), ROWS):
                        yield from _rows(file, a, min(a + ROWS, len(file.doc_ids)), row["first_id"])

    files = manifest.select("path", "first_id").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(file: Reader, a: int, b: int, first: int) -> Iterator[pa.RecordBatch]:
    starts = file.starts[a:b + 1]
    data = file.slice(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
    parts = [data[4 * (s - starts[0]):4 * (t - starts[0])] for s, t in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
    ids = file.doc_ids[a:b]
    yield pa.record_batch({
        "doc_id": pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), "start": first + starts[:-1],
        "n_tokens": np.diff(starts), "ids_crc32": np.array([zlib.crc32(p) for p in parts], np.int64),
        "ids": pa.array(parts, pa.binary())})


def round_trip(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids to files and read them back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty and gives the end id alone; rows with a null id come first and keep it; repeated ids
    follow in the order of a hash of their texts; an empty table gives no file and an empty result; other columns are ignored.
    """
    folder = scratch_folder(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, folder, end_id, tokenizer), folder).drop("ids")
