"""Packing by lexical retrieval: BM25 neighbours of a seed document fill the seed's window.

Tokens are encoded once and stored, with document frequencies over the whole corpus. Documents are dealt into index
shards by range over a MinHash signature of their tokens, so that lexically close documents share a shard, a crowded
signature is cut like any other range, and a shard is bounded however large the corpus is. A shard's inverted index
answers each seed's query with its unused neighbours; they fill the window best first, as far as they fit, and the
best that doesn't fit is cut to fill the rest. What is left of it seeds the next window. So only the last window of
a task is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import pieces, ragged, stored, texts, value_lengths
from ledgergraph.llm.tokens import default_path, encoder

WINDOW = 4096
SHARD_DOCS = 2048
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 16
K1, B = 1.2, 0.75


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, end_id: int, tokenizer: str) -> DataFrame:
    """``doc_id, ids binary, near long, df binary``: a row per document, and one per task with the document frequency of
    every id (int64) and no ids. Ids are stored as :func:`id_type` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        size = max(encode.size, end_id + 1)
        df = np.zeros(size, np.int64)
        mixed = np.random.default_rng(7).permutation(size).astype(np.uint32)
        n = 0
        for batch in pieces(batches):
            ids, ends = encode.encode(batch.column(1))
            lengths = np.diff(ends, prepend=0)
            doc = np.repeat(np.arange(len(ends)), lengths)
            narrow = np.uint32 if len(ends) * size < 1 << 32 else np.uint64
            seen = np.unique(doc.astype(narrow) * narrow(size) + ids.astype(narrow))
            df += np.bincount(seen % size, minlength=size)
            near = np.full(len(ends), -1, np.int64)
            full = np.flatnonzero(lengths)
            if len(full):
                near[full] = np.minimum.reduceat(mixed[ids], (ends - lengths)[full])
            at = np.arange(1, len(ends) + 1)
            kind = np.dtype(id_type(size))
            marked = np.full(len(ids) + len(ends), end_id, kind)
            keep = np.ones(len(marked), bool)
            keep[ends + at - 1] = False
            marked[keep] = ids
            offsets = np.concatenate([[0], kind.itemsize * (ends + at)])
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(marked)])
            yield pa.record_batch([batch.column(0), data.cast(pa.binary()), pa.array(near), pa.nulls(len(ends), pa.binary())], names=["doc_id", "ids", "near", "df"])
            n += len(ends)
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["doc_id", "ids", "near", "df"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, near long, df binary")


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """BM25's inverse document frequency of each id over all documents; one number per id of the vocabulary."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                df = np.frombuffer(data.as_py(), np.int64)
                at = np.flatnonzero(df)
                yield pa.record_batch({"id": at, "df": df[at]})

    counts = rows.where("df IS NOT NULL")
    total = counts.agg(F.sum("doc_id")).first()[0] or 0
    found = counts.select("df").mapInArrow(spread, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()
    idf = np.zeros(1 + max((r.id for r in found), default=0))
    for r in found:
        idf[r.id] = np.log1p((total - r.df + 0.5) / (r.df + 0.5))
    return idf


class Index:
    """A BM25 inverted index over the pieces of one shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float) -> None:
        self.n = len(ids)
        length = np.array([len(x) for x in ids])
        size = max(len(idf), max(int(x.max()) for x in ids) + 1)
        known = np.zeros(size)
        known[:len(idf)] = idf
        pairs, tf = np.unique(np.repeat(np.arange(self.n), length) * size + np.concatenate(ids), return_counts=True)
        doc, term = pairs // size, pairs % size
        weight = known[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        best = np.lexsort((-weight, doc))  # the heaviest terms of a document are its query
        rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(self.n))[doc[best]]
        chosen = best[rank < QUERY_TERMS]
        self.query_ends = np.searchsorted(doc[chosen], np.arange(self.n), "right")
        self.query = term[chosen]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, sorted_terms = doc[order], weight[order], term[order]
        self.first, self.last = (np.searchsorted(sorted_terms, self.query, side) for side in ("left", "right"))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused pieces that share a query term with the seed, best first."""
        q = slice(self.query_ends[seed - 1] if seed else 0, self.query_ends[seed])
        at = ragged(self.first[q], self.last[q] - self.first[q])
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows in turn; ``out`` holds (document, start, length, window, offset)."""

    def __init__(self, idf: np.ndarray, average: float, window: int = WINDOW) -> None:
        self.idf, self.average, self.window = idf, average, window
        self.windows = self.sequence = self.filled = 0
        self.out: list[tuple[int, int, int, int, int]] = []

    def add(self, docs: list[np.ndarray]) -> None:
        """Pack all of a shard's documents; a window that isn't full stays open for the next shard."""
        rests = []
        for d, ids in enumerate(docs):
            whole = len(ids) // self.window * self.window
            for start in range(0, whole, self.window):
                self.out.append((d, start, self.window, self.windows, 0))
                self.windows += 1
            if whole < len(ids):
                rests.append((d, whole, len(ids) - whole))
        if rests:
            self._fill(rests, Index([docs[d][a:a + n] for d, a, n in rests], self.idf, self.average))

    def _fill(self, rests: list[tuple[int, int, int]], index: Index) -> None:
        docs, starts, lengths = (np.array(c) for c in zip(*rests, strict=True))
        unused = np.ones(len(rests), bool)

        def put(i: int) -> bool:
            """Put the piece, or what still fits of it, into the open window; true if that fills it."""
            if not self.filled:
                self.sequence, self.windows = self.windows, self.windows + 1
            n = min(int(lengths[i]), self.window - self.filled)
            self.out.append((int(docs[i]), int(starts[i]), n, self.sequence, self.filled))
            self.filled = (self.filled + n) % self.window
            starts[i] += n
            lengths[i] -= n
            unused[i] = lengths[i] > 0
            return not self.filled

        at, seed = 0, None
        while True:
            if seed is None or not unused[seed]:
                while at < len(rests) and not unused[at]:
                    at += 1
                if at == len(rests):
                    return
                seed = at
            full, cut = put(seed), None
            for i in () if full else index.neighbours(seed, unused):
                if lengths[i] <= self.window - self.filled:
                    if full := put(i):
                        break
                elif cut is None:
                    cut = int(i)
            if not full and cut is not None:
                put(cut)
            seed = cut


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pack the ids of all texts, each followed by ``end_id``, into windows.

    Returns a row per piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (in the window), and the piece's ids (uint32) if wanted. Every id lies in exactly one piece.
    A null text counts as empty and is a piece of the end id alone; null ids and repeated rows are packed like others,
    each row by itself; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    tokenizer = tokenizer or default_path()
    rows = stored(encoded(docs, end_id, tokenizer), "encoded")
    idf = rows.sparkSession.sparkContext.broadcast(inverse_frequencies(rows))  # one number per id of the vocabulary
    whole = rows.where("ids IS NOT NULL").select("doc_id", "ids", "near")
    kind = np.dtype(id_type(max(encoder(tokenizer).size, end_id + 1)))
    average = whole.agg(F.avg(F.octet_length("ids") / kind.itemsize)).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(idf.value, average, window)
        base = TaskContext.get().partitionId() << 32
        for names, docs in _shards(batches, kind):
            packer.add(docs)
            done, packer.out = packer.out, []
            for at in range(0, len(done), 4096):
                yield _table(names, docs, done[at:at + 4096], base, with_ids)

    made = whole.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id").select("doc_id", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return made


def _shards(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    names, docs, size = [], [], 0
    for batch in batches:
        for name, n, data in zip(batch.column(0).to_pylist(), value_lengths(batch.column(1)).tolist(), batch.column(1), strict=True):
            n //= kind.itemsize
            if docs and (len(docs) >= SHARD_DOCS or size + n > SHARD_TOKENS):
                yield names, docs
                names, docs, size = [], [], 0
            names.append(name)
            docs.append(np.frombuffer(data.as_buffer(), kind).copy())
            size += n
    if docs:
        yield names, docs


def _table(names: list, docs: list[np.ndarray], done: list, base: int, with_ids: bool) -> pa.RecordBatch:
    doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*done, strict=True))
    parts = [docs[d][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in done]
    columns = {
        "doc_id": pa.array([names[d] for d in doc], pa.int64()), "start": start, "length": length,
        "ids_crc32": np.array([zlib.crc32(p) for p in parts], np.int64), "doc_tokens": np.array([len(docs[d]) for d in doc], np.int64),
        "sequence_id": base + sequence, "offset": offset}
    return pa.record_batch(columns | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))
