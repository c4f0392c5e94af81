"""Near-duplicates by SimHash fingerprints, found around the code words of a covering code.

Two fingerprints that differ in at most ``bits`` bits differ in at most ``bits // segments`` bits of some segment. On
that segment a word halfway between them is within ``ceil(bits // segments / 2)`` of both, and a code word (anchor) of
the covering code is within the code's covering radius of the halfway word. So copying every fingerprint to all
anchors within covering radius plus that half threshold brings each such pair together at some anchor, and only
fingerprints at the same anchor are compared.

The code on a segment is a Hamming code (perfect, covering radius 1) times all values of the bits left over. With 64
bits in two segments and 4 bits of difference there are 2^27 anchors per segment and 2 or 17 copies per fingerprint
and segment. Fewer segments give longer keys and more copies, for more data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import numbered, pieces, stored, words_of
from ledgergraph.llm.components import components, forest

SHINGLE = 4
BITS = 4
SEGMENTS = 2
BLOCK = 1024
LINKS_HELD = 2_000_000


def shingles_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Number of word shingles of each text, and (text, XXH64 with seed 42) of the shingles in turn, repeats included, in parts."""
    flat, ends = words_of(pc.ascii_lower(texts))
    spaced = pc.binary_join_element_wise(flat, "", " ")  # each word and a blank: shingles are slices of the buffer
    if not pa.types.is_large_string(spaced.type):
        spaced = spaced.cast(pa.large_string())
    offset = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
    data = spaced.buffers()[2].to_pybytes() if len(spaced) else b""
    starts = np.concatenate([[0], ends[:-1]])
    words = ends - starts
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(ends)), count)
    first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    last = np.minimum(first + shingle, ends[doc])

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(doc), 1 << 17):
            part = slice(at, at + (1 << 17))
            yield doc[part], np.fromiter((xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(offset[first[part]].tolist(), (offset[last[part]] - 1).tolist(), strict=True)), np.uint64)

    return count, parts()


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text over the XXH64 (seed 42) of its word shingles, repeats included."""
    count, parts = shingles_of(texts, shingle)
    ones = np.zeros((len(count), 64), np.int64)
    for doc, h in parts:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        ones[doc[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_bits = 2 * ones > count[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``row, doc_id, fp long`` for each row of ``row, doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = fingerprints_of(batch.column(2), shingle).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp)], names=["row", "doc_id", "fp"])

    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    row = next(f.dataType.simpleString() for f in docs.schema if f.name == "row")
    return docs.mapInArrow(run, f"row {row}, doc_id long, fp long")


class Cover:
    """The anchors of one segment of ``length`` bits from bit ``low`` on."""

    def __init__(self, low: int, length: int, difference: int) -> None:
        self.low, self.length = low, length
        self.coded = (1 << ((length + 1).bit_length() - 1)) - 1  # the longest Hamming code that fits
        radius = 1 + (difference + 1) // 2
        lists: dict[int, list[int]] = {}
        for weight in range(radius + 1):
            for flips in combinations(range(length), weight):
                syndrome = 0
                for i in flips:
                    syndrome ^= i + 1 if i < self.coded else 0
                lists.setdefault(syndrome, []).append(sum(1 << i for i in flips))
        self.flips = {s: np.array(x, np.uint64) for s, x in lists.items()}

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of a fingerprint and one of its anchors, for all anchors near enough.

        An anchor is a value with syndrome 0, so it is the segment with bits flipped whose syndrome is the segment's.
        """
        part = fps >> np.uint64(self.low) & np.uint64((1 << self.length) - 1)
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(self.coded):
            syndrome ^= np.where(part >> np.uint64(i) & np.uint64(1), i + 1, 0)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for s, flips in self.flips.items():
            at = np.flatnonzero(syndrome == s)
            found.append((np.repeat(at, len(flips)), (part[at, None] ^ flips).ravel()))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def covers(bits: int = BITS, segments: int = SEGMENTS) -> list[Cover]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [Cover(a, b - a, bits // segments) for a, b in zip(cuts, cuts[1:], strict=False)]


def anchored(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``segment int, anchor long, fp long``: every distinct fingerprint at all its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = covers(bits, segments)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, cover in enumerate(made):
                for at in range(0, len(fp), 50_000):
                    index, anchor = cover.anchors(fp[at:at + 50_000])
                    yield pa.record_batch({"segment": np.full(len(index), i, np.int32), "anchor": anchor.view(np.int64), "fp": fp[at:at + 50_000][index].view(np.int64)})

    return fps.select("fp").mapInArrow(run, "segment int, anchor long, fp long")


def links_of(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among fingerprints with the same key; rows are sorted by key."""
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    held, n = [], 0
    at, step = np.arange(len(keys)), 0
    while len(at):
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at + step] == keys[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
        held.append((fps[near], fps[near + step]))
        n += len(near)
        if n > LINKS_HELD or not len(at):
            a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
            held, n = [], 0
    return a, b


def links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """``a long, b long``: links with the same components as all pairs of ``fps`` within ``bits`` bits.

    Fingerprints at an anchor are dealt into blocks of about ``block``, and each pair of blocks is one small group, so
    a crowded anchor is spread over many tasks and still compared whole. Groups give a forest, never all their pairs.
    """
    near = stored(anchored(fps, bits, segments), "anchored")
    crowd = near.groupBy("segment", "anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = crowd.select("segment", "anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    dealt = (near.join(crowd, ["segment", "anchor"]).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("segment", "anchor", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
                yield linked(keys[:cut], fp[:cut])
                keys, fp = keys[cut:], fp[cut:]
        if len(keys):
            yield linked(keys, fp)

    def linked(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = links_of(keys, fp, bits)
        return pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Documents with their fingerprints and components. Reads row (a key of the row), doc_id and text.

    Returns row, doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links of at most
    ``bits`` differing bits), least (that row of the component, with its doc_id) and kept (true for that row).
    Words are runs of other than space and 0x09-0x0D, A-Z lowered; texts of fewer words than a shingle are one
    shingle; texts without words, nulls too, have fingerprint zero, which links like any other. A null id counts in
    a component only if it has no other id; repeated rows share a component; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    first = F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    nodes = stored(rows.groupBy("fp").agg(first.alias("first")), "nodes")
    return labelled(rows, nodes, links(nodes, bits, segments)).select(
        "row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), "least", (F.col("row") == F.col("least.row")).alias("kept"))


def labelled(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (with fp) and ``least``: of the ``nodes (fp, first)`` that the links reach the least doc_id and row."""
    reached = components(links)
    known = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    best = F.min_by("first", F.struct(F.col("first.doc_id").isNull(), F.col("first.doc_id"), F.col("first.row")))
    least = known.groupBy("label").agg(best.alias("least"))
    return rows.join(known.join(least, "label").select("fp", "least"), "fp")


def near_components(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` of any table with doc_id and text."""
    return near_duplicates(numbered(docs.select("doc_id", "text"))).drop("row", "least", "kept")
