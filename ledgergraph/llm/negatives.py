"""Hard-negative mining over blocks of vectors along a Hilbert curve.

Rows are sorted by their place on a Hilbert curve through the space of vectors and cut into blocks; a block is one row of a
Parquet table with its ids, labels and vectors, and its zone map: the least and the greatest value of each dimension.
For an anchor, interval arithmetic on a zone map bounds the scores that the block can hold: the sum over dimensions
of the lesser or greater of anchor x least and anchor x greatest. A block is read for an anchor only if these bounds meet the
window of scores that it still looks for, and the block has rows of the kind (same label or other label).

A search asks for the first k rows of a window. It looks at the anchor's own block first: the k-th row found there
raises the lower end of the window, which leaves fewer blocks to read. Anchors are taken in slices of bounded size, each
broadcast to all blocks. A search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgergraph.llm.common import stored
from ledgergraph.session import scratch_folder

BLOCK = 512
BITS = 4  # of each dimension on the curve
SLICE_BYTES = 8_000_000  # vectors of the anchors that are broadcast at once
AT_ONCE = 1_000_000  # scores that a task ranks at once
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
NONE = -np.iinfo(np.int64).max  # no row yet


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with coordinates of 0 to 2^bits - 1, as rows of bytes in order.

    The coordinates are turned plane by plane, from the highest bit on, into the Gray code of the place.
    """
    x = points.astype(np.int64).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(len(x)):
            turned = x[i] & q != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q != 0, q - 1, 0)
    x ^= flip
    planes = [(x >> b & 1).T for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def score_bounds(anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product of each anchor (rows) with any vector within each zone (columns)."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ least.T + minus @ greatest.T, plus @ greatest.T + minus @ least.T


def taking_part(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector array<long>``: rows with all they need; vectors times 256, rounded down."""
    x = lambda e: e.cast("double")
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(x(e)) | (F.abs(x(e)) == float("inf")))
    kept = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.col("label").cast("long")
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda e: F.floor(x(e) * 256).cast("long")).alias("vector"))


def number_type(dimensions: int, greatest: int) -> type:
    """The fastest type that holds every sum of products exactly."""
    most = dimensions * greatest * greatest
    if most >= 1 << 63:
        raise ValueError("scores don't fit in 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def make_blocks(rows: DataFrame, dimensions: int, greatest: int, block: int = BLOCK) -> DataFrame:
    """The table of blocks, in folders (``part``) of a stretch of the curve each. Rows of a block are in the order of vec_id."""
    kind = number_type(dimensions, greatest)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                v = b.column(2).flatten().to_numpy().reshape(b.num_rows, dimensions)
                cell = ((v + greatest).astype(object) if greatest > 1 << 50 else v + greatest) * (1 << BITS) // (2 * greatest + 1)
                keys = hilbert_keys(cell.astype(np.int64))
                yield pa.record_batch({"vec_id": b.column(0), "label": b.column(1), "vector": pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()),
                                       "key": pa.array([k.tobytes() for k in keys], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                table = pa.Table.from_batches(held)
                yield packed(part, n, table.slice(0, block))
                held, n = table.slice(block).to_batches(), n + 1
        if any(b.num_rows for b in held):
            yield packed(part, n, pa.Table.from_batches(held))

    def packed(part: int, n: int, table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("vec_id")
        v = np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(-1, dimensions)
        labels = table["label"].to_numpy()
        binary = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.record_batch({
            "block": [part << 32 | n], "ids": binary(table["vec_id"].to_numpy()), "labels": binary(labels), "vectors": binary(v),
            "kinds": [np.unique(labels).tolist()], "least": binary(v.min(0)), "greatest": binary(v.max(0)), "part": pa.array([part], pa.int32())})

    width = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size("vector"))).alias("vector")
    curve = rows.select("vec_id", "label", width).mapInArrow(keyed, "vec_id long, label long, vector binary, key binary")
    blocks = (curve.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").drop("key")
              .mapInArrow(cut, "block long, ids binary, labels binary, vectors binary, kinds array<long>, least binary, greatest binary, part int"))
    path = scratch_folder(rows.sparkSession, "blocks")
    blocks.write.partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(blocks.schema).parquet(path)


@dataclass
class Anchors:
    """A slice of the anchors: number of the row, its id, label, vector, and block with the place in it."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    block: np.ndarray
    place: np.ndarray


@dataclass
class Search:
    """Questions for the first ``k`` rows with a score of ``low`` to ``high`` and the same or another label than an anchor's."""

    anchors: Anchors
    who: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


FOUND = "question int, score long, id long"


def chosen_blocks(blocks: DataFrame, search: Search) -> DataFrame:
    """``part, block, asked binary``: the blocks that must be read, with a bit for each question."""
    shared = blocks.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        a, used = s.anchors, np.unique(s.who)
        place = np.searchsorted(used, s.who)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                zone = [np.frombuffer(b"".join(c.to_pylist()), a.vectors.dtype).reshape(b.num_rows, -1) for c in (b.column(3), b.column(4))]
                least, greatest = score_bounds(a.vectors[used], *zone)
                kinds = b.column(2).to_pylist()
                for j in range(b.num_rows):
                    kind = np.array(kinds[j])
                    fits = np.isin(a.labels[used], kind) if s.same else (len(kind) > 1) | (a.labels[used] != kind[0])
                    asked = (fits[place]) & (greatest[place, j] >= s.low) & (least[place, j] <= s.high)
                    if asked.any():
                        yield pa.record_batch({"part": b.column(0).slice(j, 1), "block": b.column(1).slice(j, 1), "asked": pa.array([np.packbits(asked).tobytes()], pa.binary())})

    return blocks.select("part", "block", "kinds", "least", "greatest").mapInArrow(run, "part int, block long, asked binary")


def own_blocks(blocks: DataFrame, search: Search) -> DataFrame:
    """Like :func:`chosen_blocks`, each anchor's own block only."""
    home = search.anchors.block[search.who]
    rows = [(int(b) >> 32, int(b), np.packbits(home == b).tobytes()) for b in np.unique(home)]
    return blocks.sparkSession.createDataFrame(rows, "part int, block long, asked binary")


def answer(blocks: DataFrame, search: Search, chosen: DataFrame) -> DataFrame:
    """``question, score, id``: the first k rows of each question in the chosen blocks, k for each task."""
    shared = blocks.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        a, n = s.anchors, len(s.who)
        scores, ids = np.full((n, s.k), NONE), np.zeros((n, s.k), np.int64)
        for batch in batches:
            for j in range(batch.num_rows):
                block, own, labels, vectors, asked = (c[j].as_py() for c in batch.columns)
                own, labels = np.frombuffer(own, np.int64), np.frombuffer(labels, np.int64)
                vectors = np.frombuffer(vectors, a.vectors.dtype).reshape(len(own), -1)
                asked = np.flatnonzero(np.unpackbits(np.frombuffer(asked, np.uint8), count=n))
                step = max(1, AT_ONCE // len(own))
                for at in range(0, len(asked), step):
                    q = asked[at:at + step]
                    used, place = np.unique(s.who[q], return_inverse=True)
                    score = (a.vectors[used] @ vectors.T).astype(np.int64)
                    fits = (a.labels[used][:, None] == labels) == s.same
                    here = np.flatnonzero(a.block[used] == block)
                    fits[here, a.place[used][here]] = False
                    score, fits = score[place], fits[place]
                    fits &= (score >= np.maximum(s.low[q], scores[q, -1])[:, None]) & (score <= s.high[q][:, None])
                    hit = np.flatnonzero(fits.any(1))
                    if len(hit):
                        merge(scores, ids, q[hit], np.where(fits[hit], score[hit], NONE), own)
        question, rank = np.nonzero(scores != NONE)
        for at in range(0, len(question), 50_000):
            x, r = question[at:at + 50_000], rank[at:at + 50_000]
            yield pa.record_batch({"question": x.astype(np.int32), "score": scores[x, r], "id": ids[x, r]})

    def merge(scores: np.ndarray, ids: np.ndarray, q: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        k = scores.shape[1]
        if score.shape[1] > k:  # ties go to the lesser place, which has the lesser id
            cut = -np.partition(-score, k - 1, axis=1)[:, [k - 1]]
            over = score > cut
            tied = (score == cut) & (np.cumsum(score == cut, axis=1) <= k - over.sum(1, keepdims=True))
            first = np.nonzero(over | tied)[1].reshape(len(q), k)
            score = np.take_along_axis(score, first, 1)
            own = own[first]
        every = np.concatenate([scores[q], score], axis=1)
        which = np.concatenate([ids[q], np.broadcast_to(own, score.shape)], axis=1)
        order = np.lexsort((which, -every), axis=1)[:, :k]
        scores[q], ids[q] = np.take_along_axis(every, order, 1), np.take_along_axis(which, order, 1)

    needed = [r.part for r in chosen.select("part").distinct().collect()]  # folders: as many as the blocks were written by tasks
    read = blocks.where(F.col("part").isin(needed)).select("part", "block", "ids", "labels", "vectors")
    return read.join(chosen, ["part", "block"]).select("block", "ids", "labels", "vectors", "asked").mapInArrow(run, FOUND)


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """``question, score, id, rank``: the first k rows of each question; each task has sent at most k."""
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_all(blocks: DataFrame, search: Search) -> DataFrame:
    """``question, score, id, rank`` of a search over all blocks that may hold an answer."""
    if not len(search.who):
        return blocks.sparkSession.createDataFrame([], FOUND + ", rank int")
    near = first_rows(answer(blocks, search, own_blocks(blocks, search)), search.k).where(F.col("rank") == search.k).toArrow()
    low = search.low.copy()
    low[near["question"].to_numpy()] = np.maximum(low[near["question"].to_numpy()], near["score"].to_numpy())
    raised = replace(search, low=low)
    chosen = stored(chosen_blocks(blocks, raised), "chosen")
    return first_rows(answer(blocks, raised, chosen), search.k)


def anchor_slices(blocks: DataFrame, dimensions: int, kind: type, every: int) -> Iterator[Anchors]:
    """The rows whose id is divisible by ``every``, in slices of at most about ``SLICE_BYTES`` bytes of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                block, ids, labels, vectors = (c[j].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    v = np.frombuffer(vectors, kind).reshape(len(ids), -1)
                    yield pa.record_batch({"block": np.full(len(at), block), "place": at, "id": ids[at], "label": np.frombuffer(labels, np.int64)[at],
                                           "vector": pa.array([r.tobytes() for r in v[at]], pa.binary())})

    anchors = stored(blocks.select("block", "ids", "labels", "vectors").mapInArrow(run, "block long, place long, id long, label long, vector binary"), "anchors")
    slices = -(-2 * anchors.count() * dimensions * np.dtype(kind).itemsize // SLICE_BYTES)  # on average half full
    for i in range(slices):
        part = anchors.where(F.pmod(F.xxhash64("block", "place"), F.lit(slices)) == i).toArrow()
        if part.num_rows:
            vectors = np.frombuffer(b"".join(part["vector"].to_pylist()), kind).reshape(part.num_rows, -1)
            yield Anchors(part["id"].to_numpy(), part["label"].to_numpy(), vectors, part["block"].to_numpy(), part["place"].to_numpy())


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """For each anchor (row whose vec_id is divisible by ``every``) and each of its first positives, the first rows of another
    label whose score is 30 to 90 per cent of the positive's.

    Reads vec_id, label and embedding; returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    Scores are inner products of vectors times 256, rounded down; the greater score comes first, of equal ones the
    smaller vec_id. Rows whose id, label or vector is null, or with a null or non-finite component, take no part. Shorter
    vectors count as if filled with zeros. Repeated rows are rows of their own, as anchors too: another row with the anchor's
    id can be its positive. An empty table gives an empty result; other columns are ignored. Scores beyond 64 bits
    are an error.
    """
    spark: SparkSession = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = taking_part(embeddings)
    size = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    dimensions, greatest = rows.agg(F.max(F.size("vector")), F.max(size)).first()
    if dimensions is None:
        return spark.createDataFrame([], schema)
    dimensions, greatest = max(1, dimensions), greatest or 0
    blocks = make_blocks(rows, dimensions, greatest, block)
    kind, path = number_type(dimensions, greatest), scratch_folder(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for anchors in anchor_slices(blocks, dimensions, kind, every):
        n = len(anchors.ids)
        best = search_all(blocks, Search(anchors, np.arange(n), np.full(n, NONE + 1), np.full(n, -NONE), True, positives)).toArrow()
        who, score = best["question"].to_numpy(), best["score"].to_numpy()
        some = score >= 0  # no score lies between 30 and 90 per cent of a negative one
        who, score, positive = who[some], score[some], best["id"].to_numpy()[some]
        window = Search(anchors, who, -(-LOW * score // 100), HIGH * score // 100, False, negatives)
        names = spark.createDataFrame(pa.table({"question": np.arange(len(who), dtype=np.int32), "anchor_id": anchors.ids[who], "positive_id": positive, "positive_score": score}))
        search_all(blocks, window).join(names, "question").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
