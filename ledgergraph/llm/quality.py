"""Text quality by kernel ridge regression on document statistics, calibrated by isotonic regression.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a text. Ridge weights solve the
normal equations, whose sums are taken per partition and added by row of the matrix. Scores of other labelled rows,
in fine bins, are then made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import numbered, pieces, stored, words_of

MAX_LABELS = 200_000  # labelled rows to learn from, in expectation; more are sampled by a hash of their id
FEATURES = 400
RIDGE = 1e-4
BINS = 2000
ACCEPT = 0.3
GROUPS = [  # kinds of bytes
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ".,;:'\"()-", "!?", "|", "*&$%#@^~",
]


def _classes() -> np.ndarray:
    table = np.full(256, len(GROUPS), np.uint8)
    for i, group in enumerate(GROUPS):
        table[list(group.encode())] = i
    table[128:] = len(GROUPS) + 1
    return table


CLASSES = _classes()
KINDS = len(GROUPS) + 2
STATISTICS = KINDS + 10


def _distinct(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: number of distinct codes, and the count of its most frequent one."""
    if not len(codes):
        return np.zeros(n), np.zeros(n)
    pairs, counts = np.unique(owner.astype(np.int64) * (int(codes.max()) + 1) + codes, return_counts=True)
    who = pairs // (int(codes.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, who, counts)
    return np.bincount(who, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of each text, one row per text: sizes, shares of kinds of bytes, repetition of words and lines."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offset[0]:offset[-1]]
    size = np.diff(offset)
    kinds = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * KINDS, size) + CLASSES[data], minlength=n * KINDS).reshape(n, KINDS)
    flat, ends = words_of(texts)
    words = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(n), words)
    coded = pc.ascii_lower(flat).dictionary_encode()
    different, commonest = _distinct(coded.indices.to_numpy(zero_copy_only=False), owner, n)
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts, "\n")
    line_count = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_kinds, line_most = _distinct(line_codes, np.repeat(np.arange(n), line_count), n)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    total = np.bincount(owner, length, n)
    return np.column_stack([
        kinds / b[:, None], np.log1p(size), np.log1p(words), total / w,
        np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / w - (total / w) ** 2, 0)),
        different / w, commonest / w, np.bincount(owner, length <= 3, n) / w,
        np.log1p(line_count), line_kinds / np.maximum(line_count, 1), line_most / np.maximum(line_count, 1)])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``row, doc_id, stats array<double>`` for ``row, doc_id, text``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = statistics(batch.column(2))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS, x.ravel())
            yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["row", "doc_id", "stats"])

    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    row = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {row}, doc_id long, stats array<double>")


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos features whose inner products approximate exp(-|x - y|^2 / (2 STATISTICS)), and a constant."""
        rng = np.random.default_rng(11)
        w = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w + phase
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _solve(rows: DataFrame, model: Model) -> np.ndarray:
    """Ridge weights from the normal equations; one row of the matrix and its right-hand side is a group."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.column_stack([z, y])
        yield pa.record_batch({"i": np.arange(FEATURES + 1), "sums": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"i": pdf["i"][:1], "sums": [total.tobytes()]})

    parts = rows.select("stats", "label").mapInArrow(sums, "i long, sums binary")
    system = np.array([np.frombuffer(r.sums) for r in sorted(parts.groupBy("i").applyInPandas(add, "i long, sums binary").collect())])
    n = system[FEATURES, FEATURES]  # the constant with itself: the number of rows
    penalty = np.append(np.full(FEATURES, RIDGE * max(n, 1)), 1e-9)
    return np.linalg.solve(system[:, :-1] + np.diag(penalty), system[:, -1])


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on ascending x with weights w: centre and value of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _calibrate(rows: DataFrame, model: Model) -> None:
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"raw": model.raw(matrix(batch.column(0))), "label": batch.column(1)})

    at = F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * BINS / 3)
    bins = (rows.select("stats", "label").mapInArrow(raw, "raw double, label double").groupBy(at.alias("bin"))
            .agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("x").collect())
    if bins:
        model.edges, model.values = pooled(*(np.array([r[k] for r in bins], float) for k in "xyn"))
    else:
        model.edges, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows outside fold 0: folds 2-4 give the weights, fold 1 the calibration."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.where(fold() != 0)
    share = min(1.0, MAX_LABELS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stored(stats.join(known, "doc_id").select("stats", "label", fold().alias("fold")), "labelled")
    weights, calibration = rows.where("fold > 1"), rows.where("fold = 1")
    moments = weights.agg(*[f(F.col("stats")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    both = np.array([x or 0.0 for x in moments]).reshape(STATISTICS, 2)
    model = Model(both[:, 0], np.where(both[:, 1] > 1e-9, both[:, 1], 1.0), np.zeros(FEATURES + 1))
    model.weights = _solve(weights, model)
    _calibrate(calibration, model)
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score texts for quality. Reads row (a key of the row), doc_id and text; labels have doc_id and quality (0, 1).

    Returns row, doc_id, held_out (fold 0, never learnt from), score (0 to 1) and predicted (1 from ``ACCEPT`` on).
    Only statistics of the text enter a score; null and empty texts are scored alike. Ids join labels to texts and
    pick folds: null ids have no label, repeated ids or labels count each time. Without labels every score is 0. An
    empty table gives an empty result; other columns are ignored.
    """
    stats = stored(with_statistics(docs), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(model.score(matrix(batch.column(2))))], names=["row", "doc_id", "score"])

    row = stats.schema["row"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"row {row}, doc_id long, score double")
    return scored.select("row", "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`quality` of any table with doc_id and text."""
    return quality(numbered(docs.select("doc_id", "text")), labels).drop("row")
