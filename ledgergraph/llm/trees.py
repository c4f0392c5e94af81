"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions, each with its own tree over the ``DEPTH`` bytes before. A node of a tree
has the Krichevsky-Trofimov estimate of its counts, and mixes it evenly with the product of its children, over all
depths. These probabilities depend on counts only, so the trees come from one distributed count of strings of DEPTH + 1
bytes, and the mixture weights of every node follow from the leaves up. Contexts that end in the same two bytes share
all nodes but the topmost, so each such branch is grown and asked in one group, and only its topmost sums go further.
Scoring uses the trees as they are after training: the score of a byte depends on its string of DEPTH + 1 bytes alone.

Texts are words with A-Z lowered, joined by one blank and closed by a line feed, the end; contexts before a text are
line feeds. The same tokens make the unigram base score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import Lookup, numbered, pieces, ragged, stored, words_of

DEPTH = 5
BATCH = 500_000  # bytes that are coded at once: about 40 MB of arrays
HELD = 1 << 21  # distinct byte strings that a task counts before it sends them on
END = 10
WORDS = 1 << 18  # words whose counts are broadcast, each of at most WORD_BYTES bytes
WORD_BYTES = 64
GRAMS = 1 << 21  # byte strings whose scores are broadcast, as a hash table of 20 bytes each: 42 MB


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series eight steps up."""
    y = x + 8
    rise = np.ones_like(y)
    for i in range(8):
        rise = rise * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(rise)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any string with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """Nodes of one depth, in order of their key (context and decision): estimate of a one, its weight, logs."""

    keys: np.ndarray
    one: np.ndarray
    share: np.ndarray
    log: np.ndarray

    def mixed(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of a one at these nodes, given that one level down; nodes never seen say one half."""
        if not len(self.keys):
            return np.full(len(keys), 0.5)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.share[at] * self.one[at] + (1 - self.share[at]) * below, 0.5)


def level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None = None) -> Level:
    """Nodes from counts and the sums of their children's logs; leaves have no children."""
    log, one = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if children is None:
        return Level(keys, one, np.ones_like(one), log)
    share = 1 / (1 + np.exp(np.clip(children - log, -700, 700)))
    return Level(keys, one, share, np.logaddexp(log, children) - math.log(2))


def node_keys(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the nodes that code the last byte of each gram after ``depth`` bytes, and the bits: eight columns."""
    context = (grams >> 8) & ((1 << 8 * depth) - 1)
    byte, t = (grams & 0xFF)[:, None], np.arange(8)
    return context[:, None] << 8 | ((1 << t) - 1 + (byte >> (8 - t))), byte >> (7 - t) & 1


def parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions after ``depth`` bytes: the far byte of the context goes."""
    return (keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | keys & 0xFF


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of each column of values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(at, v, len(distinct)) for v in values)


class Branch:
    """Levels DEPTH down to 2 of all contexts that end in the same two bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        keys, bits = node_keys(grams, DEPTH)
        n = np.broadcast_to(counts[:, None], bits.shape)
        keys, zeros, ones = summed(keys.ravel(), (n * (1 - bits)).ravel(), (n * bits).ravel())
        self.levels = [level(keys, zeros, ones)]
        for depth in range(DEPTH - 1, 1, -1):
            keys, zeros, ones, logs = summed(parents(keys, depth), zeros, ones, self.levels[-1].log)
            self.levels.append(level(keys, zeros, ones, logs))
        self.top = pd.DataFrame({"key": parents(keys, 1), "zeros": zeros, "ones": ones, "log": self.levels[-1].log})

    def score(self, grams: np.ndarray, top: list[Level]) -> np.ndarray:
        """log10 probability of the last byte of each gram; ``top`` has the levels of one byte and of none."""
        p = 0.5
        for depth, nodes in zip(range(DEPTH, -1, -1), [*self.levels, *top], strict=True):
            keys, bits = node_keys(grams, depth)
            p = nodes.mixed(keys.ravel(), np.broadcast_to(p, keys.shape).ravel()).reshape(keys.shape)
        return np.log10(np.where(bits == 1, p, 1 - p)).sum(1)


def branches(grams: DataFrame):
    return grams.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("branch"))


def grow_top(grams: DataFrame) -> list[Level]:
    """The levels of one byte and of none: at most 257 x 255 nodes, from the topmost sums of all branches."""

    def tops(pdf: pd.DataFrame) -> pd.DataFrame:
        return Branch(pdf["gram"].to_numpy(), pdf["n"].to_numpy()).top

    found = (branches(grams).applyInPandas(tops, "key long, zeros double, ones double, log double").groupBy("key")
             .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log")).toPandas().sort_values("key"))
    keys, zeros, ones, logs = (found[c].to_numpy() for c in found.columns)
    one = level(keys.astype(np.int64), zeros, ones, logs)
    keys, zeros, ones, logs = summed(parents(one.keys, 0), zeros, ones, one.log)
    return [one, level(keys, zeros, ones, logs)]


def gram_scores(grams: DataFrame, top, new: bool = False) -> DataFrame:
    """``gram, n, log`` for counted grams, or with ``new`` for the rows of ``grams`` whose n is 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["n"] > 0]
        asked = pdf[pdf["n"] == 0] if new else known
        log = Branch(known["gram"].to_numpy(), known["n"].to_numpy()).score(asked["gram"].to_numpy(), top.value)
        return pd.DataFrame({"gram": asked["gram"], "n": asked["n"], "log": log})

    return branches(grams).applyInPandas(run, "gram long, n long, log double")


def streams(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, where each text's words end; the bytes to code, each text after DEPTH line feeds; and where
    each text's bytes end."""
    flat, ends = words_of(pc.ascii_lower(texts))
    spaced = pc.binary_join_element_wise(flat, "", " ").cast(pa.large_string())
    n = len(ends)
    offset = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
    at = np.concatenate([[0], offset[ends]])
    size = np.diff(at)
    stops = np.cumsum(np.maximum(size, 1) + DEPTH)
    out = np.full(int(stops[-1]) if n else 0, END, np.uint8)
    if len(spaced):
        out[ragged(stops - np.maximum(size, 1), size)] = np.frombuffer(spaced.buffers()[2], np.uint8)[:offset[-1]]
    out[stops - 1] = END
    return flat, ends, out, stops


def coded(stops: np.ndarray) -> np.ndarray:
    """True for the bytes of a stream that are coded, false for the line feeds before each text."""
    mask = np.ones(int(stops[-1]) if len(stops) else 0, bool)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    for i in range(DEPTH):
        mask[starts + i] = False
    return mask


def grams_of(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes up to each coded byte, as one number."""
    wide = data.astype(np.int64)
    key = wide[:len(wide) - DEPTH]
    for i in range(1, DEPTH + 1):
        key = key << 8 | wide[i:len(wide) - DEPTH + i]
    return key[mask[DEPTH:]]


def strings(data: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings of a stream with the text each is of, in parts of bounded size however long a text is."""
    mask = coded(stops)
    for at in range(0, len(data), BATCH):
        start = max(0, at - DEPTH)
        part = slice(start, at + BATCH)
        yield grams_of(data[part], mask[part]), np.searchsorted(stops, start + DEPTH + np.flatnonzero(mask[part][DEPTH:]), "right")


def gather(docs: DataFrame) -> DataFrame:
    """``gram long, word string, n long``: counts of all strings of DEPTH + 1 bytes and of all words (the end is the
    empty word) in ``docs (text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in pieces(batches, "text", BATCH):
            flat, ends, data, stops = streams(batch.column(0))
            for key, _ in strings(data, stops):
                held.append(np.unique(key, return_counts=True))
                if sum(len(h[0]) for h in held) > HELD // 4:
                    grams, counts = added([(grams, counts), *held])
                    held = []
                    if len(grams) > HELD:  # as much as a task holds; the rest is added after the shuffle
                        yield from told(grams, counts)
                        grams, counts = grams[:0], counts[:0]
            words = flat.value_counts()
            yield pa.record_batch({
                "gram": pa.nulls(len(words) + 1, pa.int64()),
                "word": pa.concat_arrays([words.field(0).cast(pa.string()), pa.array([""])]),
                "n": pa.concat_arrays([words.field(1), pa.array([len(ends)], pa.int64())])})
        yield from told(*added([(grams, counts), *held]))

    def told(grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(grams), 100_000):
            part = grams[at:at + 100_000]
            yield pa.record_batch({"gram": part, "word": pa.nulls(len(part), pa.string()), "n": counts[at:at + 100_000]})

    found = docs.select("text").mapInArrow(run, "gram long, word string, n long")
    return found.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text is 1 modulo 5; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)) == 1


def score(docs: DataFrame) -> DataFrame:
    """Score every whole text with trees and word counts from the texts that aren't held out.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens,
    base_score (unigram, log10), score (log10 probability by the trees) and bits_per_byte (code length). Null texts
    count as empty; repeated rows and null ids are scored each; an empty table gives an empty result; columns other
    than doc_id and text are ignored.

    Scores of the most frequent grams and counts of the most frequent words are broadcast, up to a fixed number of
    them; all others are joined with the few documents that hold them.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    counts = stored(gather(rows.where(~held_out(F.col("doc_id")))), "language-counts")
    words, grams = counts.where("word IS NOT NULL").select("word", "n"), counts.where("gram IS NOT NULL").select("gram", "n")
    n_words, n_all = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    below = math.log10(n_all + 0.5 * (n_words + 1))

    top = spark.sparkContext.broadcast(grow_top(grams))
    logs = stored(gram_scores(grams, top), "gram-scores")
    common = logs.where(F.col("n") >= least_frequent(logs, GRAMS)).select("gram", F.col("log").cast("float").alias("log")).toArrow()
    short = words.where(F.octet_length("word") <= WORD_BYTES)
    frequent = short.where(F.col("n") >= least_frequent(short, WORDS)).toArrow()
    table = Lookup(np.float32, common.num_rows)
    table.add(common["gram"].to_numpy(), common["log"].to_numpy())
    shared = spark.sparkContext.broadcast((table, frequent["word"].combine_chunks(), np.log10(frequent["n"].to_numpy() + 0.5)))
    known_end = int(n_all > 0)
    end = words.where("word = ''").select("n").first()
    end_log = math.log10((end.n if end else 0) + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names, values = shared.value
        for batch in pieces(batches, "text", BATCH):
            flat, ends, data, stops = streams(batch.column(2))
            n, size = len(ends), np.diff(stops, prepend=0) - DEPTH
            score, new, whose = np.zeros(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, owner in strings(data, stops):
                value, unknown = table.find(key)
                score += np.bincount(owner, value, n)
                new.append(key[unknown])
                whose.append(owner[unknown])
            rare, times, cuts = occurrences(np.concatenate(whose), np.concatenate(new), n)
            out = {"row": batch.column(0), "doc_id": batch.column(1), "bytes": size, "score": score,
                   "grams": pa.ListArray.from_arrays(cuts, rare), "gram_times": pa.ListArray.from_arrays(cuts, times)}
            count = np.diff(ends, prepend=0)
            owner = np.repeat(np.arange(n), count)
            different = flat.dictionary_encode()
            place = pc.fill_null(pc.index_in(different.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False)
            code = different.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = place[code] if len(code) else code
            known = at >= 0
            rare, times, cuts = occurrences(owner[~known], code[~known], n)
            yield pa.record_batch(out | {
                "n_tokens": count + 1, "n_known": np.bincount(owner[known], minlength=n) + known_end,
                "base": np.bincount(owner[known], values[at[known]], n) + end_log,
                "words": pa.ListArray.from_arrays(cuts, different.dictionary.take(rare).cast(pa.string())),
                "word_times": pa.ListArray.from_arrays(cuts, times)})

    done = stored(rows.select("row", "doc_id", "text").mapInArrow(run, (
        "row long, doc_id long, bytes long, score double, grams array<long>, gram_times array<long>, n_tokens long, "
        "n_known long, base double, words array<string>, word_times array<long>")), "scored")
    each = lambda kind: (done.select("row", F.explode(F.arrays_zip(f"{kind}s", f"{kind}_times")).alias("p"))
                         .select("row", F.col(f"p.{kind}s").alias(kind), F.col(f"p.{kind}_times").alias("times")))
    more_words = each("word").join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    new = each("gram").select("gram").distinct().join(grams, "gram", "left_anti").select("gram", F.lit(0).cast("long").alias("n"))
    every = logs.select("gram", "log").union(gram_scores(grams.union(new), top, new=True).select("gram", "log"))
    more_grams = each("gram").join(every, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return done.join(more_words, "row", "left").join(more_grams, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), score.alias("score"),
        (-score * math.log2(10) / F.col("bytes")).alias("bits_per_byte"))


def occurrences(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct values of each of ``n`` owners with their counts, flat, and where the owners' lists begin."""
    distinct, code = np.unique(values, return_inverse=True)
    kinds = max(1, len(distinct))
    pairs, times = np.unique(owner * kinds + code, return_counts=True)
    cuts = np.searchsorted(pairs, np.arange(n + 1) * kinds).astype(np.int32)
    return pa.array(distinct[pairs % kinds] if len(pairs) else np.zeros(0, np.int64)), pa.array(times.astype(np.int64)), pa.array(cuts)


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least n so that at most ``most`` rows have n or more (n above 2^20 counts as that)."""
    least, size = (1 << 20) + 1, 0
    for n, c in sorted(counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().collect(), reverse=True):
        size += c
        if size > most:
            break
        least = n
    return least
