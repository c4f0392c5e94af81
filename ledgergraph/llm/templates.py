"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Windows of template tokens are hashed and joined with the benchmark's, so a question whose parameters were changed
still meets its original. What stands in the placeholders then has to map one to one: the same value of the item to
the same value of the document, and back.

The first word of a sentence or line may be capitalised for its place or as a name: windows are hashed by both readings.
An item that has no window with literals enough is looked up by windows of its plain words instead, values included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.llm.common import numbered, pieces, stored, words_of

WINDOW = 8
LITERALS = 5  # of a window of WINDOW tokens that must not be placeholders
SHORTEST = 4  # items of fewer tokens have no template window
SHARE = 0.3  # of an item's windows that a document must hold
AGREEMENT = 0.7  # of the slots that must map one to one
SLICE = 4_000_000  # window hashes that are broadcast at once: 32 MB

TRIMMED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¿¡"
# Fixed values.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
                "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
                "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion"]
UNITS = ["mm", "cm", "m", "km", "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers",
         "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram",
         "kilograms", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "litre", "litres", "liter", "liters",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year",
         "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh"]
LITERAL, NUMBER, UNIT, NAME = range(4)
_NUMBER = r"^[0-9]+([.,:/][0-9]+)*(st|nd|rd|th|%|[a-z]{1,3})?$"
_NAME = r"^\p{Lu}[\p{Ll}'’-]+$"
BASE = np.uint64(0x9E3779B97F4A7C15)
LINE = "\x1e"  # stands for a line break among the words


@dataclass
class Tokens:
    """Template tokens of a batch: hash, hash of the plain word, kind, whether a literal may be a name, code of the word
    in ``words``; where each text's tokens end."""

    hashes: np.ndarray
    plain: np.ndarray
    kinds: np.ndarray
    unsure: np.ndarray
    codes: np.ndarray
    ends: np.ndarray
    words: pa.Array


def tokens_of(texts: pa.Array) -> Tokens:
    """Words without the marks around them, lowered; numbers, units after a number and names within a sentence typed.

    Capitalised words at the start of a text, a sentence or a line stay literal and are unsure.
    """
    flat, ends = words_of(pc.replace_substring_regex(texts, "[\n\x0b\x0c\r\u0085\u2028\u2029]+", f" {LINE} "))
    line = pc.equal(flat, LINE).to_numpy(zero_copy_only=False).astype(bool)
    fresh = np.concatenate([[False], line])[:-1][~line]  # the first word of a line
    flat, ends = flat.filter(pa.array(~line)), np.concatenate([[0], np.cumsum(~line)])[ends]
    coded = flat.dictionary_encode()
    index, raw = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    core = pc.utf8_trim(raw, characters=TRIMMED)
    lower = pc.utf8_lower(core)
    flag = lambda a: a.to_numpy(zero_copy_only=False).astype(bool)
    number = flag(pc.or_(pc.match_substring_regex(lower, _NUMBER), pc.is_in(lower, pa.array(NUMBER_WORDS))))
    unit = flag(pc.is_in(lower, pa.array(UNITS)))
    name = flag(pc.match_substring_regex(core, _NAME))
    stops = flag(pc.match_substring_regex(raw, r"[.!?:][\"')”’]*$"))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in lower.to_pylist()), np.uint64, len(lower))
    full = flag(pc.greater(pc.binary_length(core), 0))

    begins = np.zeros(len(index) + 1, bool)
    begins[np.concatenate([[0], ends])] = True
    first = np.concatenate([[True], stops[index]])[:-1] | begins[:-1] | fresh  # of a sentence
    kinds = np.zeros(len(index), np.int8)
    kinds[name[index] & ~first] = NAME
    kinds[number[index]] = NUMBER
    after = np.concatenate([[False], kinds == NUMBER])[:-1] & ~begins[:-1]
    kinds[unit[index] & after] = UNIT
    unsure = name[index] & first & (kinds == LITERAL)

    keep = full[index]
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    index, kinds = index[keep], kinds[keep]
    plain = hashes[index]
    typed = plain.copy()
    for kind in (NUMBER, UNIT, NAME):
        typed[kinds == kind] = np.uint64(kind)
    return Tokens(typed, plain, kinds, unsure[keep], index, ends, lower)


def windows_of(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and reading of every window of ``size`` tokens that lies in one text and has literals enough.

    Bit i of a reading is set if token i, which is unsure, is read as a name; a window has a row for each reading. A
    negative size means windows of so many plain words, whatever they are.
    """
    exact, size = size < 0, abs(size)
    n = len(t.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = t.plain if exact else t.hashes
    total, literals, cut = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(len(t.hashes) + 1, np.int64)
    for i in range(size):
        total = total * BASE + hashes[i:i + n]
        literals += t.kinds[i:i + n] == LITERAL
    cut[t.ends] = 1
    crossed = np.cumsum(cut)
    spare = literals * WINDOW - LITERALS * size
    at = np.flatnonzero((crossed[np.arange(n) + size - 1] == crossed[:n]) & (exact | (spare >= 0)))
    total, spare, reading = total[at], spare[at], np.zeros(len(at), np.int64)
    if exact:
        return at, total ^ np.uint64(1 << 32 | size), reading
    power = 1
    for i in reversed(range(size)):
        more = np.flatnonzero(t.unsure[at + i] & (spare >= WINDOW))
        named = total[more] + (np.uint64(NAME) - t.hashes[at[more] + i]) * np.uint64(power)
        at, total, spare, reading = (np.concatenate(x) for x in (
            (at, at[more]), (total, named), (spare, spare[more] - WINDOW), (reading, reading[more] | 1 << i)))
        power = power * int(BASE) % (1 << 64)
    return at, total ^ np.uint64(size), reading


def _slots(t: Tokens, starts: np.ndarray, size: int, reading: np.ndarray) -> list[list[str | None]]:
    if size < 0:
        return [[None] * -size] * len(starts)
    at = starts[:, None] + np.arange(size)
    codes = np.where((t.kinds[at] != LITERAL) | (reading[:, None] >> np.arange(size) & 1 == 1), t.codes[at], -1)
    used = np.unique(codes[codes >= 0])
    words = dict(zip(used.tolist(), t.words.take(pa.array(used)).to_pylist(), strict=True))
    return [[words.get(c) for c in row] for row in codes.tolist()]


def item_windows(items: DataFrame) -> DataFrame:
    """``item (a number per row), item_id, windows, size, at, hash, slots`` of benchmark items (item_id, text).

    ``size`` is negative for windows of plain words. ``windows`` counts the places of an item that have a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            t = tokens_of(batch.column(2))
            starts = np.concatenate([[0], t.ends[:-1]])
            size_of = np.minimum(t.ends - starts, WINDOW)
            found = np.zeros(len(starts), bool)
            for size in (*np.unique(size_of[size_of >= SHORTEST]).tolist(), *range(-WINDOW, 0)):
                at, hashes, reading = windows_of(t, size)
                owner = np.searchsorted(t.ends, at, "right")
                mine = (size_of[owner] == abs(size)) & (~found[owner] if size < 0 else True)
                at, hashes, reading, owner = at[mine], hashes[mine], reading[mine], owner[mine]
                found[owner] |= size > 0
                take = pa.array(owner)
                yield pa.record_batch({
                    "item": batch.column(0).take(take), "item_id": batch.column(1).take(take),
                    "windows": np.bincount(owner[reading == 0], minlength=len(starts))[owner].astype(np.int64), "size": np.full(len(at), size, np.int64),
                    "at": at - starts[owner], "hash": hashes.view(np.int64), "slots": pa.array(_slots(t, at, size, reading), pa.list_(pa.string()))})

    items = numbered(items.select("item_id", "text"), "item")
    items = items.select("item", F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, "item long, item_id long, windows long, size long, at long, hash long, slots array<string>")


def matched_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``row, doc_id, place, hash, values`` of the windows of ``docs (row, doc_id, text)`` that an item has too.

    Hashes of the items are broadcast in slices of bounded size, one pass over the documents for each slice.
    """
    sizes = [r[0] for r in windows.select("size").distinct().collect()]
    slices = -(-max(1, windows.count()) // SLICE)
    row = docs.schema["row"].dataType.simpleString()
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for i in range(slices):
        part = windows.where(F.pmod("hash", F.lit(slices)) == i).select("hash").distinct().toArrow()["hash"].to_numpy()
        known = docs.sparkSession.sparkContext.broadcast(np.sort(part.view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            wanted = known.value
            for batch in pieces(batches):
                t = tokens_of(batch.column(2))
                starts = np.concatenate([[0], t.ends[:-1]])
                for size in sizes if len(wanted) else ():
                    at, hashes, reading = windows_of(t, size)
                    place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    hit = wanted[place] == hashes
                    at, hashes, reading = at[hit], hashes[hit], reading[hit]
                    owner = np.searchsorted(t.ends, at, "right")
                    take = pa.array(owner)
                    yield pa.record_batch({
                        "row": batch.column(0).take(take), "doc_id": batch.column(1).take(take), "place": at - starts[owner],
                        "hash": hashes.view(np.int64), "values": pa.array(_slots(t, at, size, reading), pa.list_(pa.string()))})

        one = docs.mapInArrow(run, f"row {row}, doc_id long, place long, hash long, values array<string>")
        found = one if found is None else found.union(one)
    return found


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, agreement: float = AGREEMENT) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other parameters.

    Reads row (a key of the row), doc_id and text of ``docs`` and item_id and text of ``items``. Returns a row per
    document and item: row, doc_id, item_id, share (of the item's windows found), slots (placeholders compared),
    agreement (share of them that map one to one) and verbatim (all slots have their own value). Matches are taken
    along runs where document and item go in step; a run whose slots disagree doesn't count. Null texts have no
    windows; items without a template window (fewer than ``SHORTEST`` tokens, or too few literals in every window) are
    found with their own values only, by windows of plain words, and have no slots; items of fewer than ``WINDOW``
    tokens match whole; items without words can't be found; null ids are kept; repeated rows match each; empty tables give an empty result; other columns are ignored.
    """
    windows = stored(item_windows(items), "item-windows")
    found = stored(matched_windows(docs, windows), "matched-windows")
    run = ["row", "item", "step"]
    pairs = found.join(windows, "hash").withColumn("step", F.col("place") - F.col("at"))
    pairs = stored(pairs.select("row", "doc_id", "item", "item_id", "windows", "step", "at", "slots", "values"), "pairs")

    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size("slots") - 1).alias("i"), F.col("slots").alias("own"), F.col("values").alias("value"))
    slots = (pairs.where(F.exists("slots", lambda x: x.isNotNull()))
             .select(*run, "at", F.explode(F.filter(zipped, lambda s: s["own"].isNotNull())).alias("s"))
             .select(*run, (F.col("at") + F.col("s.i")).alias("token"), F.col("s.own").alias("own"), F.col("s.value").alias("value")).distinct())
    mapped = slots.groupBy(*run, "own", "value").agg(F.count(F.lit(1)).alias("n"))
    # The commonest partner each way; a run has no more slot words than its item.
    forth = F.row_number().over(Window.partitionBy(*run, "own").orderBy(F.desc("n"), "value"))
    back = F.row_number().over(Window.partitionBy(*run, "value").orderBy(F.desc("n"), "own"))
    judged = mapped.select("*", ((forth == 1) & (back == 1)).alias("one")).groupBy(*run).agg(
        F.sum("n").alias("slots"), F.sum(F.when(F.col("one"), F.col("n")).otherwise(0)).alias("agree"),
        F.sum(F.when(F.col("own") == F.col("value"), 0).otherwise(1)).alias("changed"))
    runs = pairs.groupBy(*run, "doc_id", "item_id", "windows", "at").count().drop("count").join(judged, run, "left")
    sound = runs.where(F.col("slots").isNull() | (F.col("agree") >= agreement * F.col("slots")))
    per_run = sound.select(*run, "doc_id", "item_id", "windows", "slots", "agree", "changed").distinct()
    covered = sound.select("row", "item", "at").distinct().groupBy("row", "item").agg(F.count(F.lit(1)).alias("covered"))
    totals = per_run.groupBy("row", "doc_id", "item", "item_id", "windows").agg(
        F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.coalesce(F.sum("agree"), F.lit(0)).alias("agree"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))
    return (totals.join(covered, ["row", "item"]).where(F.col("covered") >= share * F.col("windows"))
            .select("row", "doc_id", "item_id", (F.col("covered") / F.col("windows")).alias("share"), "slots",
                    F.when(F.col("slots") > 0, F.col("agree") / F.col("slots")).otherwise(1.0).alias("agreement"),
                    (F.col("changed") == 0).alias("verbatim")))


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`leaks` of any tables with doc_id and text, and item_id and text."""
    return leaks(numbered(docs.select("doc_id", "text")), items).drop("row")
