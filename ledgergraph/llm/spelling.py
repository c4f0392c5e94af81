"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form each rare one goes back to.

Of two words one edit apart, the longer one (either, if they are as long) contributes two disjoint chunks, its halves: the
edit lies in one of them and preserves the other. The other word contributes its positional grams of the chunk's length. A
preserved chunk stands at the same place in it or, behind the edit, as far to the left as the word is shorter, so the places
differ by none or one. The half with the edit is in turn two words one edit apart, and the same holds within it: so the key
of a join is the preserved half and the preserved half of the other half, which is all but about a quarter of the word.
Words with a common first half, thousands for a frequent prefix, thus meet only if they differ in one quarter. Meetings are
verified by the edit distance of the whole words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import stored

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5  # a form occurs at least so many times as often
SLIP = 199  # one run of a document in so many loses a code point
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where the hash of document and run is divisible by ``SLIP``."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(mark, F.char_length(run).cast("long")).cast("int")
    return F.when(F.pmod(mark, F.lit(SLIP)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word string, n long``: the words of all whole texts with at least ``length`` code points and ``count`` occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = runs.select("doc_id", lowered.alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def cuts(length: Column) -> list[Column]:
    """Places that cut a word of this length into halves, and these into halves again."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def keys(word: Column, longer: int) -> Column:
    """Keys of ``word`` as a word that is ``longer`` code points shorter than its chunks' word; none longer: also of that word.

    Each key leaves one quarter of the chunks' word out: what stands before it keeps its place, what follows is shifted.
    """
    at = cuts(F.char_length(word) + longer)
    size = F.char_length(word) + longer

    def key(j: int) -> Column:
        before = F.substring(word, F.lit(1), at[j].cast("int"))
        after = F.substring(word, (at[j + 1] - longer + 1).cast("int"), size.cast("int"))
        return F.xxhash64(size, F.lit(j), before, after)

    return F.array(*(key(j) for j in range(4)))


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` of ``words (word, n)``: all ordered pairs that differ by exactly one code point."""
    chunks = words.select("word", "n", F.explode(keys(F.col("word"), 0)).alias("key"))
    grams = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(F.concat(keys(F.col("word"), 0), keys(F.col("word"), 1))).alias("key"))
    met = chunks.join(grams, "key").where(
        (F.char_length("word") > F.char_length("near")) | ((F.char_length("word") == F.char_length("near")) & (F.col("word") < F.col("near"))))
    found = met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.inline(both))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``links (word, form)``: the end of each chain of forms.

    Counts grow along a chain by ``RATIO``, so it has no loop and at most 26 links; each round doubles the reach.
    """
    reach = links.select("word", F.col("form").alias("root"))
    while not reach.join(links.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = stored(reach.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return reach


def variants(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """The words of ``docs (doc_id, text)``, their near words and the forms they go back to.

    Returns ``word, n, n_near, form, form_n, root``: n_near words are one inserted, deleted or replaced code point away; the
    form is the most frequent of them (ties: the smallest in code-point order) if it occurs at least ``ratio`` times as
    often; the root is the last form of the chain, the word itself if there is none.

    A null text has no words, a null id counts as the empty text in the hash, repeated rows count each, an empty table gives
    no words; columns other than doc_id and text are ignored.
    """
    words = stored(vocabulary(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, count), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = F.col("best.near_n") >= ratio * F.col("n")
    known = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n")), "forms")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
