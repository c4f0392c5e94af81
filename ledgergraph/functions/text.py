"""Spans of regular-expression matches, sentences and chunks, without leaving the JVM.

Positions come from the pieces of the text: splitting by a pattern gives the gaps, extracting all matches gives
the matches, and running lengths of both give the offsets. Offsets count characters from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A sentence ends at closing marks followed by white space, or at line breaks.
SENTENCE_BREAK = r"[.!?]+\s+|\n+"


BLOCK = 64


def once(value: Column) -> Column:
    """A value that is worked out once: exploding an array of one element keeps the optimizer from copying it into every use."""
    return F.explode(F.array(value))


def in_parts(of: Column, value: Column) -> Column:
    """A long expression over a column that isn't null. The lambda keeps its projection out of whole-stage code, where all of it would be
    one method, too long to be compiled to machine code; a projection of its own is cut into many."""
    return F.when(F.exists(F.array(of), lambda x: x.isNotNull()), value)


def _running(values: Column) -> Column:
    """Sum of all values before each one, by a fold that copies what it has at every step: for short arrays."""
    return F.aggregate(
        values,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )


def _cut(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep..., text and, as arrays, the gaps between matches, the matches, and where each gap starts.

    Starts of more than a block of pieces are running sums within blocks, moved by the running sums of the blocks.
    Exploding an array of one element, and a column for each array, keep the optimizer from copying the cuts into every
    use, where a lambda would compute them anew for every element.
    """
    both = F.struct(F.split(F.col(text), pattern, -1).alias("gaps"),
                    F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hits"))
    cut = df.select(*keep, F.col(text), F.explode(F.array(both)).alias("_both"))
    cut = cut.select(*keep, text, F.col("_both.gaps").alias("_gaps"), F.col("_both.hits").alias("_hits"))
    lengths = F.zip_with("_gaps", "_hits", lambda g, h: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(h), F.lit(0)))
    cut = cut.withColumn("_lengths", F.explode(F.array(lengths)))
    many = F.size("_lengths") > BLOCK
    places = F.sequence(F.lit(0), F.floor((F.size("_lengths") - 1) / BLOCK).cast("int"))
    cut = cut.withColumn("_blocks", F.when(many, F.transform(places, lambda b: F.slice("_lengths", b * BLOCK + 1, BLOCK))))
    sums = F.transform("_blocks", lambda block: F.aggregate(block, F.lit(0), lambda x, y: x + y))
    moved = F.zip_with("_blocks", _running(sums), lambda block, at: F.transform(_running(block), lambda x: x + at))
    return cut.withColumn("_starts", F.when(many, F.flatten(moved)).otherwise(_running(F.col("_lengths"))))


def explode_pieces(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """One row per gap and following match: keep..., text, pos, gap_start, gap, hit (null after the last gap)."""
    cut = _cut(df, text, pattern, keep)
    return cut.select(*keep, text, F.posexplode(F.arrays_zip("_starts", "_gaps", "_hits")).alias("pos", "_z")).select(
        *keep, text, "pos", F.col("_z._starts").alias("gap_start"), F.col("_z._gaps").alias("gap"),
        F.col("_z._hits").alias("hit"))


def explode_matches(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """One row per match: keep..., text, pos, start, end, hit."""
    return (explode_pieces(df, text, pattern, keep).filter(F.col("hit").isNotNull())
            .withColumn("start", F.col("gap_start") + F.length("gap"))
            .select(*keep, text, "pos", "start", (F.col("start") + F.length("hit")).alias("end"), "hit"))


MARK, OTHER = "\u0001", "\u0002"


def _marked(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep..., _marked (the text with a mark around every match), _pieces (gaps and matches in turn) and, of many pieces,
    _starts. The text is searched once. A mark that it has already becomes another control character for that, so the
    pattern must not tell these apart."""
    plain = F.when(F.contains(F.col(text), F.lit(MARK)), F.translate(F.col(text), MARK, OTHER)).otherwise(F.col(text))
    around = F.regexp_replace(plain, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    cut = df.select(*keep, F.explode(F.array(around)).alias("_marked"))
    cut = cut.select(*keep, "_marked", F.explode(F.array(F.split("_marked", MARK, -1))).alias("_pieces"))
    return cut.select("*", F.when(F.size("_pieces") > BLOCK, _starts_of(F.col("_pieces"))).alias("_starts"))


def _starts_of(pieces: Column) -> Column:
    """Where each of many pieces starts. The array of one array names the blocks, so that they are worked out once."""
    places = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    lengths = F.transform(places, lambda b: F.transform(F.slice(pieces, b * BLOCK + 1, BLOCK), F.length))

    def moved(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda x, y: x + y))
        return F.flatten(F.zip_with(blocks, _running(sums), lambda block, at: F.transform(_running(block), lambda x: x + at)))
    return F.get(F.transform(F.array(lengths), moved), F.lit(0))


def _start_of(pos: Column) -> Column:
    """Where a piece starts: in a short list the characters before its mark, without the marks among them."""
    return F.when(F.col("_starts").isNotNull(), F.get("_starts", pos)).otherwise(
        F.length(F.call_function("substring_index", F.col("_marked"), F.lit(MARK), pos)) - F.greatest(pos - 1, F.lit(0)))


def quick_matches(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """One row per match: keep..., start, end, hit, from one search of the text. The text isn't carried along."""
    rows = _marked(df, text, pattern, keep).select(*keep, "_marked", "_starts", F.posexplode("_pieces").alias("_pos", "hit"))
    rows = rows.where(F.col("_pos") % 2 == 1).select(*keep, _start_of(F.col("_pos")).alias("start"), "hit")
    return rows.select(*keep, "start", (F.col("start") + F.length("hit")).alias("end"), "hit")


def match_arrays(df: DataFrame, text: str, pattern: str, keep: list[str], name: str) -> DataFrame:
    """keep... and the matches of the text in order, as an array of (start, end, hit), from one search."""
    def match(i: Column) -> Column:
        return F.struct(_start_of(i).alias("start"), F.get("_pieces", i).alias("hit"))

    cut = _marked(df, text, pattern, keep).where(F.size("_pieces") > 1)
    found = F.transform(F.sequence(F.lit(1), F.size("_pieces") - 1, F.lit(2)), match)
    ended = F.transform("_found", lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.length(h["hit"])).alias("end"), h["hit"].alias("hit")))
    return cut.select(*keep, F.explode(F.array(found)).alias("_found")).select(*keep, F.explode(F.array(ended)).alias(name))


def explode_runs(df: DataFrame, text: str, pattern: str, keep: list[str], most: int) -> DataFrame:
    """One row per match with what follows: keep..., start, run (the match, then gaps and matches in turn, at most ``most`` matches).

    The text isn't carried along, so the cost is linear in it, times ``most``. Only a text that has the mark itself is cut by a lambda.
    """
    both = F.zip_with(F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))
    exact = F.when(F.contains(F.col(text), F.lit(MARK)), F.flatten(both))
    cut = _marked(df.select(*keep, text, exact.alias("_exact")), text, pattern, [*keep, "_exact"]).where(F.size("_pieces") > 1)
    rows = cut.select(*keep, "_exact", "_marked", "_starts", "_pieces", F.posexplode("_pieces").alias("_pos", "_piece")).where(F.col("_pos") % 2 == 1)
    return rows.select(*keep, _start_of(F.col("_pos")).alias("start"),
                       F.slice(F.coalesce("_exact", "_pieces"), F.col("_pos") + 1, F.least(F.lit(2 * most - 1), F.size("_pieces") - F.col("_pos") - 1)).alias("run"))


CUT = 512


def cut_line(text: Column) -> Column:
    """A long text in pieces of ``CUT`` characters, for :func:`part_of`; a short one stays whole."""
    return F.when(F.length(text) > 2 * CUT, chunks(text, CUT)).otherwise(F.array(text))


def part_of(cuts: Column, at: Column, size: Column) -> Column:
    """``size`` characters from position ``at`` (from 0) of a text in pieces, without going through the whole text."""
    first = F.when(F.size(cuts) == 1, F.lit(0)).otherwise(F.floor(at / CUT).cast("int"))
    some = F.when(F.size(cuts) == 1, F.get(cuts, F.lit(0))).otherwise(F.array_join(F.slice(cuts, first + 1, F.floor(size / CUT).cast("int") + 2), ""))
    return F.substring(some, at - first * CUT + 1, size)


def explode_sentences(df: DataFrame, text: str, keep: list[str], margin: int | None = None) -> DataFrame:
    """One row per sentence: keep..., sent_id, start, end, sentence and, with a margin, line and lead.

    The text is searched once, and no lambda runs on a text of few pieces. ``line`` has the pieces (:func:`cut_line`) of the text that
    hold the sentence and the margin on both sides; the sentence begins at its character ``lead``.
    """
    odd = F.contains(F.col(text), F.lit(MARK))  # such a text has its sentences from its own characters, not from the marked copy
    cuts = F.when(odd, cut_line(F.col(text))) if margin is None else cut_line(F.col(text))
    cut = _marked(df.select(*keep, text, odd.alias("_odd"), cuts.alias("_cuts")), text, SENTENCE_BREAK, [*keep, "_odd", "_cuts"])
    rows = cut.select(*keep, "_odd", "_cuts", "_marked", "_starts", F.posexplode("_pieces").alias("_pos", "_piece"))
    rows = rows.where((F.col("_pos") % 2 == 0) & (F.col("_piece") != "")).select(
        *keep, "_odd", "_cuts", (F.col("_pos") / 2).cast("int").alias("sent_id"), "_piece", once(_start_of(F.col("_pos"))).alias("start"))
    size = F.length("_piece")
    sentence = F.when(F.col("_odd"), part_of(F.col("_cuts"), F.col("start"), size)).otherwise(F.col("_piece"))
    out = [*keep, "sent_id", "start", (F.col("start") + size).alias("end"), sentence.alias("sentence")]
    if margin is not None:
        first = F.when(F.size("_cuts") == 1, F.lit(0)).otherwise(F.floor(F.greatest(F.col("start") - margin, F.lit(0)) / CUT).cast("int"))
        some = F.floor((size + 2 * margin) / CUT).cast("int") + 2
        out += [F.when(F.size("_cuts") == 1, F.col("_cuts")).otherwise(F.slice("_cuts", first + 1, some)).alias("line"),
                (F.col("start") - first * CUT).alias("lead")]
    return rows.select(*out)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def words(text: Column) -> Column:
    """Distinct lower-case words, cut at white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"\s+")), "")


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def capitalised(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
