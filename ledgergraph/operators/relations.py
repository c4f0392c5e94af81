"""Relations between mentions of one sentence: pairs, type decision, confidence, context details."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.catalog import frames, relations
from ledgergraph.functions.text import explode_sentences, in_parts, once, words
from ledgergraph.operators.mentions import PARTNERS, WINDOW, confidence, label_of

THRESHOLD = 0.5
CANDIDATES, CUES = "candidates", "cues"

# The free run of words, begun only at the start of a word or where the last match ended, and without going back
# inside a word or a gap: neither loses a match, and both save most of the search.
QUICK_PHRASE = r"(?:\G|(?<!\w))(\w++(?:\s++\w++)*)"


def pairs(mentions: DataFrame, window: int = WINDOW, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Ordered pairs of mentions in one sentence that start within ``window`` characters of each other.

    The mentions must have been found with a ``reach`` of at least ``window``, or the contexts would be cut: a pair that
    reaches beyond the text that its mention carries fails. Each mention collects its partners through a range frame on the start offset. Offsets in a sentence differ,
    so a frame holds at most ``window`` rows however long the sentence is. One shuffle by document. Mentions found with
    their ``partners`` need neither the frame nor the shuffle.
    """
    if PARTNERS in mentions.columns:
        return _pairs_of_partners(mentions, window, keys)
    w = Window.partitionBy(*keys, "sent_id").orderBy("start").rangeBetween(1, window)
    partner = F.struct("start", "end", "text", "type", "confidence")
    both = (mentions.withColumn("_partners", F.collect_list(partner).over(w))
            .withColumn("t", F.explode("_partners")))
    far = F.col("t.start") - F.col("start")
    ahead = F.when(F.length("ahead") >= far, F.substring(F.col("ahead"), F.lit(1), far)).otherwise(
        F.raise_error(F.lit(f"find the mentions with a reach of {window} or more")))
    context = F.concat(ahead, F.col("t.text"))
    return both.select(
        *keys, "sent_id", F.col("start").alias("src_start"), F.col("text").alias("src_text"),
        F.col("type").alias("src_type"), F.col("confidence").alias("src_confidence"),
        F.col("t.start").alias("dst_start"), F.col("t.text").alias("dst_text"), F.col("t.type").alias("dst_type"),
        F.col("t.confidence").alias("dst_confidence"), context.alias("context"),
        *[c for c in (CANDIDATES, CUES) if c in mentions.columns]).withColumn("context", once(F.col("context")))


def _pairs_of_partners(mentions: DataFrame, window: int, keys: tuple[str, ...]) -> DataFrame:
    """The same from the partners that came with the mentions."""
    more = [c for c in (CANDIDATES, CUES) if c in mentions.columns]
    rest = [*keys, "sent_id", "start", "text", "type", "confidence", "ahead", *more]
    both = mentions.select(*rest, F.explode(PARTNERS).alias("t"))
    far = F.col("t.start") - F.col("start")
    return both.where(far <= window).select(
        *keys, "sent_id", F.col("start").alias("src_start"), F.col("text").alias("src_text"),
        F.col("type").alias("src_type"), F.col("confidence").alias("src_confidence"),
        F.col("t.start").alias("dst_start"), F.col("t.text").alias("dst_text"), label_of(F.col("t.text")).alias("dst_type"),
        confidence(F.col("t.text"), label_of(F.col("t.text"))).alias("dst_confidence"),
        F.concat(F.substring("ahead", F.lit(1), far), F.col("t.text")).alias("context"), *more).withColumn("context", once(F.col("context")))


def _any(context: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [context.rlike("(?i)" + p) for p in patterns])


def is_timed(context: Column) -> Column:
    return _any(context, relations.TIME_SIGNS)


def is_negated(context: Column) -> Column:
    return _any(context, relations.NEGATION_SIGNS)


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _fired(low: Column, some: Column | None = None) -> Column:
    """The patterns of which a verb and its own particle are both in the text, as a number with a bit for each; of ``some`` only."""
    def bit(i: int, verbs: list[str], preps: list[str]) -> Column:
        test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(v)) & F.contains(low, F.lit(p)) for v, p in zip(verbs, preps)])
        return F.when(test if some is None else _has(some, i) & test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return reduce(lambda a, b: a + b, [bit(i, verbs, preps) for i, (_, verbs, preps) in enumerate(relations.RELATION_PATTERNS)])


def _has(numbers: Column, i: int) -> Column:
    return numbers.bitwiseAND(F.lit(1 << i).cast("long")) != 0


def candidates(sentence: Column, low: Column | None = None) -> Column:
    """The patterns that any context within a sentence can have, as a number with a bit for each; 0 for none. What a context has,
    its sentence has too."""
    return _fired(F.lower(sentence) if low is None else low)


def pattern_quality(low: Column, verbs: list[str], preps: list[str]) -> Column:
    """0.6 of the share of verbs present plus 0.4 of the share of particles present."""
    def share(values):
        return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(x)), 1).otherwise(0) for x in values]) / len(values)
    return share(verbs) * 0.6 + share(preps) * 0.4


def score(pair_rows: DataFrame) -> DataFrame:
    """The best relation type of each pair with its confidence; pairs without one are left out.

    All patterns are tried inside the row, so there is no join and no shuffle. Ties go to the first declared type.
    """
    known = CANDIDATES in pair_rows.columns
    names = pair_rows.columns
    rows = (pair_rows.where(F.col(CANDIDATES) != 0) if known else pair_rows).select("*", once(F.lower("context")).alias("_low"))
    low, context = F.col("_low"), F.col("context")
    kind = F.concat_ws(">", "src_type", "dst_type")
    allowed: dict[str, list[str]] = {}
    for src, rel, dst in relations.compatibility_rows():
        allowed.setdefault(rel, []).append(f"{src}>{dst}")

    def rated(i: int, rel: str, verbs: list[str], preps: list[str]) -> Column:
        c = (F.lit(0.6) + F.when(kind.isin(*allowed.get(rel, [])), 0.2).otherwise(0.0)
             + F.when(F.length(context) < 50, 0.1).otherwise(0.0)
             + (F.col("src_confidence") + F.col("dst_confidence")) * 0.05
             + pattern_quality(low, verbs, preps) * 0.1
             + F.when(F.col("_signs.t"), 0.1).otherwise(0.0)
             - F.when(F.col("_signs.n"), 0.3).otherwise(0.0))
        return F.when(_has(F.col("_hit"), i), F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"),
                                                       F.lit(-i).alias("rank"), F.lit(rel).alias("type")))

    # Explosion keeps the optimizer from working out a value again for a filter on it or for each use.
    hit = rows.select("*", in_parts(low, _fired(low, F.col(CANDIDATES) if known else None)).alias("_fired"))
    hit = hit.select("*", once(F.col("_fired")).alias("_hit")).where(F.col("_hit") != 0)
    signs = hit.select(*names, "_low", "_hit", once(F.struct(is_timed(context).alias("t"), is_negated(context).alias("n"))).alias("_signs"))
    every = F.array(*[rated(i, *p) for i, p in enumerate(relations.RELATION_PATTERNS)])
    best = signs.select(*names, "_signs", in_parts(low, F.array_max(every)).alias("_rated")).select(*names, "_signs", once(F.col("_rated")).alias("_best"))
    return best.select(*[c for c in names if c != CANDIDATES], F.col("_signs.t").alias("is_temporal"), F.col("_signs.n").alias("is_negated"),
                       F.col("_best.type").alias("rel_type"), F.col("_best.confidence").alias("confidence"))


def extract(mentions: DataFrame, window: int = WINDOW, least: float = THRESHOLD) -> DataFrame:
    """Relations between mentions: pairs, scored, above the threshold.

    Mentions that were found with ``per_sentence={"candidates": candidates}`` save most of the work: those of sentences
    without a pattern go before the pairs are made, and a context is tried for the patterns of its sentence only.
    """
    if CANDIDATES in mentions.columns:
        mentions = mentions.where(F.col(CANDIDATES) != 0)
    return score(pairs(mentions, window)).filter(F.col("confidence") > least)


def flag(context: Column, group: str, name: str) -> Column:
    """Whether a context raises a flag. A word list is looked for as plain text first, which is quick, and only a
    context that has one of the words is searched for it as a whole word."""
    entry = relations.FLAGS[group][name]
    if entry.startswith("re:"):
        return context.rlike(_core(entry))
    return _holds(context, entry) & context.rlike(relations.flag_pattern(entry))


def _core(entry: str) -> str:
    """A pattern without the optional groups at its end, which don't matter for whether it occurs."""
    return re.sub(r"(\(\?:[^()]*\)[*?])+$", "", relations.flag_pattern(entry))


def _holds(text: Column, entry: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in entry.split("|")])


# The distinct entries of the flag table, and the place of each flag's entry among them. Sets of entries are bits of numbers of WIDTH bits.
WIDTH = 62
ENTRIES = list(dict.fromkeys(e for flags in relations.FLAGS.values() for e in flags.values()))
PLACES = {(g, n): ENTRIES.index(e) for g, flags in relations.FLAGS.items() for n, e in flags.items()}


def _bits(tests: list[Column]) -> Column:
    """The tests that hold, as an array of numbers with a bit for each; one that is null doesn't hold."""
    def number(some: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(t, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(some)])
    return F.array(*[number(tests[i:i + WIDTH]) for i in range(0, len(tests), WIDTH)])


def _bit(bits: Column, place: int) -> Column:
    return _has(F.get(bits, F.lit(place // WIDTH)), place % WIDTH)


def cues(sentence: Column, low: Column | None = None) -> Column:
    """The places of the entries of the flag table that contexts within a sentence may raise: those whose words or figures are in it at all.

    Worked out once for a sentence (``per_sentence={"cues": cues}``), it spares its many contexts all other flags.
    """
    by_word: dict[str, set[int]] = {}
    by_text: dict[str, list[int]] = {}
    by_rule: dict[str, list[int]] = {}
    for i, entry in enumerate(ENTRIES):
        if entry.startswith("re:"):
            by_rule.setdefault(_core(entry).replace(r"\b", ""), []).append(i)
            continue
        for phrase in entry.split("|"):
            first = re.search(r"[A-Za-z0-9_]+", phrase)
            if first:
                by_word.setdefault(first.group(), set()).add(i)
            else:
                by_text.setdefault(phrase, []).append(i)
    ids = lambda numbers: F.array(*[F.lit(i) for i in sorted(numbers)])
    none = F.array().cast("array<int>")
    # A whole word of a context is one of its sentence, so a phrase is looked for only if its first word is there.
    have = F.array_intersect(_texts(list(by_word)), F.split(sentence, r"\W+"))
    table = F.array(*[ids(numbers) for numbers in by_word.values()])
    words = F.flatten(F.transform(have, lambda w: F.get(table, (F.array_position(_texts(list(by_word)), w) - 1).cast("int"))))
    others = [F.when(F.contains(sentence, F.lit(t)), ids(n)).otherwise(none) for t, n in by_text.items()]
    others += [F.when(sentence.rlike(t), ids(n)).otherwise(none) for t, n in by_rule.items()]
    return F.array_sort(F.array_distinct(F.concat(words, *others)))


def raised(context: Column, some: Column | None = None) -> Column:
    """The entries of the flag table that a context raises, as bits; ``some`` has the cues of the sentence, if they are known."""
    def test(place: int, entry: str) -> Column:
        holds = context.rlike(_core(entry)) if entry.startswith("re:") else _holds(context, entry) & context.rlike(relations.flag_pattern(entry))
        return holds if some is None else F.array_contains(some, place) & holds
    return in_parts(context, _bits([test(i, e) for i, e in enumerate(ENTRIES)]))


def flag_columns(bits: Column, group: str) -> list[Column]:
    """The flags of one group as boolean columns, of the bits of :func:`raised`."""
    return [_bit(bits, PLACES[group, name]).alias(name) for name in relations.FLAGS[group]]


def details(rels: DataFrame) -> DataFrame:
    """Context details of each relation: the general flag groups, and the others where the relation type asks; words of
    sentiment and certainty; and, for relations about metrics, the metric, ratio and trend phrases."""
    some = F.col(CUES) if CUES in rels.columns else None
    rels = rels.select("*", raised(F.col("context"), some).alias("_found")).select("*", once(F.col("_found")).alias("_raised")).drop("_found")
    out = {g: F.struct(*flag_columns(F.col("_raised"), g)) for g in ("temporal", "quantitative")}
    for types, groups in relations.EXTRA_GROUPS:
        for g in groups:
            out[g] = F.when(F.col("rel_type").isin(*types), F.struct(*flag_columns(F.col("_raised"), g)))
    about = F.col("rel_type").isin(*relations.PHRASE_RELATIONS)
    phrases = {name: F.when(about, _phrase_array(patterns, groups)) for name, (patterns, groups) in PHRASES.items()}
    rows = certainty(sentiment(rels)).select("*", *[once(c).alias(f"{n}_phrases") for n, c in phrases.items()])
    last = [f"{n}_phrases" for n in phrases]
    return rows.select(*[c for c in rows.columns if c not in ("_raised", *last)], *[in_parts(F.col("_raised"), c).alias(f"{g}_details") for g, c in out.items()], *last)


def with_sentences(rels: DataFrame, docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Relations with the text of their sentence."""
    sents = explode_sentences(docs, text, list(keys)).select(*keys, "sent_id", "sentence")
    return rels.join(sents, [*keys, "sent_id"])


def flag_counts(contexts: DataFrame) -> DataFrame:
    """How many contexts raise each flag: group, flag, contexts; a zero for flags that none raises.

    Contexts are counted by the flags they raise together, and those counts by flag. Of contexts that bring the cues of their
    sentence only these are tried.
    """
    bits = raised(F.col("context"), F.col(CUES) if CUES in contexts.columns else None)
    sums = contexts.select(bits.alias("_raised")).groupBy("_raised").agg(F.count("*").alias("n"))
    rows = [(g, n, i) for (g, n), i in PLACES.items()]
    places = F.array_compact(F.array(*[F.when(_bit(F.col("_raised"), i), F.lit(i)) for i in range(len(ENTRIES))]))
    counts = sums.select("n", F.explode(places).alias("place")).groupBy("place").agg(F.sum("n").alias("contexts"))
    table = frames.local(contexts.sparkSession, rows, "group string, flag string, place int")
    return table.join(counts, "place", "left").fillna(0, ["contexts"]).select("group", "flag", "contexts")


def _count(have: Column, terms: list[str]) -> Column:
    """How many of the terms are there, each counted once."""
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(have, F.lit(t)), 1).otherwise(0) for t in dict.fromkeys(terms)])


def sentiment(contexts: DataFrame) -> DataFrame:
    """Word counts per polarity, score and label. A word in two categories counts in both."""
    every = [t for cats in relations.SENTIMENT.values() for terms in cats.values() for t in terms]
    rows = contexts.select("*", once(F.array_intersect(_texts(every), words(F.col("context")))).alias("_words"))
    for polarity, cats in relations.SENTIMENT.items():
        hits = reduce(lambda a, b: a + b, [_count(F.col("_words"), terms) for terms in cats.values()])
        rows = rows.withColumn(polarity, F.when(F.size("_words") > 0, in_parts(F.col("_words"), hits)).when(F.size("_words") == 0, 0))
    diff = F.col("positive") - F.col("negative")
    return (rows.drop("_words").withColumn("sentiment_score", diff)
            .withColumn("overall_sentiment", F.when(diff > 0, "positive").when(diff < 0, "negative")
                        .otherwise("neutral")))


def sentiment_terms(contexts: DataFrame, terms: DataFrame) -> DataFrame:
    """Long form: number of contexts per polarity, category and term, for a caller's own term table."""
    found = contexts.select(F.explode(words(F.col("context"))).alias("term"))
    return (found.groupBy("term").count().join(terms, "term")
            .select("polarity", "category", "term", F.col("count").alias("contexts")))


def certainty(contexts: DataFrame) -> DataFrame:
    have = F.col("_words")
    contexts = contexts.select("*", once(words(F.col("context"))).alias("_words"))
    high, low = _texts(relations.HIGH_CERTAINTY), _texts(relations.LOW_CERTAINTY)
    both = _texts(relations.HIGH_CERTAINTY + relations.LOW_CERTAINTY)
    return contexts.select("*", F.arrays_overlap(have, high).alias("is_high_certainty"),
                           F.arrays_overlap(have, low).alias("is_low_certainty"),
                           F.array_sort(F.array_intersect(have, both)).alias("certainty_words")).drop("_words")


# The phrase patterns of each kind, and what their groups are called.
PHRASES = {"metric": (relations.METRIC_PHRASES, ["metric", "value", "value2"]),
           "ratio": (relations.RATIO_PHRASES, ["numerator", "denominator", "value", "value2"]),
           "trend": (relations.TREND_PHRASES, ["metric", "value"])}


def _phrase_array(patterns: list[tuple[str, str]], groups: list[str]) -> Column:
    """The matches of all patterns in the context, each with its groups.

    Every pattern starts with a free run of words, which is slow to look for. So a text is searched only if the
    rest of the pattern, which is quick, is in it, and the groups are read from the short match.
    """
    def matches(name: str, rx: str) -> Column:
        n = rx.count("(") - rx.count("(?:")
        rest = "(?i)" + rx.removeprefix(relations.PHRASE)
        rx = rx.replace(relations.PHRASE, QUICK_PHRASE)
        hits = F.when(F.col("context").rlike(rest),
                      F.regexp_extract_all("context", F.lit("(?i)" + rx), F.lit(0)))
        return F.transform(hits, lambda hit: F.struct(
            F.lit(name).alias("pattern"),
            *[F.trim(F.regexp_extract(hit, "(?i)" + rx, g + 1)).alias(col) if g < n
              else F.lit(None).cast("string").alias(col) for g, col in enumerate(groups)]))

    return F.flatten(F.array_compact(F.array(*[matches(name, rx) for name, rx in patterns])))


def _phrases(contexts: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """One row per match of each pattern of a kind, its groups as columns."""
    return contexts.select(*keep, F.explode(_phrase_array(*PHRASES[kind])).alias("z")).select(*keep, "z.*")


def metric_phrases(contexts: DataFrame, keep: list[str]) -> DataFrame:
    out = _phrases(contexts, "metric", keep)
    return out.withColumn("kind", F.when(F.col("value2").isNull(), "single").otherwise("range"))


def ratio_phrases(contexts: DataFrame, keep: list[str]) -> DataFrame:
    out = _phrases(contexts, "ratio", keep)
    return out.withColumn("ratio", F.concat_ws("_to_", "numerator", "denominator")).withColumn(
        "kind", F.when(F.col("value2").isNull(), "single").otherwise("range"))


def trend_phrases(contexts: DataFrame, keep: list[str]) -> DataFrame:
    return _phrases(contexts, "trend", keep)


def statistics(rels: DataFrame) -> DataFrame:
    """Totals, mean confidence and distinct end-point pairs, in all and by relation type."""
    pair = F.struct("src", "dst")
    return (rels.rollup("rel_type")
            .agg(F.count("*").alias("relations"), F.avg("confidence").alias("average_confidence"),
                 F.count_distinct(pair).alias("unique_pairs"))
            .withColumn("rel_type", F.coalesce("rel_type", F.lit("all"))))
