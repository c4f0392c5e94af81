"""Queries on text: mentions (B), sentences and pairs (C1-C3), relation scoring (D), their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergraph.catalog import frames, kinds, relations
from ledgergraph.functions.text import SENTENCE_BREAK, once
from ledgergraph.operators import mentions as m
from ledgergraph.operators import relations as r
from ledgergraph.plans import sql
from ledgergraph.plans.registry import query
from ledgergraph.sources import bindings as b
from ledgergraph.sources.tables import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The statements, with the names in them looked up."""
    return m.confirm_texts(b.statements(spark, sf), b.company_names(spark, sf))


def _mentions(spark: SparkSession, sf: str, context: bool = False, **per_sentence) -> DataFrame:
    return m.find_mentions(_texts(spark, sf), per_sentence=per_sentence, context=context)


def _pairs(spark: SparkSession, sf: str, **per_sentence) -> DataFrame:
    return m.find_pairs(_texts(spark, sf), per_sentence=per_sentence)


def _scored(spark: SparkSession, sf: str, **more) -> DataFrame:
    """All pairs with their best relation type."""
    return r.score(_pairs(spark, sf, **{r.CANDIDATES: r.candidates}, **more))


def _relations(spark: SparkSession, sf: str, **more) -> DataFrame:
    return _scored(spark, sf, **more).filter(F.col("confidence") > r.THRESHOLD)


MENTIONS = "WITH " + sql.STATEMENT_MENTIONS
RELATIONS = MENTIONS + ", " + sql.pairs() + ", " + sql.relations_cte()


@query(MENTIONS + """
SELECT doc_id, page, CAST(sent_id AS BIGINT) AS sent_id, CAST("start" AS BIGINT) AS start_at,
  CAST("end" AS BIGINT) AS end_at, text, type FROM mentions""")
def b1_mentions(spark, sf):
    return _mentions(spark, sf).select("doc_id", "page", F.col("sent_id").cast("long").alias("sent_id"),
                                       F.col("start").cast("long").alias("start_at"),
                                       F.col("end").cast("long").alias("end_at"), "text", "type")


# The checking SQL knows word ends of ASCII words only, so it reads an underscore, a character of words, for each other letter.
_ASCII_DOCS = "docs AS (SELECT doc_id, regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g') AS text FROM documents)"


@query(f"WITH {_ASCII_DOCS}, " + sql.mentions("docs", "doc_id", "text", names=False) + """
SELECT doc_id, CAST("start" AS BIGINT) AS start_at, text, type FROM mentions""")
def b1_mentions_in_documents(spark, sf):
    """Candidates for mentions in the free texts."""
    found = m.find_mentions(table(spark, sf, "documents").select("doc_id", "text"), keep=("doc_id",))
    return found.select("doc_id", F.col("start").cast("long").alias("start_at"), "text", "type")


@query(MENTIONS + f"""
SELECT type, count(*) AS mentions FROM mentions WHERE type IN ({sql.LABELS}) GROUP BY type""")
def b2_known_labels(spark, sf):
    return m.known_labels(_mentions(spark, sf)).groupBy("type").agg(F.count("*").alias("mentions"))


@query(MENTIONS + """
SELECT type, text, round(max(confidence), 6) AS confidence, count(*) AS mentions FROM mentions GROUP BY type, text""")
def b3_mention_confidence(spark, sf):
    return _mentions(spark, sf).groupBy("type", "text").agg(
        F.round(F.max("confidence"), 6).alias("confidence"), F.count("*").alias("mentions"))


@query(MENTIONS + """
SELECT doc_id, page, CAST("start" AS BIGINT) AS start_at,
  substring(doc_text, CAST(greatest(0, "start" - 50) + 1 AS BIGINT),
    CAST("end" + 50 - greatest(0, "start" - 50) AS BIGINT)) AS context FROM mentions""")
def b4_mention_context(spark, sf):
    return _mentions(spark, sf, context=True).select("doc_id", "page", F.col("start").cast("long").alias("start_at"), "context")


@query(MENTIONS + """
SELECT text AS name, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM mentions
WHERE type = 'COMPANY' GROUP BY text""")
def b5_known_companies(spark, sf):
    return (_mentions(spark, sf).filter("type = 'COMPANY'").groupBy(F.col("text").alias("name"))
            .agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents")))


# Names of several words: the first three words of each benchmark text, as companies and persons in turn.
_NAMES = f"""names AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '{m.NAME_WORD}')[1:3] AS w,
  CASE WHEN item_id % 2 = 0 THEN 'COMPANY' ELSE 'PERSON' END AS label FROM benchmark)"""


@query("WITH " + sql.sentences("documents", "doc_id, text") + f""", {_NAMES},
known AS (SELECT array_to_string(w, ' ') AS name, min(label) AS type FROM names GROUP BY 1),
lines AS (SELECT doc_id, sent_id, ' ' || array_to_string(regexp_extract_all(lower(sentence), '{m.NAME_WORD}'), ' ') || ' ' AS line FROM sents)
SELECT DISTINCT doc_id, CAST(sent_id AS BIGINT) AS sent_id, name, type FROM lines JOIN known ON contains(line, ' ' || name || ' ')""")
def b5_names_of_any_form(spark, sf):
    """Names of several words, companies and persons, found in the free texts."""
    first = F.array_join(F.slice(m.name_words(F.col("text")), 1, 3), " ")
    names = table(spark, sf, "benchmark").select(first.alias("name"), F.when(F.col("item_id") % 2 == 0, "COMPANY").otherwise("PERSON").alias("label"))
    found = m.known_names(table(spark, sf, "documents").select("doc_id", "text"), names, keep=("doc_id",))
    return found.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join(m.name_words(F.col("text")), " ").alias("name"), "type").distinct()


_TERM = "the"


@query("WITH " + sql.pieces("documents", "doc_id", f"(?i){_TERM}", "p") + """
SELECT doc_id, CAST(gap_start + length(gap) AS BIGINT) AS start_at FROM p WHERE hit IS NOT NULL""")
def b10_search_in_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return m.search(docs, _TERM).select("doc_id", F.col("start").cast("long").alias("start_at"))


@query("WITH " + sql.sentences("documents", "doc_id") + """
SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(sent_start AS BIGINT) AS start_at,
  CAST(sent_end AS BIGINT) AS end_at, md5(sentence) AS sentence_md5 FROM sents""")
def c1_sentences(spark, sf):
    s = m.sentences(table(spark, sf, "documents").select("doc_id", "text"))
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"),
                    F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"),
                    F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


@query("WITH " + sql.sentences("documents", "doc_id") + ", "
       + sql.pieces("documents", "doc_id", f"(?i){_TERM}", "p") + """
SELECT p.doc_id, CAST(gap_start + length(gap) AS BIGINT) AS start_at, CAST(s.sent_id AS BIGINT) AS sent_id
FROM p JOIN sents s ON p.doc_id = s.doc_id AND gap_start + length(gap) >= s.sent_start
  AND gap_start + length(gap) < s.sent_end WHERE hit IS NOT NULL""")
def c2_marks_in_sentences(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marks = m.search(docs, _TERM).withColumn("term", F.lit(_TERM))
    return m.place_in_sentences(marks, m.sentences(docs)).select(
        "doc_id", F.col("start").cast("long").alias("start_at"), F.col("sent_id").cast("long").alias("sent_id"))


@query(MENTIONS + ", " + sql.pairs() + """
SELECT doc_id, page, CAST(src_start AS BIGINT) AS src_start, CAST(dst_start AS BIGINT) AS dst_start, src_type, dst_type,
  context FROM pairs""")
def c3_mention_pairs(spark, sf):
    return _pairs(spark, sf).select(
        "doc_id", "page", F.col("src_start").cast("long").alias("src_start"),
        F.col("dst_start").cast("long").alias("dst_start"), "src_type", "dst_type", "context")


@query(RELATIONS + """
SELECT doc_id, page, CAST(src_start AS BIGINT) AS src_start, CAST(dst_start AS BIGINT) AS dst_start, rel_type FROM rels""")
def d1_relation_types(spark, sf):
    return _scored(spark, sf).select(
        "doc_id", "page", F.col("src_start").cast("long").alias("src_start"),
        F.col("dst_start").cast("long").alias("dst_start"), "rel_type")


@query(RELATIONS + """
SELECT doc_id, page, CAST(src_start AS BIGINT) AS src_start, CAST(dst_start AS BIGINT) AS dst_start,
  round(confidence, 6) AS confidence FROM rels""")
def d2_relation_confidence(spark, sf):
    return _scored(spark, sf).select(
        "doc_id", "page", F.col("src_start").cast("long").alias("src_start"),
        F.col("dst_start").cast("long").alias("dst_start"), F.round("confidence", 6).alias("confidence"))


_OWNS = next(p for p in relations.RELATION_PATTERNS if p[0] == "SUPPLIES_TO")
_V, _P = ([sql.text_literal(x) for x in side] for side in _OWNS[1:])


@query(MENTIONS + ", " + sql.pairs() + f"""
SELECT round(q, 6) AS quality, count(*) AS pairs FROM (SELECT
  ({' + '.join(f'CAST(contains(lower(context), {v}) AS INTEGER)' for v in _V)}) / {len(_V)} * 0.6::DOUBLE
  + ({' + '.join(f'CAST(contains(lower(context), {p}) AS INTEGER)' for p in _P)}) / {len(_P)} * 0.4::DOUBLE AS q FROM pairs)
GROUP BY round(q, 6)""")
def d3_pattern_quality(spark, sf):
    """Quality of the SUPPLIES_TO pattern over all pairs."""
    lowered = _pairs(spark, sf).select(once(F.lower("context")).alias("low"))
    pairs = lowered.select(once(r.pattern_quality(F.col("low"), *_OWNS[1:])).alias("q"))
    return pairs.groupBy(F.round("q", 6).alias("quality")).agg(F.count("*").alias("pairs"))


@query(RELATIONS + """
SELECT src_type, rel_type, dst_type, (src_type, rel_type, dst_type) IN (SELECT (src_type, rel_type, dst_type) FROM compat)
  AS compatible, count(*) AS relations FROM rels GROUP BY ALL""")
def d4_compatible_types(spark, sf):
    rels = _scored(spark, sf)
    counts = rels.groupBy("src_type", "rel_type", "dst_type").agg(F.count("*").alias("relations"))
    ok = frames.compatibility(spark).withColumn("_ok", F.lit(True))
    return (counts.join(F.broadcast(ok), ["src_type", "rel_type", "dst_type"], "left")
            .select("src_type", "rel_type", "dst_type", F.coalesce("_ok", F.lit(False)).alias("compatible"),
                    "relations"))


@query(RELATIONS + """
SELECT is_temporal, is_negated, count(*) AS relations FROM rels GROUP BY ALL""")
def d5_time_and_negation(spark, sf):
    return (_scored(spark, sf).groupBy("is_temporal", "is_negated")
            .agg(F.count("*").alias("relations")))


@query(RELATIONS + """
SELECT doc_id, page, src_text, dst_text, rel_type, round(confidence, 6) AS confidence FROM rels WHERE confidence > 0.5""")
def d6_relations(spark, sf):
    return _relations(spark, sf).select("doc_id", "page", "src_text", "dst_text", "rel_type",
                                        F.round("confidence", 6).alias("confidence"))


def _flag_sql(rx: str) -> str:
    return f"regexp_matches(context, {sql.text_literal(rx)})"


def _types_sql(group: str) -> str | None:
    """The relation types that a group of flags is for; none for all."""
    return next((", ".join(f"'{t}'" for t in types) for types, groups in relations.EXTRA_GROUPS if group in groups), None)


def _detail_sql(group: str, name: str, rx: str) -> str:
    types = _types_sql(group)
    test = _flag_sql(rx) if types is None else f"CASE WHEN rel_type IN ({types}) THEN {_flag_sql(rx)} END"
    return f"{test} AS {group}_{name}"


def _phrase_count_sql(kind: str) -> str:
    found = " + ".join(f"len(regexp_extract_all(context, {sql.text_literal('(?i)' + rx)}))" for _, rx in r.PHRASES[kind][0])
    types = ", ".join(f"'{t}'" for t in relations.PHRASE_RELATIONS)
    return f"CASE WHEN rel_type IN ({types}) THEN CAST({found} AS INTEGER) END AS {kind}_phrases"


def _has_sql(terms: list[str]) -> str:
    return f"list_has_any(w, [{', '.join(sql.text_literal(t) for t in terms)}])"


def _polarity_sql(polarity: str) -> str:
    hits = " + ".join(f"len(list_intersect(w, [{', '.join(sql.text_literal(t) for t in dict.fromkeys(terms))}]))" for terms in relations.SENTIMENT[polarity].values())
    return f"CAST({hits} AS INTEGER) AS {polarity}"


@query(RELATIONS + f""", kept AS (SELECT *, list_distinct(string_split_regex(lower(context), '\\s+')) AS w FROM rels WHERE confidence > 0.5)
SELECT doc_id, page, CAST(src_start AS BIGINT) AS src_start, CAST(dst_start AS BIGINT) AS dst_start, src_text, dst_text,
  {', '.join(_detail_sql(*row) for row in relations.flag_rows())},
  {', '.join(_polarity_sql(p) for p in relations.SENTIMENT)},
  {_has_sql(relations.HIGH_CERTAINTY)} AS is_high_certainty, {_has_sql(relations.LOW_CERTAINTY)} AS is_low_certainty,
  {', '.join(_phrase_count_sql(k) for k in r.PHRASES)} FROM kept""")
def d7_relation_details(spark, sf):
    """All groups of flags, words of sentiment and certainty, and the number of phrases of each kind."""
    rows = r.details(_relations(spark, sf, **{r.CUES: r.cues}))
    return rows.select("doc_id", "page", F.col("src_start").cast("long").alias("src_start"),
                       F.col("dst_start").cast("long").alias("dst_start"), "src_text", "dst_text",
                       *[F.col(f"{g}_details.{n}").alias(f"{g}_{n}") for g, n, _ in relations.flag_rows()],
                       *relations.SENTIMENT, "is_high_certainty", "is_low_certainty",
                       *[F.when(F.col(f"{k}_phrases").isNotNull(), F.size(f"{k}_phrases")).alias(f"{k}_phrases") for k in r.PHRASES])


@query(MENTIONS + ", " + sql.pairs() + " " + " UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", '{n}' AS flag, count(*) FILTER ({_flag_sql(rx)}) AS contexts FROM pairs"
    for g, n, rx in relations.flag_rows()))
def d8_context_flags(spark, sf):
    return r.flag_counts(_pairs(spark, sf, **{r.CUES: r.cues}))


_TERMS = sql.sql_values(relations.sentiment_rows(), "terms(polarity, category, term)")


@query("WITH " + sql.STATEMENTS + f""", w AS (
  SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM statements),
c AS (SELECT doc_id, polarity, count(*) AS n FROM w JOIN {_TERMS} USING (term) GROUP BY ALL)
SELECT s.doc_id, coalesce(sum(n) FILTER (polarity = 'positive'), 0)::BIGINT AS positive,
  coalesce(sum(n) FILTER (polarity = 'negative'), 0)::BIGINT AS negative,
  coalesce(sum(n) FILTER (polarity = 'neutral'), 0)::BIGINT AS neutral,
  (coalesce(sum(n) FILTER (polarity = 'positive'), 0) - coalesce(sum(n) FILTER (polarity = 'negative'), 0))::BIGINT
    AS sentiment_score,
  CASE WHEN coalesce(sum(n) FILTER (polarity = 'positive'), 0) > coalesce(sum(n) FILTER (polarity = 'negative'), 0)
    THEN 'positive' WHEN coalesce(sum(n) FILTER (polarity = 'positive'), 0)
      < coalesce(sum(n) FILTER (polarity = 'negative'), 0) THEN 'negative' ELSE 'neutral' END AS overall_sentiment
FROM statements s LEFT JOIN c ON s.doc_id = c.doc_id GROUP BY s.doc_id""")
def d9_sentiment(spark, sf):
    rows = r.sentiment(b.statements(spark, sf).select("doc_id", F.col("text").alias("context")))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c)
                                   for c in ("positive", "negative", "neutral", "sentiment_score")],
                       "overall_sentiment")


@query("WITH " + sql.STATEMENTS + f""", w AS (
  SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM statements)
SELECT polarity, category, term, count(*) AS contexts FROM w JOIN {_TERMS} USING (term) GROUP BY ALL""")
def d9_sentiment_terms(spark, sf):
    texts = b.statements(spark, sf).select(F.col("text").alias("context"))
    return r.sentiment_terms(texts, frames.sentiment_terms(spark))


def _list_sql(words):
    return "[" + ", ".join(sql.text_literal(w) for w in words) + "]"


@query(f"""
WITH t AS (SELECT conv_id, turn, list_distinct(string_split_regex(lower(text), '\\s+')) AS w FROM (
  SELECT conv_id, turn, text || CASE role WHEN 'user' THEN ' may could ' ELSE ' confirmed expected ' END AS text
  FROM conversations))
SELECT conv_id, turn, list_has_any(w, {_list_sql(relations.HIGH_CERTAINTY)}) AS is_high_certainty,
  list_has_any(w, {_list_sql(relations.LOW_CERTAINTY)}) AS is_low_certainty,
  array_to_string(list_sort(list_intersect(w, {_list_sql(relations.HIGH_CERTAINTY + relations.LOW_CERTAINTY)})), ',')
    AS certainty_words FROM t""")
def d10_certainty(spark, sf):
    t = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat("text", F.when(F.col("role") == "user", " may could ")
                                    .otherwise(" confirmed expected ")).alias("context"))
    return r.certainty(t).select("conv_id", "turn", "is_high_certainty", "is_low_certainty",
                                 F.array_join("certainty_words", ",").alias("certainty_words"))


def _report_texts(spark, sf):
    """Short report sentences per order, so that every phrase pattern has something to find."""
    o = table(spark, sf, "orders")
    v, k = b.money(F.col("o_totalprice")), (F.col("o_orderkey") % 10).cast("string")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit("Sales of $"), v, F.lit(". Margin grew by "), k, F.lit(".5% yoy. Cost between "), k, F.lit(" and "), v,
        F.lit(". Price to book ratio of "), k, F.lit(".2, debt to equity ratio has increased from 1.0 to "), k,
        F.lit(". Revenue has grown by "), k, F.lit("% annually; demand shows seasonal pattern of "), k,
        F.lit("% variation. Profit is expected to reach "), v, F.lit(" million.")).alias("context"))


_REPORTS = """reports AS (SELECT o_orderkey AS doc_id, 'Sales of $' || v || '. Margin grew by ' || k
  || '.5% yoy. Cost between ' || k || ' and ' || v || '. Price to book ratio of ' || k
  || '.2, debt to equity ratio has increased from 1.0 to ' || k || '. Revenue has grown by ' || k
  || '% annually; demand shows seasonal pattern of ' || k || '% variation. Profit is expected to reach ' || v
  || ' million.' AS context
  FROM (SELECT o_orderkey, printf('%.2f', o_totalprice) AS v, CAST(o_orderkey % 10 AS VARCHAR) AS k FROM orders))"""


def _phrase_sql(patterns, groups, extra=""):
    parts = []
    for name, rx in patterns:
        n = rx.count("(") - rx.count("(?:") - rx.count(r"\(")
        lit = sql.text_literal("(?i)" + rx)
        cols = [f"trim(unnest(regexp_extract_all(context, {lit}, {i + 1}))) AS {g}" if i < n
                else f"CAST(NULL AS VARCHAR) AS {g}" for i, g in enumerate(groups)]
        parts.append(f"SELECT doc_id, '{name}' AS pattern, {', '.join(cols)} FROM reports")
    return f"WITH {_REPORTS}, found AS ({' UNION ALL '.join(parts)}) SELECT *{extra} FROM found"


@query(_phrase_sql(relations.METRIC_PHRASES, ["metric", "value", "value2"],
                   ", CASE WHEN value2 IS NULL THEN 'single' ELSE 'range' END AS kind"))
def d11_metric_phrases(spark, sf):
    return r.metric_phrases(_report_texts(spark, sf), ["doc_id"])


@query(_phrase_sql(relations.RATIO_PHRASES, ["numerator", "denominator", "value", "value2"],
                   ", numerator || '_to_' || denominator AS ratio, "
                   "CASE WHEN value2 IS NULL THEN 'single' ELSE 'range' END AS kind"))
def d12_ratio_phrases(spark, sf):
    return r.ratio_phrases(_report_texts(spark, sf), ["doc_id"])


@query(_phrase_sql(relations.TREND_PHRASES, ["metric", "value"]))
def d13_trend_phrases(spark, sf):
    return r.trend_phrases(_report_texts(spark, sf), ["doc_id"])


@query(MENTIONS + """
SELECT CASE WHEN grouping(type) = 1 AND grouping(page) = 1 THEN 'total' WHEN grouping(page) = 1 THEN 'type' ELSE 'page' END
  AS scope, CASE WHEN grouping(type) = 1 AND grouping(page) = 1 THEN 'all' WHEN grouping(page) = 1 THEN type
    ELSE CAST(page AS VARCHAR) END AS item,
  count(*) AS mentions, round(avg(confidence), 6) AS average_confidence
FROM mentions GROUP BY GROUPING SETS ((type), (page), ())""")
def e1_mention_statistics(spark, sf):
    return m.statistics(_mentions(spark, sf)).withColumn("average_confidence", F.round("average_confidence", 6))


@query(RELATIONS + """
SELECT coalesce(rel_type, 'all') AS rel_type, count(*) AS relations, round(avg(confidence), 6) AS average_confidence,
  count(DISTINCT (src_text, dst_text)) AS unique_pairs FROM rels WHERE confidence > 0.5 GROUP BY ROLLUP (rel_type)""")
def e2_relation_statistics(spark, sf):
    rels = _relations(spark, sf).select("rel_type", "confidence", F.col("src_text").alias("src"),
                                        F.col("dst_text").alias("dst"))
    return r.statistics(rels).withColumn("average_confidence", F.round("average_confidence", 6))


@query(MENTIONS + """
SELECT count(*) AS total, count(*) FILTER (confidence >= 0.8) AS high_confidence FROM mentions""")
def e15_confident_mentions(spark, sf):
    return m.confident_share(_mentions(spark, sf))


@query(RELATIONS + f""", kept AS (SELECT * FROM rels WHERE confidence > 0.5 AND src_type IN ({sql.LABELS}) AND dst_type IN ({sql.LABELS})),
names AS (SELECT *, CASE type WHEN 'FINANCIAL_METRIC' THEN 'FinancialMetric' ELSE upper(type[1:1]) || lower(type[2:]) END AS t FROM mentions)
SELECT 'vertex' AS kind, t AS type, count(*) AS items, count(DISTINCT (doc_id, "start")) AS ids, round(avg(confidence), 6) AS confidence
FROM names GROUP BY t
UNION ALL SELECT 'edge', CASE WHEN rel_type IN ({', '.join("'" + n + "'" for n in kinds.RELATION_TYPES + kinds.EXTRA_ACCEPTED_RELATIONS)})
  THEN rel_type ELSE 'TRANSACTION' END AS t, count(*), count(DISTINCT (doc_id, src_start, dst_start)), round(avg(confidence), 6)
FROM kept GROUP BY t""")
def d14_document_graph(spark, sf):
    """Texts to vertices and edges, counted by type."""
    from ledgergraph.operators.document_graph import to_graph
    v, e = to_graph(b.statements(spark, sf), b.company_names(spark, sf), frames.entity_aliases(spark),
                    frames.accepted_relations(spark), "2024-01-01 00:00:00")

    def counts(df, kind):
        return df.groupBy(F.lit(kind).alias("kind"), "type").agg(
            F.count("*").alias("items"), F.count_distinct("id").alias("ids"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return counts(v, "vertex").unionByName(counts(e, "edge"))
