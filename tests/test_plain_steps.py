"""Steps of many short texts run as compiled code; long texts and control characters give the same rows."""

import random
import re

from pyspark.sql import functions as F

from ledgergraph.functions.text import SENTENCE_BREAK, explode_sentences
from ledgergraph.operators import mentions, relations


def interpreted(df):
    """The generators of a plan that run lambdas, which are interpreted row by row."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x and "lambda" in x]


def long_texts(n=12, seed=8):
    rng = random.Random(seed)
    words = ["revenue", "Acme#1", "$5,000.25", "x", "ünder", "\u0001", "12%", "a b\u0001c", "cash."]
    ends = [". ", "\n\n", "?! ", " ", " ", " ", ", "]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.choice([0, 5, 60, 700]))) for _ in range(n)] + ["revenue " * 400, ". cash", "\u0001"]


def test_sentences_and_contexts_of_long_texts(spark):
    texts = long_texts()
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id int, page int, text string")
    got = {(r.doc_id, r.sent_id): (r.start, r.end, r.sentence) for r in explode_sentences(df, "text", ["doc_id"]).collect()}
    want, breaks = {}, re.compile(SENTENCE_BREAK, re.ASCII)
    for i, t in enumerate(texts):
        at = 0
        for no, hit in enumerate([*breaks.finditer(t), None]):
            end = hit.start() if hit else len(t)
            if end > at:
                want[i, no] = (at, end, t[at:end])
            at = hit.end() if hit else end
    assert got == want and len(want) > 1000
    found = mentions.find_mentions(df).collect()
    assert len(found) > 1000
    for r in found:
        t, end = texts[r.doc_id], want[r.doc_id, r.sent_id][1]
        assert t[r.start:r.end] == r.text and r.context == t[max(0, r.start - 50):r.end + 50] and r.ahead == t[r.start:min(end, r.start + 100)]


def test_mentions_of_short_texts_run_no_lambdas(spark):
    df = spark.createDataFrame([(1, 1, "revenue. cash")], "doc_id int, page int, text string")
    assert interpreted(mentions.find_mentions(df)) == []


def test_pairs_of_sentences_are_those_of_mentions(spark):
    rng = random.Random(9)
    words = ["Acme#1", "beta#22x", "Gamma#3", "é", "revenue growth", "$1,234.50 million", "7.5%", "bought a stake of", "not", "in 2024", "\u0001", "\nroi", "up. ", "supplies to"]
    rows = [(i, 1, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(500, None, "Acme#1 bought a stake in Gamma#3"), (501, 1, " ".join(f"Acme#{i % 3}, {i}" for i in range(400))), (502, 2, "revenue, " + "1,234," * 300 + "5 and cash"), (503, 1, None)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string")
    names = spark.createDataFrame([("ACME#1",), ("gamma#3",), (None,)], "name string")
    marks = {relations.CANDIDATES: relations.candidates, relations.CUES: relations.cues}
    plain = relations.pairs(mentions.confirm_names(mentions.find_mentions(df, per_sentence=marks), names))
    quick = mentions.confirm_pairs(mentions.find_pairs(df, per_sentence=marks), names)
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, quick.select(plain.columns).collect())) == want and len(want) > 3000
    scored = mentions.confirm_pairs(relations.score(mentions.find_pairs(df, per_sentence=marks)), names)
    every = relations.score(plain.drop(relations.CANDIDATES))
    want = sorted(map(str, every.collect()))
    assert sorted(map(str, scored.select(every.columns).collect())) == want and len(want) > 500


def test_pairs_and_scores_run_no_lambdas_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "Acme#1 bought a stake in Gamma#3")], "doc_id int, page int, text string")
    scored = relations.score(mentions.find_pairs(df, per_sentence={relations.CANDIDATES: relations.candidates}))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert interpreted(scored) == [] and "Window" not in plan
    assert plan.count("lower(sentence") == 1 and "Exchange" not in scored._jdf.queryExecution().sparkPlan().toString()


def test_names_and_mentions_meet_as_spans(spark):
    texts = long_texts() + ["Big Acme#1 Holdings owns revenue growth. Acme#1", "a\u0001b Acme#2 and a\u0002b cash", "x a\u0001b " * 3, None]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id int, page int, text string")
    names = spark.createDataFrame([("Acme#1 Holdings",), ("growth",), ("a\u0001b",), ("b",), ("x",), ("cash.",)], "name string")
    marks = {relations.CANDIDATES: relations.candidates}
    labelled = mentions.known_labels(mentions.find_mentions(df, per_sentence=marks))
    plain = mentions.with_names(labelled, mentions.known_names(df, names, per_sentence=marks))
    spans = mentions.known_names(df, names, per_sentence=marks, labels=tuple(mentions.kinds.MENTION_LABELS))
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, spans.select(plain.columns).collect())) == want and len(want) > 1000
    met = [x for x in spans._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftAnti" in x]
    assert met and all("context" not in x for x in met)
    odd = mentions.known_names(df, names).where("text = 'a\u0001b'")
    assert odd.count() == 4 and mentions.known_names(df, names).where("contains(text, char(2))").count() == 0


def test_names_are_looked_up_at_the_texts(spark):
    """The mentions and pairs of confirmed texts are those that are confirmed afterwards, and only texts and names are shuffled."""
    rng = random.Random(4)
    words = ["Acme#1", "beta#22x", "BETA#22", "Gamma#3", "é", "revenue growth", "$1,234.50 million", "in 2024", "up. ", "owns", "stake", "\u0001"]
    rows = [(i % 90, None if i % 7 == 0 else i % 2, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)] + [(None, None, "Acme#1, Gamma#3"), (1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string")
    names = spark.createDataFrame([("ACME#1",), ("beta#22",), (None,)], "name string")
    texts = mentions.confirm_texts(df, names)
    plain = mentions.confirm_names(mentions.find_mentions(df), names)
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, mentions.find_mentions(texts).select(plain.columns).collect())) == want and len(want) > 500
    plain = mentions.confirm_pairs(mentions.find_pairs(df), names)
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, mentions.find_pairs(texts).select(plain.columns).collect())) == want and len(want) > 500
    shuffled = str(mentions.find_pairs(texts)._jdf.queryExecution().optimizedPlan()).split("Join")[0]
    assert "LeftOuter" not in shuffled and "src_text" in shuffled  # pairs are made above all joins


def test_flags_run_no_lambda_for_each_cue(spark):
    contexts = spark.createDataFrame([("up 12%, $5 by 2024", "up 12%, $5 by 2024")], "sentence string, context string")
    rows = contexts.withColumn(relations.CUES, relations.cues(F.col("sentence"))).localCheckpoint()
    plan = str(relations.flag_counts(rows)._jdf.queryExecution().optimizedPlan())
    assert "filter(cues" not in plan
    got = {(r["group"], r.flag) for r in relations.flag_counts(rows).collect() if r.contexts}
    assert {("temporal", "has_date"), ("financial", "is_growth"), ("quantitative", "has_percentage")} <= got
    details = relations.details(rows.withColumn("rel_type", F.lit("HAS_METRIC"))).first()
    assert details.financial_details.is_growth and not details.financial_details.is_decline and details.location_details is None
