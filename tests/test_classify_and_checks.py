"""The quick ways of scoring types and of trying checks against the plain ones."""

import random
import re

from pyspark.sql import functions as F

from ledgergraph.catalog import doctypes, frames
from ledgergraph.operators import classify, validation


def test_scores_of_grouped_tests(spark):
    rng = random.Random(7)
    parts = [k for s in doctypes.DOCUMENT_TYPES.values() for k in s["keywords"]] + ["Invoice #12", "amount due: $", "balances", "Form W2", "revenue: $5", "merchant: x", "form  1099", "x"]
    rows = [(i, "\n ".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    shares = df.select("doc_id", F.explode(F.transform(F.array(F.lower("text")), classify._hits)).alias("h")).select("doc_id", *[
        s.alias(t) for t, s in zip(doctypes.DOCUMENT_TYPES, classify._scores(F.col("h")), strict=True)])
    got = {r.doc_id: r for r in shares.collect()}
    for i, text in rows:
        low = (text or "").lower()
        for name, spec in doctypes.DOCUMENT_TYPES.items():
            hits = sum(k in low for k in spec["keywords"]) + 2 * sum(bool(re.search(p, low)) for p in spec["patterns"])
            assert got[i][name] == hits / (len(spec["keywords"]) + len(spec["patterns"])), (text, name)
    # One word stands for its tests: fewer groups than tests, so fewer searches of a text.
    assert len(classify._by_word()) < 0.6 * len(classify._tests())


def test_only_checks_in_question_are_tried(spark):
    checks = validation._by_type(frames.rule_checks(spark).filter("kind = 'relationship'"), validation.RELATIONSHIP_CHECKS).limit(5)
    fields = checks.select(F.explode("_checks.field").alias("f")).distinct()
    keys = [r.f for r in fields.collect()]
    full = checks.withColumn("_keys", F.array(*[F.lit(k) for k in keys]).cast("array<string>"))
    left = full.select(F.inline(F.filter("_checks", validation._in_question))).where("check IN ('required', 'metric', 'date')")
    assert keys and left.count() == 0
    empty = checks.withColumn("_keys", F.array().cast("array<string>"))
    left = empty.select(F.inline(F.filter("_checks", validation._in_question))).where("check NOT IN ('required', 'metric', 'date', 'document')")
    assert left.count() == 0


def test_ends_are_hashed_not_sorted(spark):
    """A hub's edges would be sorted for each end; the ids of vertices, which are unique, are hashed instead."""
    from ledgergraph.operators import graph

    v = spark.range(50).select(F.concat(F.lit("v"), "id").alias("id"), F.lit("T").alias("type"), F.lit("n").alias("name"))
    e = spark.range(200).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("R").alias("type"), F.lit("v0").alias("src"),
                                F.concat(F.lit("v"), F.col("id") % 60).alias("dst"), F.lit(1.0).alias("confidence"))
    both, found = graph.with_endpoints(e, v, "type"), validation.dangling(e, v)
    here = [both, graph.anchored(e, v), found, graph.entity_profile(e, v, "T")]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in here]
    assert all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    kept = sum(i % 60 < 50 for i in range(200))
    assert both.count() == here[1].count() == kept and found.count() == 200 - kept
    assert here[3].agg(F.sum("relations")).first()[0] == sum(2 - (i % 60 == 0) for i in range(200) if i % 60 < 50)
