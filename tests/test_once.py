"""Costly values are worked out once, and rows are neither multiplied nor shuffled more often than needed."""

from pyspark.sql import functions as F

from ledgergraph.catalog import frames
from ledgergraph.functions.ordering import first_n
from ledgergraph.operators import classify, mentions, validation


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_worked_out_once(spark):
    rows = spark.createDataFrame([("a", "Company", {"name": "x"})], "id string, type string, properties map<string,string>")
    found = validation.findings(validation.validate_domains(rows, frames.rule_checks(spark)))
    assert optimized(found).count("array_contains(_compliance") == 1


def test_statistics_count_before_the_roll_up(spark):
    rows = spark.createDataFrame([("A", 1, 0.5), ("A", 2, 0.7), ("B", None, 0.9)], "type string, page int, confidence double")
    out = mentions.statistics(rows)
    lines = [x.strip(" :+-") for x in optimized(out).splitlines()]
    below = lines[next(i for i, x in enumerate(lines) if x.startswith("Expand")) + 1:]
    assert any(x.startswith("Aggregate") for x in below)
    got = {(r.scope, r.item): (r.mentions, round(r.average_confidence, 6)) for r in out.collect()}
    assert got == {("total", "all"): (3, 0.7), ("type", "A"): (2, 0.6), ("type", "B"): (1, 0.9), ("page", "1"): (1, 0.5), ("page", "2"): (1, 0.7), ("page", None): (1, 0.9)}


def test_first_rows_of_groups_take_one_shuffle(spark):
    rows = spark.range(0, 5000, 1, 3).selectExpr("id % 7 AS k", "id AS v")
    top = first_n(rows, ["k"], ["v"], 4, F.col("v"))
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Window [") == 1
    assert {(r.k, r.position): r.v for r in top.collect()} == {(k, p): k + 7 * (p - 1) for k in range(7) for p in range(1, 5)}
    many = first_n(rows, ["k"], ["v"], 600, F.col("v"))
    assert many.count() == 7 * 600


def test_replies_with_their_text_need_no_documents(spark):
    replies = spark.createDataFrame([("d", "A b c d", "unknown", "", 0.2, True), ("d", "E f", "invoice", "", 0.9, True)],
                                    "doc_id string, text string, document_type string, custom_type_name string, confidence double, valid boolean")
    labels = spark.createDataFrame([], "doc_id string, label string")
    out = sorted((r.doc_type, r.custom_type, r.confidence) for r in classify.settle(replies, None, labels).collect())
    assert out == [("custom", "a_b_c", 0.7), ("invoice", None, 0.9)]
