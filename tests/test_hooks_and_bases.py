"""Callers' Python functions beside Column functions; sketches per day; the compacted graph store."""

import pandas as pd
from pyspark.sql import functions as F

from ledgergraph.functions.values import get
from ledgergraph.operators import corrections, resolution, sketches
from ledgergraph.sources import store

VERTEX = "id string, type string, name string, properties map<string,string>, confidence double, source_document string"


def test_split_with_a_table_function(spark):
    @F.udtf(returnType="part string, size int")
    class Parts:
        def eval(self, text: str):
            for part in (text or "").split("+"):
                yield part, len(part)

    df = spark.createDataFrame([("a", "x+yy"), ("b", "z"), ("c", None)], "id string, text string")
    got = {(r.id, r.part, r.size) for r in resolution.split_with(df, Parts, "text").collect()}
    assert got == {("a", "x", 1), ("a", "yy", 2), ("b", "z", 1), ("c", "", 0)}


def test_merge_with_a_function(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, v int")
    got = resolution.merge_with(df, ["k"], lambda rows: pd.DataFrame({"k": rows["k"][:1], "spread": [int(rows["v"].max() - rows["v"].min())]}), "k string, spread int")
    assert {(r.k, r.spread) for r in got.collect()} == {("a", 4), ("b", 0)}


def test_arrow_functions_as_corrections(spark):
    title = F.udf(lambda v: None if v is None else v.title(), "string", useArrow=True)
    short = F.udf(lambda v: v is not None and len(v) < 5, "boolean", useArrow=True)
    df = spark.createDataFrame([("a", "T", "n", {"name": "acme ltd", "ticker": "LONGER"}, 1.0, "d"), ("b", "T", "n", {"ticker": "OK"}, 1.0, "d")], VERTEX)
    p = F.col("properties")
    rows = df.withColumn("properties", corrections.transform(p, "name", title)).withColumn("properties", corrections.keep_if(p, "ticker", short))
    assert {r.id: (r.name, r.ticker) for r in rows.select("id", get(p, "name").alias("name"), get(p, "ticker").alias("ticker")).collect()} == {
        "a": ("Acme Ltd", None), "b": (None, "OK")}


def test_merged_sketches(spark):
    facts = spark.range(60_000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS m", "CAST((id * 7919) % 10007 AS DOUBLE) AS v", "id % 9000 AS who",
                                           "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(id % 20 AS INT)) AS ts")
    days = sketches.daily(facts, ["m"], "v", "who")
    assert days.count() == 40
    rows = sketches.held_against(sketches.merged(days, ["m"]), facts, ["m"], "v", "who").collect()
    assert {(r.m, r.facts, r.quartiles_within, r.entities_within) for r in rows} == {("a", 20_000, True, True), ("b", 40_000, True, True)}
    wrong = sketches.merged(days, ["m"]).withColumn("quartiles", F.transform("quartiles", lambda x: x * 1.5)).withColumn("entities", F.col("entities") * 2)
    assert {(r.quartiles_within, r.entities_within) for r in sketches.held_against(wrong, facts, ["m"], "v", "who").collect()} == {(False, False)}


def test_compacted_store(spark, tmp_path):
    def vertices(*ids):
        return spark.createDataFrame([(i, "N", i, {}, 1.0, f"d{i[0]}") for i in ids], VERTEX)

    def edges(*pairs):
        return spark.createDataFrame([(f"{a}{b}", "T", a, b, {}, 1.0, f"d{a[0]}") for a, b in pairs],
                                     "id string, type string, src string, dst string, properties map<string,string>, confidence double, source_document string")

    folder, plain = str(tmp_path / "graph"), str(tmp_path / "plain")
    steps = [(vertices("a1", "a2", "b1"), edges(("a1", "b1"), ("a2", "zz")), True), (vertices("a3"), edges(), False), (vertices("b2"), edges(("b2", "a1")), True),
             (vertices("z1", "zz"), edges(), True), (vertices("a9"), edges(("a9", "b2")), True)]
    for i, (v, e, replace) in enumerate(steps):
        for f in (folder, plain):
            store.save_graph(v, e, f, replace=replace)
        if i in (1, 3):
            store.compact(spark, folder)
            store.compact(spark, folder)
        got, want = ([sorted(r.id for r in t.collect()) for t in store.load_graph(spark, f)] for f in (folder, plain))
        assert got == want
    assert got == [["a9", "b2", "z1", "zz"], ["a9b2"]]
    assert store._newest_base(spark, folder)[0] == 4
