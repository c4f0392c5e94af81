"""Operators on small fixtures worked out by hand, and edge cases that the tables do not have."""

import hashlib
import itertools
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgergraph.catalog import frames, kinds, relations, rules
from ledgergraph.functions import ordering, text, values
from ledgergraph.functions.text import capitalised
from ledgergraph.operators import classify, corrections, document_graph, graph, mentions, quality, resolution, status, trends, validation
from ledgergraph.operators import relations as rel
from ledgergraph.sources import documents, files, store
from ledgergraph.streaming import runs


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def vertex(spark, items):
    return spark.createDataFrame(
        [(i, t, i, p, c, d) for i, t, p, c, d in items],
        "id string, type string, name string, properties map<string,string>, confidence double, source_document string"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))


def edge(spark, items):
    return spark.createDataFrame(
        [(i, t, s, d, {}, 0.9, "doc") for i, t, s, d in items],
        "id string, type string, src string, dst string, properties map<string,string>, confidence double, "
        "source_document string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")) \
        .withColumn("updated_at", F.col("created_at"))


# --- catalogue -------------------------------------------------------------------------------------------------

def test_catalogue_sizes():
    assert len(kinds.ENTITY_TYPES) == 24 and len(kinds.MENTION_LABELS) == 10
    assert len(rules.rule_rows()) == 22 and len(kinds.DOMAINS) == 15
    assert len(relations.RELATION_PATTERNS) == 18 and len(relations.flag_rows()) == 105
    assert len(kinds.RELATION_TYPES) == len(set(kinds.RELATION_TYPES))


# --- text ------------------------------------------------------------------------------------------------------

TEXTS = ["", "One. Two! Three", "no boundary", "Économie à 12 %. Cash receivable\n\nNYSE fell?  5 million", "...", "a. \n b"]


def test_pieces_give_back_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for pattern in (text.SENTENCE_BREAK, r"\d+", "a"):
        for r in text.explode_pieces(df, "text", pattern, ["id"]).collect():
            t = TEXTS[r.id]
            assert t[r.gap_start:r.gap_start + len(r.gap)] == r.gap
            if r.hit is not None:
                at = r.gap_start + len(r.gap)
                assert t[at:at + len(r.hit)] == r.hit


def test_mentions(spark):
    t = "Revenue growth hit $1,250.00 million in 2024-03-01, 12% of cash receivable. NYSE and cashier, Acme#12 order."
    df = spark.createDataFrame([(1, 0, t)], "doc_id int, page int, text string")
    found = mentions.find_mentions(df).orderBy("start").collect()
    assert [(m.text, m.type) for m in found] == [
        ("Revenue growth", "FINANCIAL_METRIC"), ("$1,250.00 million", "CURRENCY"), ("2024-03-01", "DATE"), ("12%", "PERCENTAGE"),
        ("cash receivable", "ACCOUNT"), ("NYSE", "MARKET"), ("Acme#12", "COMPANY")]
    for m in found:
        assert t[m.start:m.end] == m.text
        assert m.context == t[max(0, m.start - 50):m.end + 50]
    assert found[0].confidence == pytest.approx(0.85)
    assert found[1].confidence == pytest.approx(0.95)
    names = spark.createDataFrame([("other#1",)], "name string")
    assert mentions.confirm_names(mentions.find_mentions(df), names).filter("type = 'COMPANY'").count() == 0


def test_pairs_against_brute_force(spark):
    sentence = " ".join(f"{i} cash" if i % 3 else f"{i} very long words here {'x' * (i % 40)}" for i in range(60))
    df = spark.createDataFrame([(1, 0, sentence + ". " + sentence)], "doc_id int, page int, text string")
    found = mentions.find_mentions(df).collect()
    want = {(a.start, b.start) for a, b in itertools.product(found, found)
            if a.sent_id == b.sent_id and 0 < b.start - a.start <= 100}
    got = rel.pairs(mentions.find_mentions(df)).collect()
    assert {(p.src_start, p.dst_start) for p in got} == want
    whole = sentence + ". " + sentence
    for p in got:
        assert p.context == whole[p.src_start:p.dst_start + len(p.dst_text)]


def test_relation_score(spark):
    pair = spark.createDataFrame(
        [(1, 0, "A#1", "COMPANY", 0.9, "B#2", "COMPANY", 0.9, "A#1 acquired a division of B#2"),
         (1, 1, "A#1", "COMPANY", 0.9, "B#2", "COMPANY", 0.9, "A#1 never competes with B#2"),
         (1, 2, "A#1", "COMPANY", 0.9, "B#2", "COMPANY", 0.9, "A#1 and B#2")],
        "doc_id int, n int, src_text string, src_type string, src_confidence double, dst_text string, dst_type string, "
        "dst_confidence double, context string")
    got = {r.n: (r.rel_type, r.confidence) for r in rel.score(pair).collect()}
    # 0.6 + 0.2 + 0.1 + 1.8 * 0.05 + (1/6 * 0.6 + 1/6 * 0.4) * 0.1 is above 1
    assert got[0][0] == "OWNS" and got[0][1] == 1.0
    # the same with quality 1/5 * 0.6 + 1/3 * 0.4, less 0.3 for the negation
    assert got[1][0] == "COMPETES_WITH" and got[1][1] == pytest.approx(0.69 + 0.1 * (0.12 + 0.4 / 3))
    assert 2 not in got


def test_phrases(spark):
    c = spark.createDataFrame([(1, "12abc reached 5 and m reached 7. Debt to equity ratio of 1.5")], "id int, context string")
    got = rows(rel.metric_phrases(c, ["id"]).filter("pattern = 'basic'"), "metric", "value")
    import re
    want = sorted(m.groups() for m in re.finditer(dict(relations.METRIC_PHRASES)["basic"], c.first().context, re.I))
    assert got == [(a, b.strip()) for a, b in want]
    assert rows(rel.ratio_phrases(c, ["id"]), "ratio", "value") == [("Debt_to_equity", "1.5")]


def test_chunks_and_statistics(spark):
    df = spark.createDataFrame([(1, "x" * 1201), (2, "")], "doc_id int, text string")
    assert sorted(len(v) for (v,) in rows(documents.preview(df, most=None), "value")) == [201, 500, 500]
    assert documents.preview(df, most=None).count() == 3 and documents.preview(df, most=2).count() == 2
    got = {r.doc_id: (r.word_count, r.character_count, r.line_count) for r in documents.text_statistics(df).collect()}
    assert got == {1: (1, 1201, 1), 2: (0, 0, 1)}


def test_first_block(spark):
    cases = {'x {"a": {"b": 1,}, "c": [1, 2,],} y {"z": 1}': '{"a": {"b": 1,}, "c": [1, 2,],}', "none": None, "{ open": None}
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    for r in df.select("reply", classify.first_block(F.col("reply")).alias("b")).collect():
        assert r.b == cases[r.reply]


# --- ordering --------------------------------------------------------------------------------------------------

def test_places_and_slopes_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("k"), "id",
                                  ((F.col("id") * 7919) % 3001).cast("double").alias("v"))
    pdf = df.toPandas().sort_values(["k", "v", "id"])
    pdf["place"] = pdf.groupby("k").cumcount() + 1
    got = ordering.places(df, ["k"], ["v", "id"], "place").toPandas()
    merged = pdf.merge(got, on=["k", "id"], suffixes=("", "_got"))
    assert len(merged) == 3000 and (merged.place == merged.place_got).all()
    import numpy as np
    slopes = {r.k: r.slope for r in ordering.slopes(df, ["k"], ["id"], "v").collect()}
    for k, g in df.toPandas().sort_values("id").groupby("k"):
        assert slopes[k] == pytest.approx(np.polyfit(range(len(g)), g.v, 1)[0])


def test_slope_of_one_point_is_null(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "k string, id int, v double")
    assert ordering.slopes(df, ["k"], ["id"], "v").first().slope is None


def test_first_n(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), "id", (F.col("id") % 50).alias("v"))
    got = ordering.first_n(df, ["k"], ["-v", "id"], 12, F.col("id"))
    want = sorted(((49 - 0, i) for i in range(49, 500, 50)))
    assert [r.id for r in got.orderBy("position").collect()][:10] == [i for _, i in want]


# --- values and validation ---------------------------------------------------------------------------------------

def test_numbers(spark):
    cases = {" 12 ": 12.0, "12d": None, "1_000": None, "1e3": 1000.0, "inf": math.inf, "-Infinity": -math.inf, "x": None, ".5": 0.5}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", values.number(F.col("t")).alias("v")).collect()} == cases
    nan = spark.createDataFrame([("NaN",)], "t string").select(
        values.outside(values.number(F.col("t")), F.lit(0.0), F.lit(1.0)).alias("o")).first().o
    assert nan is False


def test_entity_validation(spark):
    v = vertex(spark, [
        ("good", "FinancialInstrument", {"name": "b", "type": "bond", "issuer": "x", "face_value": "inf", "maturity_date": "2030",
                                         "documents": '["prospectus","offering_memorandum"]'}, 1.0, "d"),
        ("bad", "FinancialInstrument", {"name": None, "isin": "x", "face_value": "-1", "coupon_rate": "much",
                                        "documents": "[]"}, 1.0, "d"),
        ("free", "Location", {}, 1.0, "d")])
    done = validation.validate_entities(v, frames.rule_checks(spark))
    found = {(r.check, r.field, r.action, r.message) for r in validation.findings(done).collect() if r.subject_id == "bad"}
    assert found == {
        ("required", "type", "add", "Missing required field: type"), ("required", "issuer", "add", "Missing required field: issuer"),
        ("pattern", "isin", "format", "Field isin does not match required pattern"),
        ("metric", "maturity_date", "add", "Missing required financial metric: maturity_date"),
        ("metric_range", "face_value", "adjust", "Financial metric face_value value -1 is outside allowed range [0.0, Infinity]"),
        ("metric_range", "coupon_rate", "convert", "Financial metric coupon_rate must be a numeric value"),
        ("document", "documents", "add", "Missing required regulatory document: prospectus"),
        ("document", "documents", "add", "Missing required regulatory document: offering_memorandum")}
    report = {r.id: (r.findings, r.overall_status, round(r.confidence_score, 6)) for r in validation.report(done).collect()}
    assert report == {"good": (0, "info", 1.0), "bad": (8, "error", 0.3), "free": (0, "info", 1.0)}
    again = validation.report_from_findings(validation.findings(done), v)
    assert rows(again, "id", "findings", "overall_status") == rows(validation.report(done), "id", "findings", "overall_status")


def test_disabled_rules_and_domain(spark):
    checks = frames.rule_checks(spark)
    v = vertex(spark, [("a", "Account", {"compliance_status": '{"KYC": 1}', "risk_assessment": '["credit_risk"]'}, 1.0, "d")])
    found = validation.findings(validation.validate_domain(v, checks, "banking"))
    kinds_ = {r.check: r.n for r in found.groupBy("check").agg(F.count("*").alias("n")).collect()}
    assert kinds_ == {"required": 4, "metric": 3, "compliance": 3, "risk": 3}
    off = checks.withColumn("enabled", F.lit(False))
    assert validation.findings(validation.validate_domain(v, off, "banking")).count() == 0


# --- corrections -------------------------------------------------------------------------------------------------

def test_log_order_and_clamp(spark):
    v = vertex(spark, [("a", "X", {"n": "7.5", "s": "q"}, 1.0, "d"), ("b", "X", {"n": "1"}, 1.0, "d")])
    log = spark.createDataFrame(
        [("1", "a", "adjust", "n", {"min": "0", "max": "5"}, 1, True), ("2", "a", "update", "n", {"value": "100"}, 0, True),
         ("3", "a", "remove", "s", {}, 0, True), ("4", "a", "update", "missing", {"value": "x"}, 0, True),
         ("5", "b", "remove", "n", {}, 0, False)],
        "correction_id string, subject_id string, strategy string, field string, params map<string,string>, priority int, is_active boolean")
    got = {r.id: r.properties for r in corrections.apply_logged(v, log).collect()}
    assert got == {"a": {"n": "5.0"}, "b": {"n": "1"}}


# --- graph -------------------------------------------------------------------------------------------------------

GRAPH = [("e1", "T", "a", "b"), ("e2", "T", "a", "b"), ("e3", "T", "b", "c"), ("e4", "U", "c", "c"), ("e5", "T", "c", "a")]


def test_trails_against_brute_force(spark):
    e = edge(spark, GRAPH)
    seeds = spark.createDataFrame([("a",)], "id string")
    want = set()

    def walk(at, used):
        for i, _, s, d in GRAPH:
            if i not in used and at in (s, d):
                new = (*used, i)
                want.add(new)
                if len(new) < 4:
                    walk(d if at == s else s, new)
    walk("a", ())
    got = [tuple(r.edge_ids) for r in graph.paths(e, seeds, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_self_loop_once_and_subgraph(spark):
    e, v = edge(spark, GRAPH), vertex(spark, [(x, "N", {}, 1.0, "d") for x in "abc"])
    c = spark.createDataFrame([("c",)], "id string")
    assert rows(graph.edges_of(e, c), "id") == [("e3",), ("e4",), ("e5",)]
    nodes, links = graph.subgraph(e, c, 1)
    assert rows(nodes, "id", "distance") == [("a", 1), ("b", 1), ("c", 0)] and rows(links, "edge_id") == [("e3",), ("e4",), ("e5",)]
    m = {(r.measure, r.item): r.value for r in graph.network_metrics(nodes, links, v, e).collect()}
    assert m[("average_degree", "all")] == pytest.approx(5 / 3)


def test_merge_long_chain(spark):
    n = 200
    pairs = spark.createDataFrame([(f"v{i:03d}", f"v{i + 1:03d}") for i in range(n)], "id1 string, id2 string")
    got = resolution.merge_groups(pairs)
    assert got.count() == n + 1 and rows(got.select("canonical").distinct()) == [("v000",)]
    e = edge(spark, [("x", "T", "v001", "v009"), ("y", "T", "v003", "z"), ("loop", "T", "v005", "v005")])
    assert rows(resolution.merge_edges(e, got), "id", "src", "dst") == [("loop", "v000", "v000"), ("y", "v000", "z")]


def test_similarity(spark):
    v = vertex(spark, [("a", "T", {"x": "1", "y": "2"}, 1.0, "d"), ("b", "T", {"x": "1", "y": "3"}, 1.0, "d"),
                       ("c", "T", {"q": "1"}, 1.0, "d")])
    e = edge(spark, [("1", "T", "a", "n"), ("2", "T", "b", "n"), ("3", "T", "b", "m")])
    got = resolution.similar(v, e, spark.createDataFrame([("a",)], "id string"), 0.3)
    assert rows(got, "id", "similarity") == [("b", pytest.approx(0.5 / 3 + 0.25))]


def test_deduplicate_nulls_equal(spark):
    df = spark.createDataFrame([(2, None), (1, None), (3, "x")], "id int, k string")
    assert rows(resolution.deduplicate(df, {"k": F.col("k")}, ["id"]), "id") == [(1,), (3,)]


def test_store_replaces_documents(spark, tmp_path):
    v = vertex(spark, [("a", "N", {}, 1.0, "d1"), ("b", "N", {}, 1.0, "d2")])
    e = edge(spark, [("e1", "T", "a", "b"), ("e2", "T", "a", "gone")])
    folder = str(tmp_path / "graph")
    for _ in range(2):
        store.save_graph(v, e, folder)
        sv, se = store.load_graph(spark, folder)
        assert sv.count() == 2 and rows(se, "id") == [("e1",)]
    store.save_graph(v.filter("id = 'a'"), e.filter("false"), folder)
    sv, se = store.load_graph(spark, folder)
    assert sv.count() == 2 and rows(se, "id") == [("e1",)]
    assert {p.name for p in (tmp_path / "graph" / "vertices").glob("bucket=*")} <= {f"bucket={i}" for i in range(store.BUCKETS)}


def test_store_drops_what_a_run_no_longer_finds(spark, tmp_path):
    v = vertex(spark, [("a", "N", {}, 1.0, "d1"), ("b", "N", {}, 1.0, "d2"), ("c", "N", {}, 1.0, "d2")])
    e = edge(spark, [("e1", "T", "a", "b"), ("e2", "T", "a", "c")]).withColumn("source_document", F.lit("d1"))
    folder = str(tmp_path / "graph")
    store.save_graph(v, e, folder)
    store.save_graph(v.filter("id = 'b'"), e.filter("false"), folder)  # d2 has lost c, and d1's edge to it goes
    assert [rows(x, "id") for x in store.load_graph(spark, folder)] == [[("a",), ("b",)], [("e1",)]]
    store.save_graph(v.filter("id = 'c'"), e.filter("false"), folder, replace=False)
    assert [rows(x, "id") for x in store.load_graph(spark, folder)] == [[("a",), ("b",), ("c",)], [("e1",), ("e2",)]]
    store.save_graph(v.filter("false"), e.filter("false"), folder, documents=spark.createDataFrame([("d2",)], "source_document string"))
    assert [rows(x, "id") for x in store.load_graph(spark, folder)] == [[("a",)], []]


def test_names_of_any_form(spark):
    text = 'Anna Maria Lee of "Acme Holdings Ltd" met 3M, then Acme#12 and ACME  holdings; Acme Holdings Ltd. Lee left.'
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    names = spark.createDataFrame([("Acme Holdings Ltd", "COMPANY"), ("acme holdings", "COMPANY"), ("3M", "COMPANY"), ("Acme#12", "COMPANY"),
                                   ("anna maria lee", "PERSON"), ("Maria Lee", "PERSON"), ("...", "PERSON"), (None, "PERSON")], "name string, label string")
    found = mentions.known_names(df, names)
    want = [("Anna Maria Lee", "PERSON"), ("Acme Holdings Ltd", "COMPANY"), ("3M", "COMPANY"), ("Acme#12", "COMPANY"),
            ("ACME  holdings", "COMPANY"), ("Acme Holdings Ltd", "COMPANY")]
    got = sorted(found.collect(), key=lambda r: r.start)
    assert [(r.text, r.type) for r in got] == want and all(text[r.start:r.end] == r.text for r in got)
    both = mentions.with_names(mentions.find_mentions(df), found)
    assert rows(both.filter("type <> 'PERSON'"), "text") == sorted([(t,) for t, k in want if k == "COMPANY"], key=str)
    assert mentions.known_names(df, names.limit(0)).count() == 0


def test_declared_constraints(spark):
    v = vertex(spark, [("a", "Company", {"name": "x", "ticker": "T"}, 1.0, "d"), ("b", "Company", {"name": "x", "ticker": "U"}, 1.0, "d"),
                       ("p", "Person", {"birth_date": "2001-01-01", "death_date": "1999-01-01"}, 1.0, "d"),
                       ("q", "Person", {"birth_date": "1901-01-01"}, 1.0, "d")])
    e = spark.createDataFrame([("1", "EMPLOYMENT", "a", "p", {"role": "cook"}), ("2", "EMPLOYMENT", "b", "p", {"role": "cook"}),
                               ("3", "EMPLOYMENT", "a", "q", {"role": "cook"}), ("4", "EMPLOYMENT", "a", "q", {"role": "clerk"}),
                               ("5", "EMPLOYMENT", "a", "a", {})], "id string, type string, src string, dst string, properties map<string,string>")
    assert rows(validation.declared_constraints(v, e), "subject_id", "check", "field") == [
        ("a", "unique", "name"), ("b", "unique", "name"), ("p", "cardinality", "max_companies_per_role"), ("p", "period", "death_date"),
        ("q", "cardinality", "max_roles_per_person")]


def test_ids_and_order_over_pages(spark):
    df = spark.createDataFrame([("d", 1, "Cash paid 5% to it."), ("d", 2, "Cash paid 5% to it.")], "doc_id string, page int, text string")
    none = spark.createDataFrame([], "name string")
    v, _ = document_graph.to_graph(df, none, frames.entity_aliases(spark), frames.accepted_relations(spark), "2024-01-01 00:00:00")
    assert v.count() == v.select("id").distinct().count() == 4
    m = spark.createDataFrame([("d", 2, 0, "DATE"), ("d", 1, 9, "CURRENCY"), ("d", 1, 3, "CURRENCY")], "doc_id string, page int, start int, type string")
    assert rows(classify.simple_fields(m, 1), "page", "start") == [(1, 3)]
    assert rows(classify.common_label(m, 1), "label") == [("CURRENCY",)] and rows(classify.common_label(m, None), "label") == [("CURRENCY",)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.PDF").write_bytes(b"hello")
    (tmp_path / "in" / "big.pdf").write_bytes(b"x" * 100)
    got = {r["name"]: (r.suffix, r.md5) for r in files.fingerprints(files.scan(spark, str(tmp_path / "in"))).collect()}
    assert got == {"A.PDF": ("pdf", hashlib.md5(b"hello").hexdigest()), "big.pdf": ("pdf", hashlib.md5(b"x" * 100).hexdigest())}
    large = spark.range(1).selectExpr("'a/b.pdf' AS path", f"{60 * 1024 * 1024}L AS length", "encode(repeat('x', 62914560), 'utf-8') AS content")
    assert files.fingerprints(large).first().md5 == hashlib.md5(b"x" * 62914560).hexdigest()  # sizes are a matter of admission
    adm = spark.createDataFrame([("a.pdf", 10), ("b.txt", 10), ("c.PDF", 99)], "name string, length long")
    assert rows(files.admit(adm, most=50), "name", "reason") == [("a.pdf", None), ("b.txt", "type"), ("c.PDF", "size")]


def test_long_values_and_windows(spark):
    value = spark.range(1).select(capitalised(F.expr("repeat('aB', 600000)")).alias("v")).first().v
    assert value == "A" + ("ab" * 600000)[1:]
    text = "Acme#1 paid 5% " + "and so on " * 20 + "to Beta#2."
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    far = rel.pairs(mentions.find_mentions(df, reach=250), window=250).collect()
    assert ("Acme#1", "Beta#2", text[:-1]) in {(r.src_text, r.dst_text, r.context) for r in far}
    assert ("Acme#1", "Beta#2") not in {(r.src_text, r.dst_text) for r in rel.pairs(mentions.find_mentions(df)).collect()}
    with pytest.raises(Exception, match="reach of 250"):
        rel.pairs(mentions.find_mentions(df), window=250).collect()


# --- trends and quality --------------------------------------------------------------------------------------------

def test_metric_points_drop_zero(spark):
    e = edge(spark, [(str(i), "HAS_METRIC", "a", "m") for i in range(3)]).withColumn(
        "properties", F.create_map(F.lit("type"), F.lit("r"), F.lit("timestamp"), F.col("id"), F.lit("value"),
                                   F.when(F.col("id") == "1", "0").otherwise(F.concat(F.col("id"), F.lit("0")))))
    pts = trends.metric_points(e.filter("id <> '0'"))
    s = trends.summary(pts, ["entity", "metric"], ["ts", "edge_id"]).first()
    assert (s.points, s.current_value, s.growth_rate, s.volatility, s.trend) == (1, 20.0, 0.0, 0.0, None)


def test_quartiles(spark):
    pdf = pd.DataFrame({"metric_type": ["a"] * 10 + ["b"] * 3, "value": [float(x * x) for x in range(13)], "event_id": range(13)})
    got = {r.metric_type: (r.q1, r.median, r.q3) for r in quality.quartiles(spark.createDataFrame(pdf)).collect()}
    for k, g in pdf.groupby("metric_type"):
        assert got[k] == pytest.approx(tuple(g.value.quantile([0.25, 0.5, 0.75])))


# --- status and streams --------------------------------------------------------------------------------------------

EVENTS = [(1, "d", "2024-01-01 00:00:00", "pending", None, None), (3, "d", "2024-01-01 02:00:00", "failed", None, "boom"),
          (2, "d", "2024-01-01 01:00:00", "processing", "entity_extraction", None),
          (4, "d", "2024-01-01 03:00:00", "processing", "entity_extraction", None),
          (5, "d", "2024-01-01 04:00:00", "completed", None, None), (6, "e", "2024-01-05 00:00:00", "pending", None, None)]


def events(spark):
    return spark.createDataFrame(
        [(*e, 0.5, 10, 5) for e in EVENTS], "event_id long, document_id string, t string, status string, stage string, "
        "error_message string, progress double, entities_processed long, relationships_processed long") \
        .withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_status_batch_and_stream_agree(spark, tmp_path):
    e = events(spark)
    folder = str(tmp_path / "events")
    for i in range(3):  # three files, so three batches, and out of order
        e.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    stream = runs.file_stream(spark, folder, e.schema, files_per_batch=1)
    table = runs.run_to_table(runs.status_state(stream), "update", str(tmp_path / "out"))
    cols = [c for c in status.current(e).columns]
    assert rows(runs.latest_rows(spark, table, ["document_id"]), *cols) == rows(status.current(e), *cols)
    d = status.current(e).filter("document_id = 'd'").first()
    assert (d.status, d.retry_count, d.last_error, d.processing_duration) == ("completed", 1, "boom", 4 * 3600.0)
    assert str(d.entity_extraction_at) == "2024-01-01 01:00:00"


def test_expired_once_and_repeats_ignored(spark, tmp_path):
    e = events(spark)
    folder = str(tmp_path / "events")
    e.unionByName(e).coalesce(1).write.parquet(folder)
    stream = runs.file_stream(spark, folder, e.schema)
    out = spark.read.parquet(runs.run_to_table(runs.expiring_state(stream), "append", str(tmp_path / "out")))
    assert rows(out, "document_id", "updates") == [("d", 5)]


def test_processing_metrics(spark):
    m = status.processing_metrics(events(spark)).first()
    assert (m.total_documents, m.processed_documents, m.failed_documents, m.average_processing_time) == (2, 1, 1, 4 * 3600.0)
