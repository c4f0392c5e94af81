"""The fold of a log of corrections, and the status of suggested ones, against one correction after the other."""

import random

from pyspark.sql import functions as F

from ledgergraph.operators import corrections
from ledgergraph.sources import corrections_log

SCHEMA = "correction_id string, subject_id string, strategy string, field string, params map<string,string>, priority int, is_active boolean"
VERTEX = "id string, type string, name string, properties map<string,string>, confidence double"


def number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def one(props, strategy, field, params):
    """True if it works; changes the properties."""
    if strategy == "add":
        props.setdefault(field, params.get("value"))
    elif strategy == "remove":
        props.pop(field, None)
    elif field not in props:
        return True
    elif strategy == "update":
        props[field] = params.get("value") if params.get("value") is not None else props[field]
    elif strategy == "format" and "format" in params and props[field] is not None:
        props[field] = params["format"].replace("{}", props[field])
    elif strategy == "adjust":
        if number(props[field]) is None:
            return False
        if "min" in params:
            props[field] = str(max(float(params["min"]), min(number(props[field]), float(params["max"]))))
    elif strategy == "convert" and params.get("type") == "float":
        if number(props[field]) is None:
            return False
        props[field] = str(number(props[field]))
    return True


def random_log(rng, n):
    kinds = {"add": [{}, {"value": "7"}], "remove": [{}], "update": [{"value": "3"}, {"value": "x"}, {}], "format": [{"format": "1{}"}, {}],
             "adjust": [{"min": "2", "max": "60"}, {}], "convert": [{"type": "float"}, {}]}
    out = []
    for i in range(n):
        strategy = rng.choice(list(kinds))
        out.append((f"c{i:05d}", f"e{rng.choice([0, 0, 0, 1, 2, 9])}", strategy, rng.choice("pqr"), rng.choice(kinds[strategy]), rng.randrange(4), rng.random() < 0.9))
    return out


def entities(spark):
    rows = [("e0", "T", "n", {"p": "5", "q": "word"}, 1.0), ("e1", "T", "n", {"r": "80"}, 1.0), ("e2", "T", "n", {}, 1.0), ("e3", "T", "n", {"p": "5"}, 1.0)]
    return spark.createDataFrame(rows, VERTEX), {r[0]: dict(r[3]) for r in rows}


def test_log_against_one_after_the_other(spark):
    rng = random.Random(1)
    for n in (5, 12, 25, 60):
        for _ in range(2):
            log = random_log(rng, n)
            df, want = entities(spark)
            for c in sorted(log, key=lambda c: (c[5], c[0])):
                if c[6] and c[1] in want:
                    one(want[c[1]], c[2], c[3], c[4])
            got = {r.id: r.properties for r in corrections.apply_logged(df, spark.createDataFrame(log, SCHEMA)).collect()}
            assert got == want, log
    empty = spark.createDataFrame([], SCHEMA)
    assert {r.id: r.properties for r in corrections.apply_logged(entities(spark)[0], empty).collect()} == entities(spark)[1]


def test_hot_subject(spark):
    """A third of a log on one field of one subject: cut at its last update, whatever came before."""
    log = spark.range(200_000).selectExpr("CAST(id AS STRING) AS correction_id", "IF(id % 3 = 0, 'e0', concat('x', id)) AS subject_id",
                                          "IF(id % 2 = 0, 'format', 'update') AS strategy", "'p' AS field", "map('value', CAST(id AS STRING), 'format', '<{}>') AS params",
                                          "CAST(id AS INT) AS priority", "true AS is_active")
    got = {r.id: r.properties for r in corrections.apply_logged(entities(spark)[0], log).collect()}
    assert got["e0"] == {"p": "199995" if 199_998 % 2 else "<199995>", "q": "word"}


def test_suggested_are_tried(spark):
    rng = random.Random(2)
    suggested = [(c[0], c[1], "rule", c[2], c[3], c[4], c[5], c[6]) for c in random_log(rng, 60)]
    df, want = entities(spark)
    status = {}
    for c in sorted(suggested, key=lambda c: (c[6], c[0])):
        if c[7]:
            status[c[0]] = "applied" if one(want.setdefault(c[1], {}), c[3], c[4], c[5]) else "failed"
    table = spark.createDataFrame(suggested, "correction_id string, subject_id string, rule string, strategy string, field string, params map<string,string>, priority int, is_active boolean")
    tried = corrections.with_status(table, df, auto_apply=True)
    assert {r.correction_id: r.status for r in tried.collect()} == status and set(status.values()) == {"applied", "failed"}
    assert {r.id: r.properties for r in corrections.apply_suggested(df, table).collect()} == {k: v for k, v in want.items() if k != "e9"}
    bad = {c[1] for c in suggested if status.get(c[0]) == "failed"}
    totals = corrections.batch_totals(tried, df).first()
    assert (totals.total_entities, totals.failed_corrections) == (4, len(bad - {"e9"}))
    assert {r.status for r in corrections.with_status(table, df, auto_apply=False).collect()} == {"suggested"}


def test_stored_log(spark, tmp_path):
    log = spark.createDataFrame(random_log(random.Random(3), 30), SCHEMA).withColumn("is_active", F.lit(True))
    folder = str(tmp_path / "log")
    corrections_log.append(log.where("priority < 2"), folder)
    corrections_log.append(log.where("priority >= 2"), folder)
    assert sorted(map(str, corrections_log.read(spark, folder).collect())) == sorted(map(str, log.collect()))
    corrections_log.withdraw(spark, log.where("strategy = 'add'").select("correction_id"), folder)
    assert {r.strategy for r in corrections_log.read(spark, folder).where("NOT is_active").collect()} == {"add"}
    assert corrections_log.read(spark, folder).where("is_active").count() == log.where("strategy <> 'add'").count()
