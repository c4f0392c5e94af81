"""Similar entities against all pairs; an item that everyone has costs nothing."""

import random

import pytest

from ledgergraph.operators import resolution

VERTEX = "id string, type string, name string, properties map<string,string>, confidence double"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a & b else 0.0


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75])
def test_against_all_pairs(spark, threshold):
    rng = random.Random(5)
    props = {f"v{i}": {"all": "same", **{k: rng.choice("xyz") for k in rng.sample("abcdef", rng.randint(0, 6))}} for i in range(40)}
    props["v40"] = {}
    edges = [(f"e{i}", "T", f"v{rng.randrange(41)}", f"h{rng.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(120)] + [("l", "T", "v0", "v0")]
    v = spark.createDataFrame([(i, "T", "n", p, 1.0) for i, p in props.items()], VERTEX)
    e = spark.createDataFrame(edges, "id string, type string, src string, dst string")
    near = {i: {d for _, _, s, d in edges if s == i} | {s for _, _, s, d in edges if d == i} for i in props}
    items = {i: {f"{k}={x}" for k, x in p.items()} for i, p in props.items()}
    seeds = ["v0", "v3", "v7", "v40"]
    want = set()
    for s in seeds:
        rows = [(0.5 * jaccard(items[s], items[i]) + 0.5 * jaccard(near[s], near[i]), i) for i in props if i != s]
        want |= {(s, i, round(x, 9), n) for n, (x, i) in enumerate(sorted([r for r in rows if r[0] >= threshold], key=lambda r: (-r[0], r[1])), 1)}
    got = resolution.similar(v, e, spark.createDataFrame([(s,) for s in seeds], "id string"), threshold).collect()
    assert {(r.seed, r.id, round(r.similarity, 9), r.rank) for r in got} == want


def test_common_items_are_not_looked_up(spark):
    items = spark.range(2000).selectExpr("concat('c', id) AS id", "explode(array('all', 'most', concat('own', id), concat('pair', id DIV 2))) AS item")
    seeds = spark.createDataFrame([("c4",)], "id string")
    rare = resolution.rarest(items, seeds, 0.6)
    assert {r.item for r in rare.collect()} == {"own4", "pair2"}
    sizes = items.groupBy("id").count().withColumnRenamed("count", "n")
    assert [tuple(r) for r in resolution.candidates(items, sizes, seeds, 0.6).collect()] == [("c4", "c5")]


def test_items_of_others_stay_where_they_are(spark):
    """What the seeds have is written as a table of a known size, so it is broadcast and the items of all others aren't shuffled to it."""
    items = spark.range(200_000).selectExpr("concat('v', id) AS id", "concat('k', id % 50000) AS item")
    seeds = spark.range(200_000).selectExpr("concat('v', id) AS id").where("id = 'v7'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        rare = resolution.rarest(items, seeds, 0.5)
        plan = rare._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [item" in plan and "LeftSemi" in plan
        assert [tuple(r) for r in rare.collect()] == [("v7", "k7")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
