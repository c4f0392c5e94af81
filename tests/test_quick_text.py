"""The quick ways of finding mentions, pairs, patterns and flags against the plain ones."""

import random

from pyspark.sql import functions as F

from ledgergraph.catalog import relations as catalog
from ledgergraph.operators import mentions, relations

WORDS = ["Acme#1", "beta#22x", "Gamma#3", "é", "revenue growth", "Profit Margin,", "PE", "pet", "retail market", "Retail Market#5", "purchase order", "sales",
         "$1,234.50 million", "7.5%", "12 %", "2024-05-06", "2024-05-067", "1,2,3", "owns a stake", "competes with", "not", "in 2024", "\u0001", "€5", "™", "a®b", "growth", "R&D synergies",
         "head office", "x", "cash receivable", "cash receivables", "_eps", "eps_", "\nroi", "up. ", "Kacme#1", "patent no", "3:4"]


def texts(spark, n=150, seed=5):
    rng = random.Random(seed)
    rows = [(i % 140, None if i % 3 else i % 2, rng.choice([" ", " ", "-"]).join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(n)]
    rows += [(1000, 1, ""), (1001, 1, None), (None, None, "Acme#1 owns a stake in Gamma#3"), (1002, 1, " ".join(f"Acme#{i % 3}, {i}" for i in range(400)))]
    return spark.createDataFrame(rows, "doc_id int, page int, text string")


def same(a, b):
    assert a.schema.names == b.schema.names
    left, right = sorted(map(str, a.collect())), sorted(map(str, b.collect()))
    assert left == right
    return len(left)


def test_quick_pattern_finds_the_same(spark):
    df = texts(spark)
    quick = mentions.quick_matches(df, "text", mentions.quick_pattern(), ["doc_id"])
    plain = mentions.explode_matches(df, "text", mentions.mention_pattern(), ["doc_id"]).select("doc_id", "start", "end", "hit")
    assert same(quick, plain) > 2000
    arrays = mentions.match_arrays(df, "text", mentions.quick_pattern(), ["doc_id"], "m")
    same(arrays.select("doc_id", F.inline("m")), plain)
    hit = F.col("hit")
    first = None
    for label, pattern in mentions.label_patterns():
        test = hit.rlike(f"(?i)^(?:{pattern})$")
        first = F.when(test, label) if first is None else first.when(test, label)
    assert plain.where(~mentions.label_of(hit).eqNullSafe(first)).count() == 0


def test_names_met_by_sentences_and_partners(spark):
    df = texts(spark)
    names = spark.createDataFrame([("ACME#1",), ("gamma#3",), ("Beta#22",), ("Acme#1",), (None,)], "name string")
    marks = {relations.CANDIDATES: relations.candidates}
    plain = mentions.confirm_names(mentions.find_mentions(df, per_sentence=marks), names)
    assert plain.where("type = 'COMPANY'").count() > 100
    columns = plain.columns
    assert same(mentions.find_mentions(df, per_sentence=marks, names=names).select(columns), plain) > 1000
    both = mentions.find_mentions(df, per_sentence=marks, names=names, partners=True)
    same(both.select(columns), plain)
    # Rows of one text key may repeat in the table, and the frame would mix their mentions.
    once = df.dropDuplicates(["doc_id", "page"])
    plain = mentions.confirm_names(mentions.find_mentions(once, per_sentence=marks), names)
    both = mentions.find_mentions(once, per_sentence=marks, names=names, partners=True)
    assert same(relations.pairs(both), relations.pairs(plain)) > 1000
    same(relations.score(relations.pairs(both)), relations.score(relations.pairs(plain.drop(relations.CANDIDATES))))


def test_other_labels_are_spread(spark):
    """Mentions that are no companies don't all go to the task of the null key."""
    df = spark.range(4000).selectExpr("id AS doc_id", "1 AS page", "'revenue' AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = mentions.confirm_names(mentions.find_mentions(df, context=False), spark.createDataFrame([("Acme#1",)], "name string"))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_cues_lose_no_flag(spark):
    rng = random.Random(6)
    entries = [w for g, n, _ in catalog.flag_rows() for w in catalog.FLAGS[g][n].split("|") if not catalog.FLAGS[g][n].startswith("re:")]
    rows = [(" ".join(rng.choices(entries + WORDS, k=12)),) for _ in range(200)]
    df = spark.createDataFrame(rows, "context string")
    same(relations.flag_counts(df.withColumn(relations.CUES, relations.cues(F.col("context")))), relations.flag_counts(df))
