"""The near-dedup stage against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ledgergraph.llm import simhash, similar, stages
from ledgergraph.llm.common import numbered, stored
from tests.llm.test_simhash import reach


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(min(1, len(words)), len(words) - 4)))


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies of one to many changed words, around the similarity of 0.8 and well under it."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abdeilmnorst", k=rng.randrange(2, 8))) for _ in range(900)]
    base = [rng.choices(vocabulary, k=rng.choice([40, 120, 300])) for _ in range(60)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, words in enumerate(base * 3):
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.choice([1, 2, 3, 6])):
            copy[at] = "zebra"
        docs.append((100 + i, " ".join(copy)))
    docs += [(900 + i, " ".join([*base[0][:-2], f"x{i}", "end"])) for i in range(40)]
    return docs + [(1000, "a b"), (1001, "A  b"), (1002, ""), (1003, None), (None, docs[7][1]), docs[8], docs[8]]


@pytest.mark.parametrize("block", [512, 16])
def test_every_pair_of_near_copies_is_linked(spark, corpus, tmp_path, monkeypatch, block):
    monkeypatch.setattr(similar.links, "__defaults__", (block,))
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = stages.dedup_nearly(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    label = reach({shingles(t) for _, t in corpus}, alike)
    least = {}
    for d, t in corpus:
        least.setdefault(label[shingles(t)], []).append(d)
    want = sorted(min((d for d in g if d is not None), default=-1) for g in least.values())
    assert sorted(r.doc_id for r in out.collect()) == want and len(want) < len(corpus) - 40


def test_stage_takes_the_fingerprints_components(spark, corpus, tmp_path, monkeypatch):
    """Texts that meet nowhere but in a component of op3's fingerprints are compared, and only links of similar ones stay."""
    docs = stored(numbered(spark.createDataFrame(corpus, "doc_id long, text string")), "corpus")
    found = simhash.near_duplicates(docs)
    rows = similar.signatures(docs).drop("keys")
    nodes = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.min("size").alias("size"))
    nodes = stored(nodes.withColumn("keys", F.array("fp")), "alone")
    assert similar.links(docs, nodes).count() == 0
    groups = found.join(rows.select("row", "fp"), "row").select("fp", F.xxhash64("least").alias("at"))
    linked = {frozenset(r) for r in similar.links(docs, nodes, groups=groups).collect()}
    shown = {r.fp: r.text for r in rows.join(docs.select("row", "text"), "row").collect()}
    assert len(linked) > 20 and all(alike(*(shingles(shown[x]) for x in pair)) for pair in linked)
    calls = []
    whole = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: calls.append(1) or whole(docs))
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stages.dedup_nearly(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert calls == [1]


def test_pairs_that_share_no_key(spark, tmp_path):
    """Pairs just above the threshold that neither a MinHash key nor a component of fingerprints brings together."""
    docs = []
    for n, t in enumerate((2127, 11151, 15184, 40252, 45570, 56565)):
        words = [f"{t}x{i}" for i in range(50)]
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:25], "zebra", *words[26:]]))]
        assert alike(*(shingles(d[1]) for d in docs[-2:]))
    keys = [set(k) for k in similar.band_keys(similar.shingle_sets(pa.array([t for _, t in docs])))]
    assert not any(a & b for a, b in zip(keys[::2], keys[1::2], strict=True))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = stages.dedup_nearly(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 6, 8, 10]


def test_prefixes_meet(corpus):
    """Any two similar sets share one of their first shingles, whatever counts as common."""
    sets = similar.shingle_sets(pa.array([t or "" for _, t in corpus]))
    every, n = np.unique(np.concatenate(sets), return_counts=True)
    for some in (slice(0, 0), slice(None), slice(None, None, 3)):
        first = [set(similar.in_order(s, every[some], n[some]).tolist()) for s in sets]
        assert all(first[i] & first[j] for i in range(len(sets)) for j in range(i) if similar.similar(sets[i], sets[j]))
