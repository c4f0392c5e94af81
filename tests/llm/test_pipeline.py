"""The pipeline's stages, one after the other, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgergraph.llm import queries
from ledgergraph.llm.common import stored
from tests.llm.test_sharding_dedup_binary import tokens
from tests.llm.test_simhash import reach
from tests.llm.test_similar import alike, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, kept boolean, hash string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, near copies, benchmark items, nulls and repeated rows."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abdeilmnorst", k=rng.randrange(2, 8))) for _ in range(900)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k)).capitalize() + "."
    items = [(i, text(30)) for i in range(6)]
    docs = [(i, text(rng.choice([30, 120, 400]))) for i in range(200)]
    docs += [(200 + i, docs[i][1].upper().replace(" ", "!! ")) for i in range(100)]
    docs += [(300 + i, docs[i][1]) for i in range(30)]
    docs += [(400 + i, docs[i][1].replace(docs[i][1].split()[3], "zebra", 1)) for i in range(100, 130)]
    docs += [(500 + i, text(80) + " " + t + " " + text(40)) for i, t in items]
    docs += [(600, None), (601, ""), (None, text(50)), docs[5], docs[150], docs[150]]
    rows = [(d, t, "en", "s", len(t or ""), 1, 2, False, "h") for d, t in docs]
    labels = [(d, 0 if 200 <= d < 300 else 1, 0) for d in range(300)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, items


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, path), name.replace(" ", "-"))
        assert out.schema == docs.schema
        kept.append((pairs(docs), pairs(out)))
        docs = out

    before, after = kept[0]
    scores = queries.QUERIES["op7_quality"](spark, path).groupBy("doc_id").agg(F.min("predicted").alias("p")).collect()
    good = {r.doc_id for r in scores if r.p == 1}
    assert set(after) == {x for x in before if x[0] in good} and not any(x[0] and 200 <= x[0] < 300 for x in after)
    assert sum(before.values()) - sum(after.values()) < 110

    before, after = kept[1]
    best = {}
    for d, t in before:
        best[t or ""] = max((x for x in (d, best.get(t or "")) if x is not None), default=None)
    assert Counter((d, t or "") for d, t in after.elements()) == Counter((d, t) for t, d in best.items())

    before, after = kept[2]
    label = reach({shingles(t) for _, t in before}, alike)
    groups = defaultdict(list)
    for d, t in before.elements():
        groups[label[shingles(t)]].append(d)
    least = Counter(min((d for d in g if d is not None), default=None) for g in groups.values())
    assert Counter(d for d, _ in after.elements()) == least and len(least) < sum(before.values())

    before, after = kept[3]
    assert before - after == Counter({x: n for x, n in before.items() if any(i in (x[1] or "") for _, i in items)}) and len(before - after) == 6

    want = Counter()
    for (d, t), n in kept[3][1].items():
        ids = tokens(t) + [2]
        want.update({(d, len(ids), i, x): n for i, x in enumerate(ids)})
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    got = Counter((r.doc_id, r.doc_tokens, r.start + i, x) for r in rows for i, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()))
    assert got == want
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.select("doc_id", "start", "length", "ids_crc32", "offset").collect())) == sorted(
        str(r) for r in spark.createDataFrame(rows).select("doc_id", "start", "length", "ids_crc32", "offset").collect())


def test_empty_table(spark, folder):
    path, _ = folder
    docs = stored(spark.read.parquet(f"{path}/documents.parquet").limit(0), "none")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), name.replace(" ", "-"))
        assert docs.count() == 0
