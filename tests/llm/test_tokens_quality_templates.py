"""Packing, length histograms, the quality classifier and template decontamination against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgergraph.llm import counts, packing, quality, templates
from tests.llm.test_sharding_dedup_binary import AWKWARD, SCHEMA, awkward, empty, tokens  # noqa: F401

WORDS = [a + b for a in ("th", "er", "on", "an", "ré", "he") for b in ("ing", "or", "le", "st", "ou")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    return rows + AWKWARD + [(900, " ".join(rng.choices(WORDS, k=6000)))]


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, corpus, window, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus], "doc_id long, text string, start long, ids string")
    rows = packing.pack(df, window).collect()
    want = Counter((d, tuple(tokens(t) + [2])) for d, t in corpus)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        by_window[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.doc_tokens, r.start, ids.tolist()))
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    padding = sum(window - sum(n for _, n in p) for p in by_window.values())
    assert padding <= window * df.rdd.getNumPartitions()
    ids = defaultdict(list)
    for d, parts in by_doc.items():  # each document's ids, every one once
        counted = Counter()
        for (e, t), n in want.items():
            if e == d:
                counted.update({(len(t), i, x): n for i, x in enumerate(t)})
        got = Counter((n, s + i, x) for n, s, part in parts for i, x in enumerate(part))
        assert got == counted
        ids[d] = parts
    assert set(ids) == {d for d, _ in want}


def test_neighbours_are_bm25(corpus):
    docs = [np.array(tokens(t) + [2]) for _, t in corpus[:60]]
    df = Counter(x for d in docs for x in set(d.tolist()))
    idf = np.zeros(50000)
    for x, n in df.items():
        idf[x] = np.log1p((len(docs) - n + 0.5) / (n + 0.5))
    average = np.mean([len(d) for d in docs])
    index = packing.Index(docs, idf, average)
    weigh = lambda d, x, tf: idf[x] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
    tf = [Counter(d.tolist()) for d in docs]
    for seed in (3, 10, 25):
        query = sorted(tf[seed], key=lambda x: (-weigh(docs[seed], x, tf[seed][x]), x))[:16]
        score = [sum(weigh(d, x, t[x]) for x in query if x in t) for d, t in zip(docs, tf, strict=True)]
        unused = np.ones(len(docs), bool)
        unused[[seed, 5]] = False
        want = [i for i in range(len(docs)) if unused[i] and score[i] > 0]
        got = index.neighbours(seed, unused).tolist()
        assert sorted(got) == want and np.allclose([score[i] for i in got], sorted((score[i] for i in want), reverse=True))


def test_empty_tables(empty, spark):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack(empty).count() == counts.histogram(empty).count() == 0
    assert quality.quality_scores(empty, labels).count() == templates.leaked_items(empty, items).count() == 0


def test_histogram(spark, corpus, monkeypatch):
    monkeypatch.setattr(counts, "BUCKET", 16)
    n = [len(tokens(t)) for _, t in corpus]
    hist = counts.histogram(spark.createDataFrame(corpus, "doc_id long, text string")).cache()
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(n)
    for length, r in rows.items():
        assert r.n_docs == n.count(length) and r.docs_from == sum(x >= length for x in n) and r.tokens_from == sum(x for x in n if x >= length)
        assert r.docs_total == len(n) and r.tokens_total == sum(n) and r.truncated_total == sum(min(x, length) for x in n)
        assert r.rank == pytest.approx(sum(x <= length for x in n) / len(n))
    limits = [0, 1, 7, 63, 512, 10**6]
    assert {r.limit: r.truncated_total for r in counts.truncated_totals(hist, limits).collect()} == {x: sum(min(x, y) for y in n) for x in limits}
    assert counts.quantile(hist, 0.5) == sorted(n)[-(-len(n) // 2) - 1]


def test_statistics(corpus):
    texts = [t or "" for _, t in corpus]
    x = quality.statistics(pa.array(texts))
    assert x.shape == (len(texts), quality.STATISTICS) and np.isfinite(x).all()
    i = texts.index("a b")
    assert x[i, 0] == pytest.approx(2 / 3) and x[i, quality.KINDS + 1] == pytest.approx(np.log(3))
    assert (quality.statistics(pa.array(texts).slice(5, 9)) == x[5:14]).all()


def test_kernel_is_approximated():
    rng = np.random.default_rng(0)
    m = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), np.zeros(0))
    x = rng.normal(size=(40, quality.STATISTICS))
    z = m.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x) ** 2).sum(2) / 2 / quality.STATISTICS)
    assert np.abs(z @ z.T - exact).max() < 0.25 and np.abs(z @ z.T - exact).mean() < 0.05


def test_pools():
    x, y = quality.pooled(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3.5]


def test_quality(spark, corpus):
    rng = random.Random(2)
    good = [" ".join(rng.choices(WORDS, k=rng.randrange(5, 90))) + "." for _ in range(500)]
    docs = [(i, t if i % 4 else t.upper().replace(" ", "!! ")) for i, t in enumerate(good)] + [(None, "x"), (600, None), (601, ""), (3, "again"), (602, "w " * 50000)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(450)] + [(None, 1, 0), (7, None, 1), (5, 1, 0)]
    df = spark.createDataFrame([(*d, 0.5, 9) for d in docs], "doc_id long, text string, score double, stats int")
    rows = quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in rows if r.doc_id is not None and r.doc_id < 500]) > 0.97
    other = spark.createDataFrame([(i, q if i is None or zlib.crc32(str(i).encode()) % 5 else 1 - (q or 0), 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    again = quality.quality_scores(df, other).collect()  # labels of fold 0 change nothing
    assert sorted(map(str, again)) == sorted(map(str, rows))


ITEMS = [(1, "On Monday morning Tom carried 12 kg of apples to the market and then Tom sold 5 kg of them to Anna for 7 dollars each"),
         (2, "the quick brown fox jumps over the lazy dog while seven birds watch from the old tree near the river"),
         (3, "to be or not"), (None, "a null item has enough words to be found by its windows today"), (5, None), (6, "short one")]


def test_templates(spark, monkeypatch):
    changed = ITEMS[0][1].replace("Tom", "Sven").replace("12", "340").replace("5 kg", "61 kg").replace("Anna", "Maria").replace("7", "9")
    mixed = ITEMS[0][1].replace("Tom carried 12", "Tom carried 99").replace("then Tom", "then Paul").replace("On Monday", "Paul")
    pad = "filler words that have nothing in common with it "
    docs = [(1, pad + ITEMS[0][1] + ". " + pad), (2, pad + changed), (3, ITEMS[1][1].upper()), (4, pad * 400), (5, None), (6, ""),
            (7, "To be, or not!"), (8, " ".join(ITEMS[1][1].split()[:9])), (9, pad + "the quick brown fox jumps over it"), (None, ITEMS[3][1]),
            (10, pad + " ".join(f"{w}***" for w in ITEMS[1][1].split())), (1, pad + ITEMS[0][1] + ". " + pad), (11, mixed)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item long, hash string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = templates.leaked_items(df, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) - Counter({(11, 1): 1}) == Counter({(1, 1): 2, (2, 1): 1, (3, 2): 1, (7, 3): 1, (None, None): 1, (10, 2): 1})
    by = {r.doc_id: r for r in rows}
    assert by[1].verbatim and by[1].slots > 0 and not by[2].verbatim and by[2].agreement == 1
    monkeypatch.setattr(templates, "SLICE", 7)  # the same in several passes
    assert sorted(map(str, templates.leaked_items(df, items).collect())) == sorted(map(str, rows))


def test_slots_that_disagree(spark):
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    ask = " ".join(f"{a} {b} {c} {d} Tom" for a, b, c, d in zip(words[::4], words[1::4], words[2::4], words[3::4], strict=False))
    names = iter(["Ann", "Bob", "Cyd", "Dan", "Eve", "Fay"])
    swapped = " ".join(next(names) if w == "Tom" else w for w in ask.split())
    df = spark.createDataFrame([(1, ask.replace("Tom", "Ann")), (2, swapped)], "doc_id long, text string")
    assert [r.doc_id for r in templates.leaked_items(df, spark.createDataFrame([(1, ask)], "item_id long, text string")).collect()] == [1]
