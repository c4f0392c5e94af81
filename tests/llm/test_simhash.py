"""SimHash fingerprints, anchors and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from ledgergraph.llm import simhash
from ledgergraph.llm.components import components

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPS))
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    label = dict.fromkeys(nodes)
    for n in sorted(nodes):
        if label[n] is None:
            todo, label[n] = [n], n
            while todo:
                x = todo.pop()
                for y in nodes:
                    if label[y] is None and linked(x, y):
                        label[y] = n
                        todo.append(y)
    return label


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeäß", k=4)) for _ in range(400)]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 60, 300])))) for i in range(120)]
    for i in range(120, 220):
        w = out[rng.randrange(100)][1].split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        out.append((i, "  ".join(w) + "\n"))
    return out + [(500, None), (501, ""), (502, " \n "), (None, "aa bb"), (None, out[0][1]), (7, out[7][1]), (503, "x " * 20000)]


def test_fingerprints(rows):
    texts = [t or "" for _, t in rows]
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]
    assert len(simhash.fingerprints_of(pa.array([], pa.string()))) == 0


def test_components(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, row long, label string, kept boolean")
    fps = [fingerprint(t) for _, t in rows]
    label = reach(set(fps), lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        least[label[f]] = min((x for x in (d, least.get(label[f])) if x is not None), default=None)
    want = sorted((str(d), f"{f:016x}", str(least[label[f]])) for (d, _), f in zip(rows, fps, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_components(df).collect())
    assert got == want and len(set(least.values())) < len(set(fps))
    kept = simhash.near_duplicates(simhash.numbered(df.drop("row"))).where("kept").collect()
    assert sorted(str(r.component_id) for r in kept) == sorted(str(x) for x in least.values())
    monkeypatch.setattr(simhash, "BLOCK", 2)
    assert simhash.near_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("segments", [1, 2, 3, 4])
def test_anchors_meet(segments):
    rng = np.random.default_rng(segments)
    x = rng.integers(0, 2**63, 40).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(40, bool)
    for cover in simhash.covers(4, segments):
        (i, a), (j, b) = cover.anchors(x), cover.anchors(y)
        met |= [bool(set(a[i == k].tolist()) & set(b[j == k].tolist())) for k in range(40)]
    assert met.all()


def test_crowded_anchors_are_split(spark):
    rng = np.random.default_rng(1)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(300)]
    fps = sorted({int(np.uint64(0x123456789ABCDEF) ^ f) for f in flips})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    found = components(simhash.links(df, block=8)).collect()
    label = reach(set(fps), lambda x, y: (x ^ y).bit_count() <= 4)
    groups = {}
    for r in found:
        groups.setdefault(r.label % 2**64, {r.label % 2**64}).add(r.node % 2**64)
    want = {}
    for f, r in label.items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_forest(pairs):
    from ledgergraph.llm.components import forest
    a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    x, y = forest(a, b)
    label = reach({*a.tolist(), *b.tolist()}, lambda p, q: (p, q) in pairs or (q, p) in pairs)
    assert dict(zip(x.tolist(), y.tolist(), strict=True)) == {n: r for n, r in label.items() if n != r}


def test_long_chain(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {(r.node, r.label) for r in components(df).collect()} == {(i, 0) for i in range(1, 60)}
