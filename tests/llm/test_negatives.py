"""Hard negatives against a ranking of all rows."""

import itertools
import math
import random

import numpy as np
import pytest

from ledgergraph.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = []
    for v, e, label in rows:
        if v is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((v, [math.floor(256 * float(np.float32(x))) for x in e], int(math.fmod(label + 1, 10)) if v % 7 == 0 else label))
    out = []
    for i, (a, va, la) in enumerate(kept):
        if a % 100:
            continue
        others = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb) for j, (b, vb, lb) in enumerate(kept) if j != i)
        for ps, p, _ in [x for x in others if x[2] == la][:5]:
            window = [x for x in others if x[2] != la and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(window, 1)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "'x' AS part", "0 AS question")
    return sorted(map(tuple, negatives.hard_negatives(df, **kw).collect()))


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_goes_step_by_step(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in negatives.hilbert_keys(points, bits)]
    path = points[sorted(range(len(points)), key=keys.__getitem__)]
    assert len(set(keys)) == len(points) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_all_scores():
    rng = np.random.default_rng(1)
    a, v = rng.integers(-90, 90, (20, 8)), rng.integers(-90, 90, (30, 8))
    low, high = negatives.score_bounds(a, v.min(0)[None], v.max(0)[None])
    s = a @ v.T
    assert (low[:, 0] <= s.min(1)).all() and (s.max(1) <= high[:, 0]).all()
    exact = negatives.score_bounds(a, v, v)
    assert (exact[0] == s).all() and (exact[1] == s).all()


@pytest.mark.parametrize("block, slice_bytes", [(8, 1 << 20), (64, 200)])
def test_brute_force(spark, monkeypatch, block, slice_bytes):
    monkeypatch.setattr(negatives, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(negatives, "AT_ONCE", 40)
    rng = random.Random(block)
    vector = lambda: [rng.gauss(0, 0.4) for _ in range(4)]
    near = [0.5, -0.5, 0.5, 0.5]
    rows = [(i * 5, vector(), rng.randint(0, 3)) for i in range(200)]
    rows += [(3000 + i, [x + rng.gauss(0, 0.01) for x in near], rng.choice([1, 1, 2])) for i in range(150)]  # a crowd
    rows += [(4000 + i, near, i % 2) for i in range(0, 120, 4)]  # ties
    rows += [rows[0], rows[0], (100, near, 2), (None, near, 1), (5000, None, 1), (5100, near, None), (5200, [math.nan] * 4, 1), (5300, [math.inf, 0.0, 0.0, 0.0], 1), (5400, [None, 0.5, 0.5, 0.5], 1),
             (5500, [0.0] * 4, 1), (5600, [0.5], 1), (5700, [], 2), (700, near, -3), (1400, [-x for x in near], 9)]
    want = brute(rows)
    assert len(want) > 500 and got(spark, rows, block=block) == want


def test_wide_numbers(spark):
    rng = random.Random(5)
    for scale in (100.0, 1e5):
        rows = [(i * 20, [rng.gauss(0, scale) for _ in range(3)], i % 3) for i in range(90)]
        assert got(spark, rows, block=16) == brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        got(spark, [(100, [1e30], 1), (200, [1.0], 1)])


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(100, None, 1)]) == [] and got(spark, [(100, [], 1), (3, [], 1), (1, [], 2)]) == [(100, 3, 1, 1, 0, 0)]
    assert got(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
