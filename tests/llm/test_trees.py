"""Context-tree weighting against a sequential brute-force version."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgergraph.llm import trees

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPS))


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


class Sequential:
    """Trees that are updated bit by bit, with the probability of everything seen at each node."""

    def __init__(self):
        self.kt, self.weighted, self.counts = Counter(), Counter(), {}

    def path(self, context, decision):
        return [(context[trees.DEPTH - d:], decision) for d in range(trees.DEPTH + 1)]

    def add(self, context, decision, bit):
        path = self.path(context, decision)
        for key in path:
            c = self.counts.setdefault(key, [0, 0])
            self.kt[key] += math.log((c[bit] + 0.5) / (sum(c) + 1))
            c[bit] += 1
        for d in range(trees.DEPTH, -1, -1):
            self.weighted[path[d]] = self.top(path[d], d)

    def top(self, key, d):
        if d == trees.DEPTH:
            return self.kt[key]
        below = sum(self.weighted.get((bytes([x]) + key[0], key[1]), 0) for x in range(256))
        return np.logaddexp(self.kt[key], below) - math.log(2)

    def one(self, context, decision):
        """Probability of a one: what one more would make of the root."""
        path, kept = self.path(context, decision), {}
        before = self.weighted.get(path[0], 0)
        for key in path:
            kept[key] = (self.kt.get(key), self.weighted.get(key), list(self.counts.get(key, [0, 0])))
        self.add(context, decision, 1)
        after = self.weighted[path[0]]
        for key, (k, w, c) in kept.items():
            for table, v in ((self.kt, k), (self.weighted, w)):
                table.pop(key, None) if v is None else table.__setitem__(key, v)
            self.counts.pop(key, None) if c == [0, 0] else self.counts.__setitem__(key, c)
        return math.exp(after - before)


def bits(byte):
    return [((1 << t) - 1 + (byte >> (8 - t)), byte >> (7 - t) & 1) for t in range(8)]


def positions(text):
    deep = trees.DEPTH
    data = b"\n" * deep + " ".join(words(text)).encode() + b"\n"
    return [(data[i - deep:i], data[i]) for i in range(deep, len(data))]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choices(["th", "the", "Ön", "a\tb", "zz"], k=rng.randrange(6)))) for i in range(24)]
    out += [(30, None), (31, ""), (None, "the A"), (4, out[4][1]), (40, "never Seen ü")]
    return out + [(d, " ".join(rng.choices(["th", "a", "rare", "bb", "Ön"], k=250))) for d in (51, 52, 55, 59)]  # long for the batches


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, docs, small, monkeypatch):
    if small:  # most words and grams are joined, not broadcast
        monkeypatch.setattr(trees, "WORDS", 1)
        monkeypatch.setattr(trees, "GRAMS", 5)
        monkeypatch.setattr(trees, "BATCH", 40)  # and long texts are coded in parts
        monkeypatch.setattr(trees, "HELD", 20)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, word string")
    got = trees.score(df).collect()
    model, seen = Sequential(), Counter()
    for d, t in docs:
        if fold(d) != 1:
            seen.update([*words(t), None])
            for context, byte in positions(t):
                for decision, bit in bits(byte):
                    model.add(context, decision, bit)
    n, v = sum(seen.values()), len(seen)
    want = []
    for d, t in docs:
        w = [*words(t), None]
        base = sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(p if bit else 1 - p) for c, b in positions(t) for decision, bit in bits(b) for p in [model.one(c, decision)])
        want.append((str(d), fold(d) == 1, len(w), sum(x in seen for x in w), n, round(base, 6), round(score, 3)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got) == sorted(want)


def test_nothing_to_learn_from(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert trees.score(df.limit(0)).count() == 0
    only = df.where(trees.held_out(df["doc_id"]))
    for r in trees.score(only).collect():
        assert r.n_known == r.train_tokens == 0 and r.bits_per_byte == pytest.approx(8)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1e3, 1e9])
    assert np.allclose(trees.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_lookup():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = trees.Lookup(np.float32)
    for part in np.array_split(np.arange(len(keys[::2])), 3):
        table.add(keys[::2][part], part.astype(np.float32))
    value, unknown = table.find(keys)
    assert value[::2].tolist() == list(range(len(keys[::2]))) and unknown.tolist() == list(range(1, len(keys), 2))
    roomy = trees.Lookup(np.float32, len(keys))
    places = len(roomy.keys)
    roomy.add(keys, np.arange(len(keys), dtype=np.float32))
    assert len(roomy.keys) == places < 2 * len(keys) and roomy.find(keys)[0].tolist() == list(range(len(keys)))
    assert trees.Lookup(np.int64).find(keys[:3])[1].tolist() == [0, 1, 2]
