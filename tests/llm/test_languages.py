"""Hyperdimensional profiles against vectors bundled trigram by trigram."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgergraph.llm import languages
from ledgergraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def grams(text):
    symbols = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return Counter(symbols[i:i + 3] for i in range(len(symbols) - 2))


def bundle(text):
    letters, out = languages.Letters(), np.zeros(languages.DIM)
    for gram, n in grams(text).items():
        a, b, c = (letters.vector(ord(x)).astype(int) for x in gram)
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 3


def brute(rows):
    sums = defaultdict(lambda: np.zeros(languages.DIM))
    for d, text, lang in rows:
        if fold(d) != 1 and text and lang is not None:
            sums[lang] += bundle(text)
    sums = {k: v for k, v in sums.items() if v.any()}
    out = []
    for d, text, _ in rows:
        v = bundle(text or "")
        best = max(((float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), k) for k, p in sorted(sums.items())), key=lambda x: x[0], default=(0, "und")) if v.any() else (0, "und")
        out.append((d, fold(d) == 1, best[1], max(0.0, best[0])))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[3])


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_brute_force(spark):
    rng = random.Random(3)
    syllables = {"aa": ["to", "The", "ing", "ed ", "an"], "bb": ["schö", "ei", "ung ", "ß", "zu"], "cc": ["é", "que ", "À", "ou", "la "]}
    rows = [(i, "".join(rng.choice(syllables[k] + [" ", "\n", "7", ". "]) for _ in range(rng.randint(0, 60))), k) for i, k in enumerate(rng.choices(list(syllables), k=90))]
    rows += [(None, "to the ing", "aa"), (None, None, None), (5, "to the ing", None), (200, "", "bb"), (201, "123 !?", "cc"), (202, None, "aa"), rows[3], rows[3]]
    rows += [(300, "Привет мир 你好 \x00 İstanbul", None), (301, "一二三四" * 9, "zz"), (302, "zu ung ei " * 30 + "that", "bb")]
    df = table(spark, rows).selectExpr("*", "'x' AS row", "0 AS score", "false AS held_out")
    same(languages.predict(df).collect(), brute(rows))


def test_very_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abc éÀ.\n ") for _ in range(5000))
    want = bundle(text)
    for part in (1, 2, 3, 7, 1000, 1 << 20):
        monkeypatch.setattr(languages, "PART", part)
        np.testing.assert_array_equal(languages.bundles(languages.Trigrams(), [text, "", text[:50]], np.array([0, 1, 2]), 3), [want, want * 0, bundle(text[:50])])
    monkeypatch.undo()
    monkeypatch.setattr(languages, "WIDTH", 8)
    monkeypatch.setattr(languages, "KNOWN", 60)
    np.testing.assert_array_equal(languages.bundles(languages.Trigrams(), [text], np.array([0]), 1), [want])
    long = "ing the to " * 300_000
    monkeypatch.undo()
    a, b, c = [d for d in range(20, 40) if fold(d) != 1][:3]
    rows = [(a, long, "aa"), (b, "schön zu der ung", "bb"), (c, None, "bb"), (50, "thing", "aa"), (51, "schö der zu", "aa"), (52, long + "zu der", None)]
    same(languages.predict(table(spark, rows)).collect(), brute(rows))


def test_nothing_to_learn(spark):
    same(languages.predict(table(spark, [(1, "the", None), (2, None, "aa")])).collect(), [(1, fold(1) == 1, "und", 0.0), (2, fold(2) == 1, "und", 0.0)])
    assert languages.predict(table(spark, [])).collect() == []


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        languages.predict(table(spark, [(i, "the", f"l{i}") for i in range(9)]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op11_hyperdimensional_languages"](spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 200
