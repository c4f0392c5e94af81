"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from ledgergraph.llm import spelling

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(rows, length=6, count=5, ratio=5):
    words = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPS)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % spelling.SLIP == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= length and n >= count}
    forms, near = {}, {}
    for w in words:
        close = sorted((-words[x], x) for x in words if one_edit(w, x))
        near[w] = len(close)
        forms[w] = close[0][1] if close and -close[0][0] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n, near[w], forms[w], words.get(forms[w]), root))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "0 AS key", "1 AS n", "'y' AS run")
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, **kw).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, **kw)
    return got


def test_chains_and_ties(spark):
    words = {"wonderful": 700, "wondrful": 130, "wonderfull": 130, "wondrfl": 24, "wondrfll": 5, "aaaaaa": 40, "aaaaaaa": 200, "aaaaaaaa": 6, "straße": 30, "Strasse": 6, "straÿe": 6, "MÄrchen": 9, "märchen": 9}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    got = check(spark, [(1, text), (None, "wonderful " * 9 + "Wonderful×2"), (3, None), (4, ""), (5, "a b c 12 ..")])
    root = {w: r for w, _, _, _, _, r in got}
    assert root["wondrfll"] == "wonderful" and len(root) >= 11


def test_random_words(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(150)] + ["xyz" * k for k in range(2, 9)]

    def typo(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w, w[:i] + rng.choice("abÉx") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("abx") + w[i + 1:]])

    rows = [(rng.choice([None, *range(60)]), " ".join(typo(rng.choices(base, weights=range(1, len(base) + 1))[0]) for _ in range(rng.randint(0, 200)))) for _ in range(60)]
    rows += [rows[0]] * 5
    check(spark, rows, count=2, ratio=2)
    assert len(check(spark, rows)) > 100


def test_very_long_text_and_word(spark):
    long = "k" * 70_000
    rows = [(1, " ".join([long] * 5 + [long + "z"] * 30)), (2, "common words " * 100_000), (3, "commmon " * 7)]
    got = {w: r for w, _, _, _, _, r in check(spark, rows)}
    assert got[long] == long + "z" and got["commmon"] == "common"


def test_empty(spark):
    assert check(spark, []) == [] and check(spark, [(1, None), (2, "")]) == []


def test_slips(spark):
    """Many documents, so that the hash drops code points of some runs, the first and the last among them."""
    rows = [(i, "hashing letters straight away, Überläufe") for i in range(4000)]
    got = check(spark, rows, count=1)
    assert len(got) > 4
