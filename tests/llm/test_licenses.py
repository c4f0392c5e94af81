"""The license scan against brute force over all blocks and templates."""

import math
import random
import re

import pytest

from ledgergraph.llm import licenses

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(licenses.WORD, (text or "").translate(CAPS))
    places = {p: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    starts = sum(places.values(), [])
    base = sorted({licenses.PHRASES[p] for p, x in places.items() if x})
    labels, best = set(base), 0.0
    for label, t in licenses.TEMPLATES:
        s, size = set(licenses.words_in(t)), 16
        while size < len(licenses.words_in(t)):
            size *= 2
        for i in range(0, len(w), size):
            n = len(set(w[i:i + 2 * size]) & s)
            if n >= (len(s) if len(s) < 10 else math.ceil(0.8 * len(s) - 1e-9)):
                labels.add(label)
                best = max(best, n / len(s))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)),
            1.0 if base else best)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    common = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_in(t)})
    out = [(1, None), (2, ""), (3, "CC BY cc-by cc_by"), (4, "all rights reserved, ALL RIGHTS RESERVED all rights"), (4, "all rights reserved, ALL RIGHTS RESERVED all rights"),
           (None, "GNU General Public License"), (5, "general\npublic  license 2 general public licenses"), (6, "éall rights reserved"), (7, "Kelvin K cc İ by"),
           (8, "x " * 9000 + "Released under the MIT License. " + "y " * 9000), (9, "cc"), (10, "!!! ...")]
    for i in range(100, 260):
        w = rng.choices(common + ["filler", "Wort", "é"], k=rng.choice([3, 30, 200]))
        for _ in range(rng.randrange(3)):
            t = licenses.words_in(rng.choice(licenses.TEMPLATES)[1])
            at = rng.randrange(len(w))
            w[at:at] = [x for x in t if rng.random() > rng.choice([0, 0.1, 0.3])]
        out.append((i, " ".join(w)))
    return out


def test_scan(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x", 0.0) for d in docs], "doc_id long, text string, row long, labels string, score double")
    got = sorted(map(repr, (tuple(r) for r in licenses.scan(df).collect())))
    assert got == sorted(repr((d, *brute(t))) for d, t in docs)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_beyond_the_tables(spark):
    """Passages as they stand in files, changed a little, and short notices that differ in one word."""
    text = dict(zip(["mit", "warranty", "apache", "bsd", "agpl"], [licenses.TEMPLATES[i][1] for i in (3, 5, 7, 10, 17)]))
    notice = "Copyright 2021 A. Person\n\n# " + text["mit"].replace(", ", ",\n# ") + "\n#\n# " + text["warranty"]
    rows = [(1, notice, "mit"), (2, "Released under the BSD License.", "bsd"), (3, "Licensed under CC BY 4.0.", "cc-by"),
            (4, "x " * 500 + text["apache"].replace("you may", "users may") + " y" * 500, "apache-2.0"), (5, text["bsd"] + " But no more.", "bsd"),
            (6, "This work is licensed under the GNU General Public License, version 2.0.", "gpl"), (7, text["agpl"], "agpl"),
            (8, "the software is provided with a warranty of any kind", ""), (9, "Released under the new License.", "")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {d: label in got[d].split(",") if label else got[d] == "" for d, _, label in rows} == dict.fromkeys(got, True)
    assert got[2] == "bsd" and got[3] == "cc-by" and got[6] == "gpl" and "apache-2.0" not in got[6]


def test_template_of_any_length(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10_000)}" for _ in range(700))
    df = spark.createDataFrame([(1, "a " * 333 + long + " b" * 50), (2, " ".join(long.split()[:300]))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df, [("own", long), ("none", "...")]).collect()}
    assert got == {1: "own", 2: ""}
