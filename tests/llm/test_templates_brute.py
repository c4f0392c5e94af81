"""Template decontamination against a plain version that goes through all documents, items and windows."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import regex

from ledgergraph.llm import stages, templates

NUMBER = re.compile(r"[0-9]+([.,:/][0-9]+)*(st|nd|rd|th|%|[a-z]{1,3})?")
NAME = regex.compile(r"\p{Lu}[\p{Ll}'’-]+")
L, N, U, P = templates.LITERAL, templates.NUMBER, templates.UNIT, templates.NAME


def tokens(text):
    """(word, kind, unsure) of each token."""
    out, first, number = [], True, False
    for line_no, line in enumerate(re.split("[\n\x0b\x0c\r\u0085  ]+", text or "")):
        for i, raw in enumerate(re.findall(r"[^\x20\x09-\x0D]+", line)):
            core = raw.strip(templates.TRIMMED)
            word = core.lower()
            starts = first or (i == 0 and line_no > 0)
            named = bool(NAME.fullmatch(core))
            kind = P if named and not starts else L
            if NUMBER.fullmatch(word) or word in templates.NUMBER_WORDS:
                kind = N
            if word in templates.UNITS and number:
                kind = U
            first, number = bool(re.search(r"[.!?:][\"')”’]*$", raw)), kind == N
            if core:
                out.append((word, kind, named and starts and kind == L))
    return out


def windows(t, size, exact):
    """place, key, slots of every window, once for each reading."""
    for at in range(len(t) - size + 1):
        part = t[at:at + size]
        if exact:
            yield at, ("exact", *(w for w, _, _ in part)), (None,) * size, True
            continue
        literals = sum(k == L for _, k, _ in part)
        unsure = [i for i, x in enumerate(part) if x[2]]
        for n in range(len(unsure) + 1):
            for named in combinations(unsure, n):
                if (literals - n) * templates.WINDOW >= templates.LITERALS * size:
                    kinds = [P if i in named else k for i, (_, k, _) in enumerate(part)]
                    yield at, tuple(w if k == L else k for (w, _, _), k in zip(part, kinds, strict=True)), tuple(w if k != L else None for (w, _, _), k in zip(part, kinds, strict=True)), not n


def brute(docs, items):
    out = []
    for item_id, text in items:
        t = tokens(text)
        size = min(len(t), templates.WINDOW)
        mine = list(windows(t, size, False)) if size >= templates.SHORTEST else []
        exact = not mine
        if exact:
            mine = list(windows(t, size, True)) if size else []
        if not mine:
            continue
        count = sum(plain for *_, plain in mine)
        for doc_id, doc in docs:
            d = tokens(doc)
            by_key = defaultdict(list)
            for place, key, values, _ in windows(d, size, exact) if len(d) >= size else ():
                by_key[key].append((place, values))
            runs = defaultdict(lambda: (set(), set()))
            for at, key, slots, _ in mine:
                for place, values in by_key[key]:
                    ats, pairs = runs[place - at]
                    ats.add(at)
                    pairs |= {(at + i, o, v) for i, (o, v) in enumerate(zip(slots, values, strict=True)) if o is not None}
            covered, slots, agree, changed = set(), 0, 0, 0
            for ats, pairs in runs.values():
                n = Counter((o, v) for _, o, v in pairs)
                forth = {o: min((-c, v) for (p, v), c in n.items() if p == o)[1] for o, _ in n}
                back = {v: min((-c, o) for (o, p), c in n.items() if p == v)[1] for _, v in n}
                good = sum(c for (o, v), c in n.items() if forth[o] == v and back[v] == o)
                if good >= templates.AGREEMENT * sum(n.values()) or not n:
                    covered |= ats
                    slots, agree, changed = slots + sum(n.values()), agree + good, changed + sum(o != v for o, v in n)
            if covered and len(covered) >= templates.SHARE * count:
                out.append((doc_id, item_id, round(len(covered) / count, 9), slots, round(agree / slots if slots else 1.0, 9), not changed))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    plain = ["the", "train", "leaves", "at", "and", "arrives", "how", "many", "apples", "does", "have", "left", "after", "of"]
    special = ["Tom", "Sara", "3", "17", "two", "km", "hours", "Paris.", "What", "If", "5%", "1,250", "—", "kg?", "\n"]

    def item():
        return " ".join(rng.choice(plain if rng.random() < 0.72 else special) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])))

    items = [(i, item()) for i in range(40)] + [(40, None), (41, "— !"), (3, "What is 17 times 24?"), (None, "Compute 12 + 7 * 3 - 4")]

    def changed(text):
        return " ".join(rng.choice(special[:9]) if rng.random() < 0.1 else w for w in (text or "").split(" "))

    docs = [(i, " ".join([item(), rng.choice([lambda t: t or "", changed])(rng.choice(items)[1]), item()])) for i in range(60)]
    return docs + [(100, None), (101, ""), (None, items[5][1]), docs[3], (102, "word " * 3000 + (items[8][1] or ""))], items


def test_against_all_windows(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item long, hash string")
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, row long")
    got = [(r.doc_id, r.item_id, round(r.share, 9), r.slots, round(r.agreement, 9), r.verbatim) for r in templates.leaked_items(df, table).collect()]
    want = brute(docs, items)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 60 and {w[5] for w in want} == {True, False}


def test_stage_leaves_documents_with_very_short_items(spark, tmp_path):
    """An item of a word or two stands in clean documents too, so only longer ones make a document go."""
    docs = spark.createDataFrame([(1, "some yes and no here"), (2, "before What is the capital of France? after"), (3, None)], "doc_id long, text string")
    spark.createDataFrame([(1, "yes"), (2, "some yes and"), (3, "What is the capital of France?"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in stages.decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()) == [1, 3]
