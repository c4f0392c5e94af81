"""Sharding, exact dedup and packed ids against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgergraph.llm import binary, quotient, sharding

SCHEMA = "doc_id long, text string, lang string, fp long, row long, kept boolean, block int"
AWKWARD = [(1, "a b"), (2, None), (3, ""), (None, "x"), (None, "a b"), (7, "a b"), (7, "a b"), (9, "wört " * 3000), (-5, "it's 12"),
           (2**62, "x"), (11, "tie"), (11, "other")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, None, 1, 2, True, 3) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump(spark, awkward, empty):
    keys = [*range(2000), -1, -5, 2**63 - 1, -2**63, 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24):
        got = {r[0]: (r[1], r[2]) for r in df.select("k", sharding.jump(df["k"], n)["shard"], sharding.jump(df["k"], n)["grown"]).collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}
    rows = sharding.shard_documents(awkward, 3).collect()
    assert len(rows) == len(AWKWARD)
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 3) and r.grown_shard in (r.shard, 3)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in AWKWARD)
    assert sharding.shard_documents(empty).count() == 0


def test_exact_duplicates(spark, awkward, empty):
    rows = quotient.exact_duplicates(awkward).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    want = defaultdict(list)
    for d, t in AWKWARD:
        want[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
    assert {k: sorted(map(str, v)) for k, v in want.items()} == {k: sorted(str(r.doc_id) for r in v) for k, v in groups.items()}
    for k, v in groups.items():
        ids = [d for d in want[k] if d is not None]
        assert all(r.group_size == len(v) and r.keep_id == (max(ids) if ids else None) for r in v)
        kept = [r for r in v if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    assert quotient.exact_duplicates(empty).count() == 0


def test_texts_dealt_out_instead_of_broadcast(awkward, monkeypatch):
    plain = sorted(map(str, quotient.exact_duplicates(awkward).collect()))
    monkeypatch.setattr(quotient, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(quotient, "ROWS_PER_FILTER", 2)
    assert sorted(map(str, quotient.exact_duplicates(awkward).collect())) == plain


@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=4), st.integers(1, 9))
def test_filters_lose_nothing(lists, block_bits):
    block = {int(x) >> (64 - block_bits) for x in lists[0]}.pop()
    lists = [[x & ((1 << (64 - block_bits)) - 1) | block << (64 - block_bits) for x in part] for part in lists]
    made = []
    for part in lists:
        fps, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        f = quotient.QuotientFilter.from_bytes(quotient.QuotientFilter(block, block_bits, fps, counts).to_bytes())
        assert f.fingerprints().tolist() == fps.tolist() and f.counts.tolist() == counts.tolist()
        made.append(f)
    fps, counts = np.unique(np.array(sum(lists, []), np.uint64), return_counts=True)
    one = quotient.QuotientFilter.merged(made)
    assert one.fingerprints().tolist() == fps.tolist() and one.counts.tolist() == counts.tolist()


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_packing_of_bits(width, ids):
    ids = np.array(ids, np.uint32) & np.uint32((1 << width) - 1)
    data = binary.pack(ids, width)
    assert len(data) == (len(ids) * width + 7) // 8 and binary.unpack(data, width, len(ids)).tolist() == ids.tolist()


def tokens(text):
    from tokenizers import Tokenizer

    from ledgergraph.llm.tokens import default_path
    global _tokenizer
    _tokenizer = globals().get("_tokenizer") or Tokenizer.from_file(default_path())
    return _tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(spark):
    import pyarrow as pa

    from ledgergraph.llm.tokens import default_path, encoder
    texts = ["", "  ", "It's a <|endoftext|> test<|ENDOFTEXT|> don't", "café café İX 12,345.67kg $5!! a b  z",
             "ΣΑΣ ΣΑΣ. naïve—dash", "x" * 300, "\t\n lead \n", " … a…b .…", "日本 123abc ٣٤", "e̸= ̸",
             "é, ñ. É!! a\x00b 하"]
    ids, ends = encoder(default_path()).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tokens(t) for t in texts]


def signed(text):
    import xxhash
    return (xxhash.xxh64_intdigest(text, 42) + 2**63) % 2**64 - 2**63


def test_files_of_ids(awkward, empty, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK", 64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary.round_trip(awkward).collect())
    want, start = [], 0
    for d, t in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or ""))):
        ids = tokens(t) + [1]
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert binary.round_trip(empty).count() == 0


def test_random_access(tmp_path):
    from pyarrow import fs
    rng = np.random.default_rng(5)
    for width in (7, 16, 17):
        ids = rng.integers(0, 1 << width, 200_000).astype(np.uint32)
        lengths = np.array([0, 1, 70_000, 129_999])
        system, base = binary.open_folder(f"file://{tmp_path}")
        w = binary.Writer(system.open_output_stream(f"{base}/f{width}"), width)
        w.add(np.arange(2), lengths[:2], ids[:1])
        w.add(np.arange(2, 4), lengths[2:], ids[1:200_000])
        w.close()
        with fs.LocalFileSystem().open_input_file(f"{base}/f{width}") as source:
            r = binary.Reader(source)
            assert r.slice(65_530, 131_100).tolist() == ids[65_530:131_100].tolist()
            assert r.document(2).tolist() == ids[1:70_001].tolist() and len(r.document(0)) == 0
