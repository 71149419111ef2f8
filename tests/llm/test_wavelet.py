import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import wavelet as V
from palimpsest.llm.queries import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500))
def test_matrix_answers_like_a_list(ids):
    m = V.WaveletMatrix.build(np.array(ids, np.uint32), 6)
    assert m.ids().tolist() == ids
    for v in {0, 7, 40, *ids[:5]}:
        where = [i for i, x in enumerate(ids) if x == v]
        assert m.count(v) == len(where) and m.occurrences(v)[:20] == where[:20]
        assert m.count(v, len(ids) // 3, len(ids)) == sum(i >= len(ids) // 3 for i in where)
    assert [m.access(i) for i in range(0, len(ids), 97)] == ids[::97]


def test_select_beyond_the_last_occurrence():
    with pytest.raises(IndexError):
        V.WaveletMatrix.build(np.array([3, 5, 3]), 3).select(3, 2)


TEXTS = [
    None, "", " ", "Hello, World! it's we'll DON'T", "naïve Élan ΣΑΣ Straße ÀÉ×÷ÿ", "a\tb c　d\x1ce", "<|endoftext|> x<|startoftext|>y",
    "é É Å ﬁ ²½ ١٢ 日本語 12345", "word... (see: [x]) a--b 'quoted' '", "Word%%% THE!! a|b *** $$$ don't's",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBé'.s,t \n1ΣßÀ!|<>", max_size=30), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    e = V.Encoder(tokenizer_path(), 1, most=50)
    t = V._tokenizer(tokenizer_path())
    for some in (texts, TEXTS, texts):
        ids, lengths = e.encode(pa.array(some, pa.string()))
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in some]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_wide_ids_round_trip():
    ids = np.array([0, 70_000, 1, 70_000, 131_071])
    assert V.join_planes(V.part_planes(ids, 17), 5).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        V.load(b"nothing")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=3000), st.integers(0, 9))
def test_a_payload_answers_like_its_list(ids, value):
    lengths = np.array([len(ids)])
    shard = V.load(V.write_shard(np.array([4]), lengths, np.array(ids, np.uint16), 4))
    assert shard.ids().tolist() == ids and shard.count(value) == ids.count(value)
    at = np.arange(0, len(ids) + 1, 7)
    assert shard.ranks(value, at).tolist() == [ids[:i].count(value) for i in at]
    assert [shard.access(i) for i in range(0, len(ids), 311)] == ids[::311]
    assert shard.occurrences(value)[:9] == [i for i, x in enumerate(ids) if x == value][:9]


def test_access_inflates_few_pieces():
    ids = np.random.default_rng(1).integers(0, 49_000, 2_000_000)
    shard = V.load(V.write_shard(np.array([1]), np.array([len(ids)]), ids, 16))
    assert shard.access(1_234_567) == ids[1_234_567] and len(shard._open) <= 2 * 16
    value = int(ids[77])
    assert shard.count(value) == int((ids == value).sum()) and shard.select(value, 1) == np.flatnonzero(ids == value)[1]
    assert len(shard._open) <= 8 * 16


def test_the_memory_of_pieces_is_emptied():
    known = V._Known(lambda texts: [x.encode() for x in texts], most=10)
    for k in range(9):
        some = [f"{k}-{i}" for i in range(8)] + ["always", "ß"]
        assert known.ids(some) == [x.encode() for x in some] and len(known) <= 20


def test_table_from_files(spark, tmp_path):
    rows = [(5, "one two"), (3, None), (None, "three"), (5, "one two"), (9, "x " * 5000), (4, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    out = V.token_table(docs, tokenizer_path(), path=str(tmp_path / "shards"), shard_tokens=50, partitions=3)
    t = V._tokenizer(tokenizer_path())
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), int((ids == 1).sum())))
        start += len(ids)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    shards = spark.read.parquet(str(tmp_path / "shards")).orderBy("part", "seq").collect()
    assert len(shards) > 2
    m = V.load(bytes(shards[-1]["payload"]))
    assert m.count(1) == shards[-1]["n_docs"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert V.token_table(docs, tokenizer_path()).collect() == []


def test_short_pieces_are_looked_up_without_digests(monkeypatch):
    calls = []
    digest = V.xxhash.xxh3_128_digest
    monkeypatch.setattr(V.xxhash, "xxh3_128_digest", lambda x: calls.append(x) or digest(x))
    e = V.Encoder(tokenizer_path(), 1)
    e.encode(pa.array(["short words alone, é and all of them", None]))
    assert not calls and len(e.pieces) == 9  # eight pieces and the empty one


def test_texts_that_look_alike_are_known_apart():
    known = V._Known(lambda texts: [x.encode() for x in texts], most=100_000)
    some = ["", "\x00", "\x00\x00", "a", "a\x00", "a" * 8, "a" * 9, "a" * 15, "a" * 16, "a" * 15 + "b", "a" * 15 + "\x00", "é" * 7, "é" * 8]
    some += [f"{i:x}" for i in range(0x1000, 0x6000)]
    for part in (some[::2], some, some[::-1]):
        assert known.ids(part) == [x.encode() for x in part]
    assert len(known) == len(some)
