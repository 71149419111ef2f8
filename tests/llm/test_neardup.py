import random

import numpy as np
import pytest

from palimpsest.llm import neardup as N


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, n = [], 100
    for group in range(4):
        base = [word() for _ in range(120)]
        for _ in range(70):
            text = list(base)
            for _ in range(rng.randint(1, 7)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [word()]
            rows.append((n, " ".join(text)))
            n += rng.randint(1, 3)
    rows += [(n + k, rows[k % 9][1].upper() + " \n") for k in range(30)]
    rows += [(n + 100 + k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "x"), (8, "x " * 9000), (9, "X " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_against_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, shingle=4, block=block).collect()}
    assert out == brute(rows, 4, 80)


def test_filter_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (2, "A b c d e f", 1), (None, "z", 2), (3, None, 3), (3, None, 3)], "doc_id long, text string, rep int")
    assert sorted((r["doc_id"] or 0, r["rep"]) for r in N.without_near_duplicates(docs).collect()) == [(0, 2), (1, 0), (3, 3)]
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_an_id_on_different_texts_has_the_links_of_all(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    near = lambda t: t.rsplit(" ", 3)[0] + " q r s"
    rows, want = [], {}
    for i in range(12):  # id 100 + i stands on two texts, each with a near copy and one with a full copy
        x, y, base = text(), text(), 100 + i
        rows += [(base, x), (base, y), (200 + i, near(x)), (300 + i, near(y)), (400 + i, y), (50 + i, text())]
        want |= dict.fromkeys((base, 200 + i, 300 + i, 400 + i), base) | {50 + i: 50 + i}
    rows += [(7, rows[0][1]), (None, "a b")]  # a full copy with a lesser id than the clashing one
    want |= dict.fromkeys((7, 100, 200, 300, 400), 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = N.near_duplicates(docs).collect()
    assert len(out) == len(rows) and {(r["doc_id"], r["component_id"]) for r in out} == {*want.items(), (None, None)}
    assert all(r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in out)
    assert {r["class_id"] for r in out if r["doc_id"] == 411} == {111}
    left = [r["doc_id"] for r in N.without_near_duplicates(docs).collect()]
    assert sorted(left, key=str) == sorted([None, *{*want.values()}], key=str)


def test_estimate():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    x, y = N.pack(N.minima(a)), N.pack(N.minima(b))
    assert abs(float(N.estimate(N.unequal_values(x ^ y))) - 900 / 1100) < 0.15
    assert N.unequal_values(x ^ x) == 0


def test_shingles_are_those_of_the_words():
    assert len(N.shingle_set(b"a b c d a b c d")) == 4 and len(N.shingle_set(b"one two")) == 1 and not len(N.shingle_set(None))
    assert np.array_equal(N.shingle_set("É x\ty z w".encode()), N.shingle_set("É  X y\nZ w ".encode()))
