import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import toxicity as T


def sparse(vectors):
    """Dictionaries as rows of (starts, terms, weights)."""
    starts = np.cumsum([0, *map(len, vectors)])
    return starts, np.array([t for v in vectors for t in v], np.int64), np.array([x for v in vectors for x in v.values()])


VECTORS = st.lists(st.dictionaries(st.integers(0, 6), st.floats(0.1, 3), max_size=4), max_size=60)


@settings(max_examples=80, deadline=None)
@given(VECTORS, VECTORS, st.integers(1, 9), st.sampled_from([0.0, 0.3, 2.0]), st.booleans())
def test_block_max_finds_the_nearest(vectors, queries, k, frequent, leave):
    def unit(v):
        n = sum(x * x for x in v.values()) ** 0.5
        return {t: x / n for t, x in v.items()}

    vectors, queries = [unit(v) for v in vectors], [unit(v) for v in queries]
    but = np.arange(len(queries)) % max(1, len(vectors)) if leave and vectors else None
    who, cos = T.BlockMaxIndex(sparse(vectors), 7, block=4, frequent=frequent).nearest(sparse(queries), k, but)
    for i, query in enumerate(queries):
        every = [round(sum(x * v.get(t, 0) for t, x in query.items()), 12) for v in vectors]
        want = sorted((j for j, c in enumerate(every) if c > 0 and (but is None or j != but[i])), key=lambda j: (-every[j], j))[:k]
        got = [j for j in who[i].tolist() if j >= 0]
        assert len(got) == len(want) and np.allclose(cos[i, : len(want)], [every[j] for j in want], atol=1e-9)
        assert all(abs(every[x] - every[y]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_blocks_below_the_bound_stay_closed():
    """Examples of a strong term are found without opening those of others."""
    rng = np.random.default_rng(2)
    vectors = [{i // 100: 0.98, 100 + int(rng.integers(50)): 0.2} for i in range(2000)]
    index = T.BlockMaxIndex(sparse(vectors), 150, block=50, frequent=2.0)
    read = []
    whole = T._spread
    T._spread = lambda starts, sizes: (read.append(int(sizes.sum())), whole(starts, sizes))[1]
    try:
        who, _ = index.nearest(sparse([{7: 0.99, **{100 + i: 0.01 for i in range(50)}}]), 31)
    finally:
        T._spread = whole
    assert set(who[0] // 100) == {7} and sum(read[1:]) < 400  # of 2,100 postings


def rows(n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioubdfg") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        bad = i % 6 == 0
        out.append((i, " ".join(rng.choices(words, k=rng.randint(5, 80)) + ["zorkish", "zorking"][: 1 + i % 2] * bad), int(bad)))
    return out


def test_scores(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in data] + [(900, None, 1.0), (901, "", 1.0), (None, "zorkish one", 1.0), (902, "x " * 50_000, 1.0), (902, "x " * 50_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in data if i % 5] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = T.fit(docs, labels)
    assert len(model.ids) == sum(i % 5 > 0 for i, _, _ in data)
    out = {(r["doc_id"]): (r["score"], r["predicted"], r["neighbours"]) for r in T.score_toxicity(docs, model).collect()}
    held = [(i, x) for i, _, x in data if i % 5 == 0]
    assert np.mean([out[i][1] == x for i, x in held]) > 0.97
    assert out[900][0] == out[901][0] == model.share and out[None][1] == 1 and out[902][1] == 0 and all(0 <= s <= 1 for s, _, _ in out.values())
    near = out[0][2]
    assert near[0]["label"] == 1 and near[0]["cosine"] >= near[-1]["cosine"]


def test_no_examples_and_one_label(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score_toxicity(docs, T.fit(docs, none)).first()["score"] == 0.0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert T.score_toxicity(docs, T.fit(docs, one)).first()["score"] > 0.5
    assert T.score_toxicity(docs.limit(0), T.fit(docs, none)).collect() == []


def test_scores_against_brute_force(spark):
    """Every term of every example counts; votes and scores are those of all cosines."""
    data = rows(240)
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in data], (900, "qqq"), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 5], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    learnt = {i: (T.terms(t), y) for i, t, y in data if i % 5}
    n, pos = len(learnt), sum(y for _, y in learnt.values())
    assert set(model.vocabulary) == {t for x, _ in learnt.values() for t in x}

    def ratio(a, b):
        out, p = 0.0, (a + b) / n
        for seen, size in ((a, pos), (b, n - pos)):
            out += sum(2 * k * np.log(k / (size * q)) for k, q in ((seen, p), (size - seen, 1 - p)) if k and q)
        return max(0.0, out)

    factor = {}
    for t in model.vocabulary:
        a, b = (sum(t in x for x, y in learnt.values() if y == label) for label in (1, 0))
        r = ratio(a, b)
        factor[t] = np.log(1 + n / (1 + a + b)) * max(0.02, (r / (r + 15)) ** 2)

    def vector(counts):
        v = {t: (1 + np.log(k)) * factor[t] for t, k in counts.items() if t in factor}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(x) for i, (x, _) in learnt.items()}
    out = {r["doc_id"]: r for r in T.score_toxicity(docs, model, evidence=31).collect()}
    for i, t, _ in data[::7]:
        q = vector(T.terms(t))
        near = sorted(((-round(sum(x * v.get(u, 0) for u, x in q.items()), 12), j) for j, v in vectors.items()))
        near = [(-c, j) for c, j in near if c < 0]
        got = [(x["cosine"], x["doc_id"]) for x in out[i]["neighbours"]]
        assert len(got) == min(31, len(near)) and np.allclose([c for c, _ in got], [c for c, _ in near[:31]], atol=1e-9)
        w = [(c**4, learnt[j][1]) for c, j in got]
        vote = (sum(x * y for x, y in w) + 0.1 * model.share) / (sum(x for x, _ in w) + 0.1)
        vote = min(1 - 1e-4, max(1e-4, vote))
        assert abs(out[i]["score"] - 1 / (1 + np.exp(-(model.slope * np.log(vote / (1 - vote)) + model.shift)))) < 1e-9
    assert out[900]["score"] == out[901]["score"] == model.share
    assert len({r["score"] for i, r in out.items() if i < 900}) > 200  # no constant for texts that share terms


def test_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "bad worse", 0, "x"), (1, "other", 1, "y"), (2, "fine day", 0, "z")], "doc_id long, text string, label int, terms string")
    labels = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (2, 0, 7)], "doc_id long, toxic int, __h int")
    model = T.fit(docs, labels)
    assert len(model.ids) == 2 and T.score_toxicity(docs, model).count() == 3
