import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import syncmers as S


def naive(points, k=S.K, s=S.S):
    """Syncmers one k-mer at a time, by hashing each run alone."""
    value = lambda run: S.mix64(S._windows(run.astype(np.uint64) + S._START, len(run)))[0]
    at = []
    for i in range(len(points) - k + 1):
        small = [value(points[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(small) in (small[0], small[-1]):
            at.append(i)
    return at


@settings(max_examples=40, deadline=None)
@given(st.text("abcdé😀 ", max_size=80))
def test_syncmers_against_single_kmers(text):
    points = S.code_points(text)
    assert S.syncmers(points)[0].tolist() == naive(points)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdefghijklmnop é", max_size=120), min_size=2, max_size=2))
def test_edited_fingerprint_is_that_of_the_edited_text(texts):
    a, b = (S._Doc(0, t) for t in texts)
    text, edited = a.edited(b)
    n = len(texts[0])
    assert text == texts[0][: n - n // 3] + texts[1][: n // 3]
    assert S.to_text(edited) == S.to_text(S.bottom(S.anchors(S.code_points(text))))


def test_short_texts_are_told_apart():
    """Lengths at which a text may have no syncmer, against single k-mers."""
    rng, seen = random.Random(8), {}
    for _ in range(600):
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(14, 24)))
        points = S.code_points(text)
        print_ = S.to_text(S.bottom(S.anchors(points)))
        at = naive(points)
        if not at:
            assert print_ == hashlib.blake2b(points.tobytes(), digest_size=4).hexdigest()
        assert print_ and len(S.anchors(points)) == max(1, len(at)) and seen.setdefault(print_, text) == text
        assert S.to_text(S._Doc(0, text).print) == print_
    a, b = S._Doc(0, "abcdefghijklmnopqrstuvwxyz0123456789"), S._Doc(1, "q" * 40)
    assert len(a.edited(b)[1])


def test_likeness():
    e, x = S.from_text(""), S.bottom(S.anchors(S.code_points("some text that is long enough to have anchors " * 3)))
    assert S.likeness(e, e) == 1 and S.likeness(e, x) == 0 and S.likeness(x, x) == 1
    assert np.array_equal(S.from_text(S.to_text(x)), x)


def test_table(spark):
    rng = random.Random(4)
    rows = [(i * 3, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 5, 15, 16, 40, 300])))) for i in range(40)]
    rows += [(500, None), (501, "x" * 9000), (501, "x" * 9000), (None, "no id at all, but a text")]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, part string")
    out = [tuple(r) for r in S.edited_fingerprints(docs, partitions=7).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    order = [(i, t or "") for i, t in order]
    want = []
    for n, (i, t) in enumerate(order):
        u = order[(n + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        f, g, h = (S.bottom(S.anchors(S.code_points(x))) for x in (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), S.to_text(f), S.to_text(g), S.likeness(f, g), S.likeness(f, h)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(out, key=key) == sorted(want, key=key)
    assert S.edited_fingerprints(docs.limit(0)).collect() == []
    plain = {tuple(r) for r in S.fingerprints(docs).collect()}
    assert plain == {(w[0], w[1], w[3]) for w in want}
    assert S.positions(docs).count() > 20
