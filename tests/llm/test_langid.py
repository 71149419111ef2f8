import random

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import langid as L


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abcd ", max_size=15))
def test_automaton_against_search(text, query):
    a = L.SuffixAutomaton(text)
    for at in range(len(query)):
        n = max((k for k in range(len(query) - at + 1) if query[at : at + k] in text), default=0)
        got, seen = a.longest(query, at)
        assert got == n
        if n:
            assert seen == sum(text.startswith(query[at : at + n], i) for i in range(len(text)))
    at = phrases = 0
    while at < len(query):
        at += max(1, a.longest(query, at)[0])
        phrases += 1
    if query:
        assert a.parse(query)[0] == a._parse_long(query)[0] == phrases and abs(a.parse(query)[1] - a._parse_long(query)[1]) < 1e-9


def test_learnt_languages(spark):
    rng = random.Random(1)
    words = {"en": ["the", "thing", "with", "house"], "de": ["der", "straße", "und", "haus"], "fr": ["été", "le", "avec", "maison"]}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(list(words) * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", "de"), (902, "the thing", None), (None, "der und", "de"), (903, "x" * 5000, None)], "doc_id long, text string, lang string")
    texts = L.fit(docs)
    assert sorted(texts) == ["de", "en", "fr"]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict_language(docs, texts).collect()}
    assert all(out[i][0] == x for i, _, x in rows) and out[900] == ("und", 0.0) == out[901] and out[902][0] == "en" and out[None][0] == "de"
    assert all(0 <= s <= 1 for _, s in out.values())
    assert L.predict_language(docs.limit(0), {}).collect() == []
    assert {r["lang_pred"] for r in L.predict_language(docs, {}).collect()} == {"und"}


def test_numbers_and_marks_are_no_letters(spark):
    texts = {"de": " der und ", "en": " the and "}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²", "①Ⅷ ٣ 12", "_ -- \u0301", "½the", "ª", "日本"])], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict_language(docs, texts).collect()}
    assert [out[i] for i in range(3)] == [("und", 0.0)] * 3
    assert out[3][0] == "en" and out[4][0] != "und" and out[5][0] != "und"


def test_what_is_learnt_is_bounded(spark):
    docs = spark.createDataFrame([(1, "ab " * 50_000, "x"), (1, "cd " * 10, "x"), (2, "ef " * 50_000, "x")], "doc_id long, text string, lang string")
    texts = L.fit(docs, chars=1000)
    assert len(texts["x"]) <= 1000 and set(texts) == {"x"}


def test_prediction_against_single_parses(spark):
    """The query's phrase counts are those of the longest matches, letter by letter."""
    rng = random.Random(6)
    texts = {x: " " + " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)) + " " for x, letters in (("a", "abcde"), ("b", "cdefg"), ("c", "aceg"))}

    def phrases(text, word):
        at = n = 0
        while at < len(word):
            at += max([k for k in range(1, len(word) - at + 1) if word[at : at + k] in text], default=1)
            n += 1
        return n

    some = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in L.predict_language(docs, texts).collect():
        counts = {x: sum(phrases(t, f" {w} ") for w in some[r["doc_id"]].split()) for x, t in texts.items()}
        assert counts[r["lang_pred"]] == min(counts.values())
