"""Quality, mixing, url filters, decontamination and html on small tables, against plain versions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import decontaminate as D
from palimpsest.llm import extract_html as H
from palimpsest.llm import mixing as M
from palimpsest.llm import quality as Q
from palimpsest.llm import url_reputation as U
from palimpsest.llm.queries import RULES


# --- quality ------------------------------------------------------------------------------------
def quality_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    out = []
    for i in range(300):
        good = i % 3 > 0
        w = rng.choices(words, k=rng.randint(5, 200))
        out.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w) if i % 2 else "spam " * len(w), int(good)))
    return out


def test_quality(spark):
    data = quality_rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data] + [(900, None, 1.0), (901, "", 1.0), (None, "a b", 1.0), (902, "x " * 60_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 4], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    out = {r["doc_id"]: (r["score"], r["predicted"]) for r in Q.score_quality(docs, model).collect()}
    assert np.mean([out[i][1] == y for i, _, y in data if i % 4 == 0]) > 0.97
    assert out[900] == out[901] and all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in out.values()) and len(out) == 304
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, p) in out.items() if p}


def test_quality_without_preferences(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert Q.score_quality(docs, model).first()["score"] == 0.5 and Q.accepted(docs, model).count() == 1
    assert Q.score_quality(docs.limit(0), model).collect() == []


# --- mixing --------------------------------------------------------------------------------------
def test_targets_by_hand():
    assert M.source_targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": 250 / 3, None: 500 / 3}
    assert M.source_targets([("a", 10), ("b", 0)]) == {"a": 15.0, "b": 0.0} and M.source_targets([]) == {}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("ab", max_size=3)), st.integers(0, 1000)), max_size=8, unique_by=lambda x: x[0]))
def test_targets_share_everything(sizes):
    target = M.source_targets(sizes)
    assert abs(sum(target.values()) - 1.5 * sum(n for _, n in sizes)) < 1e-6 and all(target[s] <= 2 * n + 1e-9 for s, n in sizes)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["s1", "s2", "s2", "s2", None]), "x") for i in range(3000)] + [(5000, None, "s3", "x"), (5001, "one", "s4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = M.mix(docs).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    for s in ("s1", "s2", None):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60 and own[0]["source_size"] == sum(r["size"] for r in own)
    again = {r["doc_id"]: r["taken"] for r in M.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert M.mix(docs.limit(0)).collect() == []


# --- urls -----------------------------------------------------------------------------------------
def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(str.maketrans(U.UPPER, U.LOWER)), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


URLS = ["http://A.example.com/en/1?x", "https://www.example.com/en/", "x://example.com", "http://a.net/es/1", "http://a.net/en/1", "net", None, "", "http://h.org/a#b", "http://h.org?q://x", "http://bad.org/1", "http://www.bad.org/2", "a\n://Éxample.NET/fr/x", "http://", "http://notexample.com/en/1", "http://a.co.uk/x"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 60 + [("h.org", 1)] * 60 + [("h.org", None), (None, 1)], "host string, good int")
    out = {r["page_id"]: r for r in U.judge_urls(pages, outcomes, RULES).collect()}
    for i, u in enumerate(URLS * 2):
        host, path = plain_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule[0])
        want = rule[1] or ("block" if host == "bad.org" or host == "www.bad.org" else "allow")
        assert out[i]["verdict"] == want, u
    assert out[8]["good_mean"] > 0.9 and out[10]["good_upper"] < 0.2 and out[10]["n_outcomes"] == 60
    none = U.judge_urls(pages, outcomes.limit(0), RULES).filter("page_id = 8").first()
    assert none["good_mean"] == 0.5 and none["verdict"] == "allow" and U.judge_urls(pages.limit(0), outcomes, RULES).collect() == []


# --- contamination ------------------------------------------------------------------------------------
def plain_contamination(text, items, n=8):
    pat, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans(U.UPPER, U.LOWER)
    words, hit, ids = pat.findall((text or "").translate(low)), set(), set()
    for item, t in items:
        w = pat.findall((t or "").translate(low))
        for a in range(max(1, len(w) - n + 1)) if w else ():
            g = w[a : a + n]
            for at in range(len(words) - len(g) + 1):
                if words[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    ids.add(item)
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("slice_chars", [20_000_000, 30])
def test_contamination(spark, slice_chars):
    rng = random.Random(8)
    w = lambda n: " ".join(rng.choice("ab cD éü x1 Zz".split()) for _ in range(n))
    items = [("i1", w(12)), ("i2", w(5)), ("i3", w(30)), ("i4", None), ("i5", "--"), (None, w(3)), ("i1", w(9)), ("i6", "Q!")]
    passages = [t for _, t in items if t]
    texts = [None, "", "q", w(4000)] + [w(rng.randint(0, 40)) + ", " + rng.choice(passages).upper() + "! " + w(9) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(i, t) for i, t in items] * 2, "item_id string, text string")
    known = [(i, t) for i, t in items if i and t]
    got = {r["doc_id"]: r for r in D.find_contamination(docs, bench, slice_chars=slice_chars).collect()}
    for i, t in enumerate(texts):
        words, hit, ids = plain_contamination(t, known)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == (words, hit, ids)
        for s in got[i]["spans"]:
            assert plain_contamination(t[s["start"] : s["stop"]], known)[1] > 0
    clean = D.decontaminate(docs, bench, slice_chars=slice_chars)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(texts) if not got[i]["item_ids"]} and clean.columns == docs.columns
    assert D.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


# --- html ------------------------------------------------------------------------------------------------
P = "<p>" + "A sentence of some words that goes on. " * 4 + "</p>"
TEXT = ("A sentence of some words that goes on. " * 4).strip()
PAGES = {
    "article": (f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><a href=1>Menu</a></nav><!-- <p>c</p> --><div class='ad'>Buy this now</div><article><h1>Title &amp; more</h1>{P}<p>Ti.</p></article><footer>&copy; x</footer>", f"Title & more\n\n{TEXT}\n\nTi."),
    "script": (f'<script>var t="</p>";</script><article>{P}</article>', TEXT),
    "comments": (f"<article>{P}<div id='comments'><p>First! what a great long comment that is</p></div><aside>More</aside><form>Name <input></form></article>", TEXT),
    "no article": (f"<div class=menu><a>Home</a> <a>News</a></div><div id=content>{P}{P}</div><div class='site-footer'>all rights reserved by us</div>", f"{TEXT}\n\n{TEXT}"),
    "layout names": (f"<div class='has-sidebar'><article class='post'>{P}</article><div class='sidebar'><p>Some other words stand here</p></div></div>", TEXT),
    "layout names only": (f"<div class='with-menu'><div>{P}{P}</div></div>", f"{TEXT}\n\n{TEXT}"),
    "comment articles": (f"<main>{P}<article class='comment'><p>What a great long comment that is, really</p></article></main>", TEXT),
    "related articles": (f"<article>{P}</article><section class='related'><article><p>Another story about something else</p></article></section>", TEXT),
    "cut off": (f"<article>{P}<p>End &am", f"{TEXT}\n\nEnd &am"),
    "cut in a tag": (f"<article>{P}<p>End <a hre", f"{TEXT}\n\nEnd"),
    "spaces": ("<article><p> a&nbsp;b\n\t c<br>d<b>e</b>f </p></article>", "a b c def"),
    "quoted": ('<article><p title="a > b">one two</p></article>', "one two"),
    "unclosed": ("<article><p><b>one<br><p>two</p></article>", "one\n\ntwo"),
    "hidden": ("<article><p style='display: none'>no</p><p hidden>no</p><p>yes it is</p></article>", "yes it is"),
    "lone": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "empty": ("", ""), "null": (None, ""), "no markup": ("just some text", "just some text"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_html(name):
    page, want = PAGES[name]
    assert H.main_text(page, H.default_tree()) == want


@settings(max_examples=150, deadline=None)
@given(st.text("<>/pdiva\"'=&;! -b", max_size=60))
def test_html_never_breaks(page):
    assert isinstance(H.main_text(page, H.default_tree()), str)


def test_html_table(spark):
    pages = spark.createDataFrame([(i, "u", h, "t") for i, (h, _) in enumerate(PAGES.values())] + [(99, None, "<article><p>" + "word " * 50_000 + "</p></article>", "t")], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in H.extract(pages).collect()}
    assert [out[i]["text"] for i in range(len(PAGES))] == [w for _, w in PAGES.values()] and out[99]["n_chars"] == 50_000 * 5 - 1
    assert H.extract(pages.limit(0)).collect() == []


def test_tree_learns_its_table():
    table = np.array(H.LABELLED, float)
    assert np.mean([H.classify(H.default_tree(), r) == bool(y) for r, y in zip(table[:, :-1], table[:, -1], strict=True)]) > 0.97


def test_one_worker_serves_other_benchmarks_and_windows():
    """What a worker keeps is told apart by the broadcast value itself and by the window."""

    class Shared:
        def __init__(self, value):
            self.value = value

    text = b"one two three four five six seven eight nine"

    def count(items, n):
        m = D._Matchers.__new__(D._Matchers)
        m.shared, m.n = items, n
        return D.scan_text(text, m.all())[1]

    first, second = Shared([("a", b"two three four")]), Shared([("b", b"eight nine")])
    assert [count(first, 8), count(first, 2), count(second, 8), count(first, 8), count(Shared([("c", b"zero one")]), 2)] == [3, 3, 2, 3, 0]


def test_a_large_benchmark_in_slices_gives_the_same(spark):
    rng = random.Random(7)
    w = lambda n: " ".join(rng.choice(["ab", "cd", "ef", "gh", "é", "x1"]) for _ in range(n))
    items = [(f"i{k}", w(rng.choice([3, 9, 20]))) for k in range(30)] + [("i0", None), (None, "ab cd")]
    docs = [(i % 20, f"{w(20)} {items[i % 30][1].upper()}. {w(5)}", "r") for i in range(40)] + [(7, None, "r"), (8, "", "r"), (None, w(60), "r")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, row string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    plain = lambda rows: sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), tuple(sorted((x["start"], x["stop"], x["item_id"]) for x in r["spans"]))) for r in rows), key=str)
    whole, cut = (plain(D.find_contamination(documents, benchmark, slice_chars=size).collect()) for size in (10**6, 100))
    assert whole == cut and any(x[2] for x in cut)
    for least in (1, 3):
        left = [sorted(map(tuple, D.decontaminate(documents, benchmark, min_items=least, slice_chars=size).collect()), key=str) for size in (10**6, 100)]
        assert left[0] == left[1]


LONG = "This is a long paragraph of running text that says a number of things about a subject which a reader would want to have whole and without any loss, so it goes on for some sixty words or so, and then on for a little more, until at last it comes to a full stop near the very end of the line."
MORE = "A second paragraph follows here with some more words of text, enough to be called running text by anyone who reads it at all."
PROBES = [
    (f"<article><p><a href='x'>Read the whole of the earlier story of last week</a> here</p><p>{LONG}</p></article>", ["Read the whole of the earlier story of last week here", LONG]),
    (f"<main class='popular-science'><h1>Title of it</h1><p>{LONG}</p><p>{MORE}</p></main>", ["Title of it", LONG, MORE]),
    (f"<article class='warning-signs'><p>{LONG}</p><p>{MORE}</p></article>", [LONG, MORE]),
    (f"<body><div class='review-content'><p>{LONG}</p><p>{MORE}</p></div></body>", [LONG, MORE]),
    (f"<body><div id='legal-history'><h2>Of old</h2><p>{LONG}</p><p>{MORE}</p></div></body>", ["Of old", LONG, MORE]),
    (f"<!--><p>{LONG}</p><!---><p>{MORE}</p><!-- x --!><p>{LONG}</p>", [LONG, MORE, LONG]),
    (f"<div><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div><article><a href='y'>Another story</a><p>Short teaser of it.</p></article>", [LONG, MORE, LONG]),
    (f"<article><p>{LONG}</p><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, says the text.</p></article>", [LONG, "Where x=1 holds, says the text."]),
    (f"<article><p>{LONG}</p></article><div class='comment-list'><div class='comment-body'><p>{LONG}</p></div></div>", [LONG]),
    (f"<div class='post'><p>{LONG}</p><p>{MORE}</p></div><div id='comments'><div class='comment'><p>{LONG}</p></div></div>", [LONG, MORE]),
    (f"<div class='cookie-banner'><p>{MORE}</p></div><div class=content><p>{LONG}</p></div><div class='sidebar-left'><p>{MORE}</p></div><div class='related-posts'><p>{MORE}</p></div><footer><p>{MORE}</p></footer>", [LONG]),
    (f"<article><p>{LONG}</p><form><p>{MORE}</p></form><div class='ad'><p>{MORE}</p></div><p>{MORE}</p></article>", [LONG, MORE]),
    (f"<ul class=menu><li><a>a</a><li><a>b</a></ul><h1>Head</h1><p>{LONG}</p><p>ok then.</p><p>{MORE}</p><div class='share-buttons'><a>x</a></div>", ["Head", LONG, "ok then.", MORE]),
    (f"<div class='notice'><p>{MORE}</p></div><main><p>{LONG}</p></main><div role=alert>{MORE}</div>", [LONG]),
]


def test_pages_come_out_whole():
    tree = H.default_tree()
    for page, want in PROBES:
        assert H.main_text(page, tree).split("\n\n") == want


def test_the_tree_uses_words_and_links():
    used, todo = set(), [H.default_tree()]
    while todo:
        node = todo.pop()
        if node.column >= 0:
            used.add(H.COLUMNS[node.column])
            todo += [node.low, node.high]
    assert {"words", "links", "article", "boiler"} <= used and used & set(H.COLUMNS[2:6])  # and those of neighbours


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["nav", "ad", "aside", "comments", "script", "p", "p", "p", "h2", "li", "form", "style"]), max_size=14), st.integers(0, 10**6))
def test_against_a_page_written_from_its_parts(kinds, seed):
    """Pages put together from marked parts: exactly the article's parts come out."""
    rng = random.Random(seed)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(n))
    wrap = {"nav": "<nav><ul><li><a href='/'>{}</a></li></ul></nav>", "ad": "<div class='ad'>{}</div>", "aside": "<aside><p>{}</p></aside>", "comments": "<section id=comments><p>{}</p></section>", "script": "<script>{}</script>", "style": "<style>{}</style>", "form": "<form><label>{}</label></form>"}
    inside, want = "", []
    for kind in kinds:
        text = w(rng.randint(1, 60))
        if kind in wrap:
            inside += wrap[kind].format(text)
        else:
            inside += f"<{kind}>{text}</{kind}>"
            want.append(text)
    page = f"<html><head><title>{w(3)}</title></head><body><header>{w(5)}</header><nav><a>{w(2)}</a></nav><article>{inside}</article><footer>{w(20)}</footer></body></html>"
    assert H.main_text(page, H.default_tree()) == "\n\n".join(want)
