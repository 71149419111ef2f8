"""What keeps the work in step with the input: few candidates a document, even partitions."""

import random
import re

import pyarrow as pa
import pytest

from palimpsest.functions import passes as P
from palimpsest.operators.options import Options
from palimpsest.operators.scrub import _with_dictionary
from palimpsest.plans import registry


def test_names_that_share_a_word_are_told_apart(spark):
    names = [f"Sam Jansen{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [("person", n, f"PERSON_{i:03d}", i, 6, 0) for i, n in enumerate(names)]
    entries = spark.createDataFrame(rows, "kind string, key string, token string, file_ord long, pass int, pos long")
    docs = spark.createDataFrame([(i, f"then {n.lower()} called Sam") for i, n in enumerate(names)], "file_ord long, text string")
    _, shared = _with_dictionary(docs, entries, Options())
    assert shared.value.near("then SAM JANSENCA, of Sam") == [("person", "Sam Jansenca", "PERSON_002")]
    joined, _ = _with_dictionary(docs, entries, Options(broadcast_entries=0))
    assert {r["file_ord"]: [e["token"] for e in r["entries"]] for r in joined.collect()} == {i: [f"PERSON_{i:03d}"] for i in range(300)}


def test_any_key_is_found_by_its_units():
    keys = ["Jan van Berg", "jan", "a-b", "-x", "...", "o'brien y", "Foo PERSON_001", "josé käthe", "straße 1", "b c"]
    entries = pa.table({"kind": ["username"] * len(keys), "key": keys, "token": keys, "file_ord": [0] * len(keys)})
    known = P.Dictionary(entries)
    for text in ["JAN VAN BERG", "(jan)", "x a-B-c", "y-x", "z...z", "O'Brien y", "Foo Bar", "JOSÉ KÄTHE", "Straße 1", "a b c d", ""]:
        near = {k for _, k, _ in known.near(text)}
        assert {k for k in keys if re.search(rf"\b{re.escape(k)}\b", text, re.IGNORECASE)} <= near and "..." in near
    assert "Foo PERSON_001" in {k for _, k, _ in known.near("Foo Bar Baz")}  # the token may come later
    assert P.Dictionary(entries.slice(0, 0)).near("x") == []


def test_plain_matching_equals_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text, key = ("".join(rng.choices("aAb_ .-1", k=rng.randint(low, high))) for low, high in ((0, 14), (1, 3)))
        for words, pattern in ((True, rf"\b{re.escape(key)}\b"), (False, re.escape(key))):
            want = re.sub(pattern, lambda m: f"<{m[0]}{m.start()}>", text, flags=re.IGNORECASE)
            assert P._each_match(text, key, words, lambda whole, _, start, end: f"<{whole}{start}>") == want


def test_values_of_columns_are_computed_once(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import columns as C

    for made, times in ((C.first_by(F.split(F.reverse("x"), ","), F.lower), 1), (C.looks_like_name(F.reverse("x")), 1), (C.harvest_bullets(F.reverse("x")), 2)):
        plan = spark.createDataFrame([("b,a",)], "x string").select(made.alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("reverse(") == times  # of bullets, a pass for labels and one for bodies
    values = [["B", "a", "b", "A", "", "é", "É"], [], None]
    df = spark.createDataFrame([(v,) for v in values], "v array<string>")
    assert [r[0] for r in df.select(C.first_by(F.col("v"), F.lower)).collect()] == [["B", "a", "", "é"], [], None]


def test_one_row_group_is_spread(spark, tmp_path):
    from palimpsest.plans.cut import spread

    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/t")
    out = spread(spark.read.parquet(f"{tmp_path}/t"), "id")
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 5000 and max(sizes) < 5000 / 8 and out.distinct().count() == 5000
    assert spread(out, "id").rdd.getNumPartitions() == len(sizes) and spread(spark.range(3), "id").count() == 3


@pytest.mark.parametrize(("name", "want"), [
    ("ipv6_scrub_customers", "at 2001:db8::{0:x} and ::1 or 2001:db8::5 end"),
    ("postcode_scrub_customers", "9999 XX{0:02d} end"),
    ("value_scrub_customers", "mac 00:00:5e:00:53:{0:02x} tel PHONE_{0:03d} dob: 1900-01-02"),
])
def test_values_made_of_large_keys(spark, tmp_path, name, want):
    keys = [0, 1, 999, 65535, 65536, 65537, 99_999, 100_000, 131_072, 999_999, 1_000_000, 1_000_001, 5_399_999, 10_065_536]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    out = {r["file_ord"]: r["text"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert out == {k: want.format(n) for n, k in enumerate(keys, 1)}


def test_the_table_function_reads_one_row_group_in_many_tasks(spark, tmp_path):
    texts = ["a@b.co of fe80::1 and 1:2:3:4:5:6:7:8", "Kerkstraat 12, 1234 AB", "::1 at ::ffff:2 or 10.1.2.3", None, "1:2:3:4:5:6:7", "no 1234 AB"]
    docs = spark.createDataFrame([(i, texts[i % 6]) for i in range(1200)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["find_pii_table_function"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 8
    found = {i: [(r["kind"], r["value"]) for r in out.filter(f"doc_id = {i}").collect()] for i in range(6)}
    assert found == {0: [("email", "a@b.co"), ("ip", "fe80::1"), ("ip", "1:2:3:4:5:6:7:8")], 1: [("postcode", "Kerkstraat 12, 1234 AB")], 2: [("ip", "10.1.2.3"), ("ip", "::ffff:2")], 3: [], 4: [], 5: []}


def test_the_engine_spreads_documents_of_one_row_group(spark, tmp_path):
    from palimpsest.operators.scrub import scrub

    spark.range(1200).selectExpr("id as file_ord", "'plain' as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    run = scrub(spark.read.parquet(f"{tmp_path}/documents.parquet"), None, Options())
    assert len(run.documents.inputFiles()) > 2 and run.documents.count() == 1200  # a file for each task


def test_a_broadcast_dictionary_is_small():
    import pickle

    keys = [f"person{i}" for i in range(20_000)]
    known = P.Dictionary(pa.table({"kind": ["username"] * 20_000, "key": keys, "token": keys, "file_ord": range(20_000)}))
    known = pickle.loads(pickle.dumps(known))
    held = sum(c.nbytes for c in (known.kind, known.key, known.token, known.file_ord, known.units, known.order))
    assert held < 80 * 20_000 and known.near("of Person77", 77) == [("username", "person77", "person77")] and known.near("person77", 76) == []


def test_rows_of_nested_columns_are_those_of_arrow():
    from palimpsest.operators import scrub as S

    notes = [[{"pass": 1, "pos": 2, "kind": "ip", "key": "a", "value": None}] * k for k in (2, 0, 1, 3)]
    batch = pa.record_batch({"file_ord": range(6), "text": ["a", None, "b", "", "c", "d"], "found": pa.array([None, *notes, None], S._FOUND), "plain": pa.array([[1], [], None, [2], [], []])})
    for at in range(6):
        for size in range(7 - at):
            assert S._rows(batch.slice(at, size)) == batch.slice(at, size).to_pylist()


def test_plain_columns_are_read_by_numpy():
    from timeit import repeat

    from palimpsest.operators import scrub as S

    strings = pa.array([f"text {i}" for i in range(50_000)])
    assert min(repeat(lambda: S._values(strings), number=1, repeat=5)) < min(repeat(strings.to_pylist, number=1, repeat=5)) / 2
    odd = [pa.array(["a\0b", None, "é\U0001f600", ""]), pa.array(["x", None], pa.large_string()), pa.array([1, 2**62], pa.int64()), pa.array([None, -3], pa.int32()), pa.array([], pa.string()), pa.array([True, None])]
    for column in odd:
        assert S._values(column) == column.to_pylist() and list(map(type, S._values(column))) == list(map(type, column.to_pylist()))
        assert S._values(column.slice(1)) == column.slice(1).to_pylist()


def test_texts_without_a_patterns_parts_are_not_searched(monkeypatch):
    from palimpsest.functions import textops as t

    class Unused:
        def __getattr__(self, name):
            raise AssertionError(name)

    for name in ("IPV4", "MACHINE", "IBAN", "PHONE", "BSN_LABELLED", "BSN_BARE", "MAC", "POSTCODE_STREET", "POSTCODE_BARE", "DOB", "TEST_WITH"):
        monkeypatch.setattr(t, name, Unused())
    monkeypatch.setattr(t, "PATHS", (Unused(), Unused()))
    text = "Prose of many words, with a date of birth; chapter 7 and no more. "
    for kind in P.VALUE_PASSES:
        assert P.value_pass(text, kind, frozenset(), None, None) == text
    assert t.residuals(text, frozenset(), True, True) == [] and t.harvest(text, frozenset()) == []


def test_what_is_looked_for_first_is_in_every_match():
    from palimpsest.functions import textops as t

    parts = ["1", "12", "0612345678", "+1 2 3 4 5 6 7 8 9", "+", ".", "1.1.1.1", "٣.٣.٣.٣", ":", "-", "aa:bb:cc:dd:ee:ff", "aa-bb-cc-dd-ee-ff", "/tmp/x", "c:\\x", " ", "ho\u017ft: a", "mach\u0130ne=b", "mach\u0131ne: b", "HOST = c",
             "te\u017ft with Ann Other", "Tested with Ann Other", "Straat 1 1234 ab", "bsn 111222333", "dob 1-2-99", "NL91ABNA0417164300", "\n"]
    rng = random.Random(5)
    seen = set()
    for _ in range(6000):
        text = " ".join(rng.choices(parts, k=rng.randint(1, 3)))
        holds = {
            "machine": (t.MACHINE, t.may_hold_machine(text)), "ip": (t.IPV4, t.may_hold_ipv4(text)), "test": (t.TEST_WITH, t.may_hold(text, "test")), "mac": (t.MAC, t.find_macs(text)),
            "phone": (t.PHONE, t.find_phones(text)), "dob": (t.DOB, t.find_dobs(text)), "iban": (t.IBAN, t.digits(text) > 1), "bsn": (t.BSN_LABELLED, t.digits(text) > 1), "postcode": (t.POSTCODE_BARE, t.find_bare_postcodes(text)),
            "windows": (t.PATHS[0], t.find_paths(text)), "unix": (t.PATHS[1], t.find_paths(text)),
        }
        for name, (pattern, said) in holds.items():
            if pattern.search(text):
                seen.add(name)
                assert said, (name, text)
    assert seen == set(holds)


def test_long_and_short_texts_give_the_same_pairs():
    words = [f"Wörd{i} käthe" for i in range(40)]
    short = set().union(*(P.units_of(" ".join(words[i : i + 3])) for i in range(38)))
    assert short == P.units_of(" ".join(words)) and set(P.units_of_key("wörd3 KÄTHE WÖRD4")) <= short


def test_texts_with_values_are_rewritten_by_many_tasks(spark):
    from palimpsest.operators import scrub as S

    docs = spark.createDataFrame([(i, "x", [(2, 0, "email", f"k{i}", f"k{i}")]) for i in range(400)], f"file_ord long, text string, found {S._FOUND_DDL}")
    tokens = spark.createDataFrame([("email", f"k{i}", f"T{i}") for i in range(400)], "kind string, key string, token string")
    out = S._with_tokens(docs, S._explode_found(docs), tokens)
    sizes = out.filter("size(found) > 0").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400 and max(sizes) <= 40
    assert all(r["tokens"] == [("email", f"k{r['file_ord']}", f"T{r['file_ord']}")] for r in out.collect())


def test_letters_of_any_script_are_matched_as_by_the_pattern(monkeypatch):
    rng = random.Random(6)
    letters = "aAkK\u212aS\u017fs\u00df\u1e9eiI\u0130\u0131\u03c3\u03c2\u03a3\u00b5\u03bc\u01c5\u01c4\u00e9\u00c9e\u0301\u0345\u0399\u03b9\u1fbe\ufb05\ufb06\U00010428\U00010400 -_1"
    cases = [["".join(rng.choices(letters, k=rng.randint(*n))) for n in ((0, 20), (1, 3))] for _ in range(6000)]
    wants = [[re.sub(p, lambda m: f"<{m[0]}{m.start()}>", text, flags=re.IGNORECASE) for p in (rf"\b{re.escape(key)}\b", re.escape(key))] for text, key in cases]
    assert sum(a != text for (text, _), (a, _) in zip(cases, wants, strict=True)) > 100
    monkeypatch.setattr(re, "sub", None)  # nothing is compiled for a key
    for (text, key), want in zip(cases, wants, strict=True):
        assert [P._each_match(text, key, words, lambda whole, _, start, end: f"<{whole}{start}>") for words in (True, False)] == want


def test_a_fold_covers_all_letters_that_match():
    letters, same = [*map(chr, [*range(0xD800), *range(0xE000, 0x1E960)])], {}
    for c in letters:
        same.setdefault(c.casefold(), []).append(c)
    for c in letters:
        for d in {c.lower(), c.upper(), c.swapcase(), c.title(), *same[c.casefold()]}:
            if len(d) == 1 and d != c and P._alike(c, d):
                assert P._folded("x" + c) == P._folded("x" + d)
        assert P._folded(c) == P._folded(c).lower() == P._folded(P._folded(c)) == P._fold_letter(c)


def test_texts_without_values_are_read_by_few_passes(spark, monkeypatch):
    from palimpsest.operators import scrub as S

    docs = spark.createDataFrame([(i, "x a@b.co tel +31 6 12345678" if i % 100 == 0 else f"Esprit {i}") for i in range(400)], "file_ord long, text string")
    sizes, real = [], S.written
    monkeypatch.setattr(S, "written", lambda df: sizes.append((out := real(df)).count()) or out)
    run = S.scrub(docs, None, Options(orgs=("Esprit",)))
    assert sizes == [400, 4, 400, 4]  # with addresses, and with values of their form, four each
    out = {r["file_ord"]: r["text"] for r in run.documents.collect()}
    assert len(out) == 400 and out[100] == "x user_001@example.test tel PHONE_001" and out[7] == "ORG_001 7"
