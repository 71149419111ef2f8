"""Text in, text out: the engine's behaviour on small documents."""

from pathlib import Path

import pytest

from palimpsest.operators import allocate as A
from palimpsest.operators import reports as R
from palimpsest.operators.options import Options
from palimpsest.operators.scrub import scrub, scrub_text

ALLOW = frozenset({"noreply@example.org", "system", "guest"})
CASES = {
    "name and address": ("From: Jane Doe <jane.doe@example.edu>\nCc: noreply@example.org\n", {}, "From: PERSON_001 <user_001@example.test>\nCc: noreply@example.org\n"),
    "audit xml": ("<sys_created_by>demo.user1</sys_created_by><sys_updated_by>system</sys_updated_by>", {}, "<sys_created_by>username_001</sys_created_by><sys_updated_by>system</sys_updated_by>"),
    "audit json": ('{"sys_created_by": "demo.user1", "sys_updated_by": "system"}', {}, '{"sys_created_by": "username_001", "sys_updated_by": "system"}'),
    "login": ('<sysevent a="b"><name>login.failed</name><parm1>u..demo1</parm1><parm2>203.0.113.40</parm2></sysevent>', {}, '<sysevent a="b"><name>login.failed</name><parm1>username_001</parm1><parm2>203.0.113.40</parm2></sysevent>'),
    "other event": ("<sysevent><name>email.read</name><parm1>u..demo1</parm1></sysevent>", {}, "<sysevent><name>email.read</name><parm1>u..demo1</parm1></sysevent>"),
    "login then prose": ("<sysevent><name>login</name><parm1>leakuser1</parm1></sysevent> retry as leakuser1 again", {}, "<sysevent><name>login</name><parm1>username_001</parm1></sysevent> retry as username_001 again"),
    "harvest": ("| Reporter | - Jane Doe/Casey van Berg |\n| Description | Dustin, Esprit |\nTest with Jane Doe:<br>", {}, "| Reporter | - PERSON_001/PERSON_002 |\n| Description | Dustin, Esprit |\nTest with PERSON_001:<br>"),
    "no harvest": ("| Reporter | Jane Doe |", {"harvest_names": False}, "| Reporter | Jane Doe |"),
    "ip": ("Client 10.20.30.40 and peer fd12:3456:789a:1::1", {"ip": True}, "Client 203.0.113.2 and peer 2001:db8::2"),
    "machine": ("host= sn-prod-01.example.local", {"machines": True}, "host= MACHINE_001"),
    "machine off": ("host= sn-prod-01.example.local", {}, "host= sn-prod-01.example.local"),
    "paths": ("see C:\\Temp\\a.txt and /home/me/x.log", {"paths": True}, "see PATH_002 and PATH_001"),
    "command": ("py -3 scripts/x.py inbox/raw", {"commands": True}, "CMD_001"),
    "pem": ("a\n-----BEGIN KEY-----\nabc\n-----END KEY-----\nb", {"certificates": True}, "a\nCERT_001b"),
    "chained": ("curl http://10.1.2.3/x > /tmp/out.bin", {"ip": True, "paths": True, "commands": True}, "CMD_001"),
    "prefix": ("UHMASKEDADDR_person.demo@example.com", {}, "UHMASKEDADDR_user_001@example.test"),
    "allowed": ("From noreply@example.org only", {}, "From noreply@example.org only"),
    "phone and iban": ("Bel +31 6 12345678 of NL91 ABNA 0417 1643 00", {}, "Bel PHONE_001 of IBAN_001"),
    "csv": ("naam,email\nJane Doe,jane@example.edu\n", {}, "naam,email\nPERSON_001,user_001@example.test\n"),
    "single token": ("| Reporter | Dustin |", {"single_token_names": True}, "| Reporter | PERSON_001 |"),
    "parts": ("| Reporter | Sam Jansen |\nSam will provide", {}, "| Reporter | PERSON_001 |\nPERSON_001 will provide"),
    "orgs": ("Imports (Dustin and Esprit) fail", {"orgs": ("Dustin", "Esprit")}, "Imports (ORG_001 and ORG_002) fail"),
    "orgs off": ("Imports (Dustin) fail", {"orgs": ("Dustin",), "scrub_orgs": False}, "Imports (Dustin) fail"),
    "bsn": ("BSN: 123456782", {"nl_id": True}, "BSN: 000000001"),
    "p2": ("mac 00:11:22:33:44:55 dob: 2001-02-03 at Kerkstraat 12, 1234 AB", {}, "mac 00:00:5e:00:53:01 dob: 1900-01-02 9999 XX01"),
    "recogniser absent": ("Hello Jane Doe in free text only", {"recognise": True, "harvest_names": False}, "Hello Jane Doe in free text only"),
    "empty": ("", {}, ""),
}


TECHNICAL = {"ip": True, "machines": True, "paths": True, "commands": True, "certificates": True, "nl_id": True}


def local(text, options):
    """The same passes over one text, with numbers given on the spot."""
    import re as _re

    from palimpsest.functions import passes as P
    from palimpsest.functions import textops as t

    tokens, counts = {}, {}

    def give(no, kind, value):
        key = (kind, t.key_of(kind, value).lower() if kind == "person" else t.key_of(kind, value))
        if key not in tokens:
            n = counts[kind] = counts.get(kind, 0) + 1
            tokens[key] = {"ip": f"2001:db8::{n:x}" if ":" in value else f"203.0.113.{n % 254 + 1}", "dob": f"1900-01-{n % 28 + 1:02d}"}.get(kind) or _re.sub(r"0+(?=@|$)", lambda m: str(n).zfill(len(m[0])), P.STAND_IN[kind])
            if kind == "ip":
                counts["ip"] = n
        return tokens[key]

    quiet = lambda *_: None
    out = P.account_passes(P.address_passes(text, options.allowlist, give, quiet), options.allowlist, give, quiet)
    if options.harvest_names:
        for name in t.harvest(text, options.allowlist, single=options.single_token_names):
            P.person_token(give, P.HARVEST, name)
    for org in options.orgs if options.scrub_orgs else ():
        give(P.ORGS, "org", org)
    entries = [(k, name, tokens[k, name.lower()]) for k, name in [(x, n) for x, n in tokens if x == "person"]]
    entries += [("person", p.lower(), tok) for _, name, tok in list(entries) for p in t.name_parts(name.title())]
    entries += [(k, n, tokens[k, n]) for k, n in tokens if k in ("org", "username")]
    out = P.dictionary_passes(out, entries, options.allowlist, quiet)
    for kind in options.kinds():
        out = P.value_pass(out, kind, options.allowlist, give, quiet)
    return out


@pytest.mark.parametrize("name", [n for n in CASES if n != "prefix"])  # its token is the allocation's
def test_passes(name):
    text, flags, want = CASES[name]
    assert local(text, Options(allowlist=ALLOW, **flags)) == want


def test_engine_on_technical_text(spark):
    names = ["ip", "machine", "paths", "pem", "chained", "bsn", "p2", "recogniser absent"]
    docs = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)], "file_ord long, text string")
    out = by_ord(scrub(docs, None, Options(allowlist=ALLOW, recognise=True, **TECHNICAL)))
    assert out[0] == CASES["ip"][2] and out[1] == CASES["machine"][2] and out[2] == CASES["paths"][2] and out[3] == CASES["pem"][2]
    assert out[4] == "CMD_001" and out[5] == CASES["bsn"][2] and out[6] == CASES["p2"][2] and out[7] == CASES["recogniser absent"][2]


def test_engine_on_accounts(spark):
    names = ["name and address", "audit xml", "audit json", "login then prose", "csv", "phone and iban", "prefix"]
    docs = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)], "file_ord long, text string")
    out = by_ord(scrub(docs, None, Options(allowlist=ALLOW)))
    assert [out[i] for i in (0, 1, 2)] == [CASES[n][2] for n in names[:3]]
    assert out[3] == CASES["login then prose"][2].replace("username_001", "username_002")
    assert out[4] == "naam,email\nPERSON_001,user_002@example.test\n" and out[5] == CASES["phone and iban"][2] and out[6] == "UHMASKEDADDR_user_003@example.test"


DOCS = [(1, "x@a.co | Reporter | Sam Jansen |"), (2, "| Reporter | Sam Jansen |\nmail y@a.co"), (3, "Sam says X@A.CO and +31 6 12345678"), (4, None), (0, "Sam early")]


def by_ord(run):
    return {r["file_ord"]: r["text"] for r in run.documents.collect()}


def test_many_documents(spark):
    docs = spark.createDataFrame(DOCS, "file_ord long, text string")
    run = scrub(docs, None, Options(allowlist=ALLOW))
    want = {0: "Sam early", 1: "user_001@example.test | Reporter | Sam Jansen |", 2: "| Reporter | PERSON_001 |\nmail user_002@example.test", 3: "PERSON_001 says user_001@example.test and PHONE_001", 4: ""}
    assert by_ord(run) == want
    # partitioning changes nothing; a map from before keeps its tokens
    again = scrub(docs.repartition(5), run.pii_map.cache(), Options(allowlist=ALLOW))
    assert by_ord(again)[3] == want[3]
    assert again.pii_map.count() == run.pii_map.count()
    assert by_ord(scrub(docs, None, Options(allowlist=ALLOW, visibility="global")))[0] == "PERSON_001 early"
    # the joined dictionary gives what the broadcast one gives
    assert by_ord(scrub(docs, None, Options(allowlist=ALLOW, broadcast_entries=0))) == want
    assert {r["kind"]: r["hits"] for r in R.hits_by_kind(run.hits).collect()} == {"email": 3, "name": 2, "phone": 1}
    assert R.residual_counts(run.residuals).first()["residual_email"] == 0
    damage = R.prose_damage(run.hits, run.documents).first().asDict()
    assert damage == {"stopword_name_hits": 0, "short_name_hits": 1, "stopword_loss": 0, "total": 1}
    assert A.poison_count(run.pii_map).first()[0] == 1
    assert A.prune(run.pii_map, run.hits).count() == 6
    tokens = spark.createDataFrame([("PERSON_001",)], "token string")
    assert {v["key"] for v in A.reverse(run.pii_map, tokens).first()["values"]} == {"Sam Jansen", "Sam", "Jansen"}
    rows = R.per_file_summary(run.hits, run.residuals).collect()
    assert rows[0]["file_ord"] == 3 and rows[0]["hits"] == 3


def test_seeded_map_and_irreversible(spark):
    seeded = spark.createDataFrame([("person", "user", "PERSON_007", 7, -1, 0, 0), ("person", "Sam Jansen", "PERSON_008", 8, -1, 0, 1)], A.MAP_SCHEMA)
    run = scrub_text(spark, "user Sam Jansen; | Reporter | Ann Other |", seeded)
    assert run.documents.first()["text"] == "user PERSON_008; | Reporter | Ann Other |"
    run = scrub_text(spark, "a@b.co and a@b.co", None, Options(irreversible=True, secret=b"k"))
    text = run.documents.first()["text"]
    assert text.count("REDACTED_EMAIL_") == 2 and len(set(text.split(" and "))) == 1


def test_numbers_grow_and_wrap(spark):
    text = " ".join(f"10.0.{i // 200}.{i % 200}" for i in range(300)) + " " + " ".join(f"u{i}@x.co" for i in range(1005))
    run = scrub_text(spark, text, None, Options(ip=True, p2=False))
    tokens = {r["token"] for r in run.pii_map.collect()}
    assert "user_1005@example.test" in tokens and len([x for x in tokens if x.startswith("203.0.113.")]) == 254
    assert "10.0." not in run.documents.first()["text"]


def test_bundle():
    assert Options().technical().kinds() == ["cert", "path", "cmd", "machine", "iban", "phone", "mac", "postcode", "dob"]


def test_both_ways_to_the_dictionary_give_the_same(spark):
    """Accents, decomposed letters, odd capitals and signs, by broadcast and by join."""
    from palimpsest.operators.options import Options

    users = ["jose", "jos\u00e9", "stra\u00dfe", "\u0130lk", "K\u00e4the", "o'brien", "j.doe", "a-b", "sigma\u03c3"]
    texts = ["".join(f"<sys_created_by>{u}</sys_created_by> " for u in users)]
    texts += ["JOSE jose\u0301 jos\u0065\u0301 JOS\u00c9 joses", "STRASSE STRA\u1e9eE stra\u00dfe \u0131lk ilk \u0130LK", "\u212a\u00e4the k\u00c4THE x.k\u00e4the", "O'Brien; J.DOE a-B a-b-c SIGMA\u03c2 sigma\u03a3", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_ord long, text string")
    for visibility in ("sequential", "global"):
        out = []
        for most in (50_000, 0):
            run = scrub(docs, None, Options(broadcast_entries=most, visibility=visibility))
            out.append((sorted(map(tuple, run.documents.select("file_ord", "text").collect())), sorted(map(tuple, run.hits.collect()))))
        assert out[0] == out[1]
        assert "username_001\u0301" in dict(out[0][0])[1]


def test_a_words_fold_covers_case_insensitive_matching():
    import re

    from palimpsest.functions import passes as P

    letters = [c for c in map(chr, range(0x2C00)) if c.isalpha()]
    for c in letters:
        for d in {c.lower(), c.upper(), c.swapcase(), c.casefold()}:
            if len(d) == 1 and re.fullmatch(re.escape(c), d, re.IGNORECASE):
                assert P.fold("x" + c) == P.fold("x" + d)


def test_only_the_last_barrier_stays(spark):
    def kept():
        folder = spark.sparkContext.getCheckpointDir()
        return set(Path(folder.removeprefix("file:").replace("//", "/")).glob("written-*")) if folder else set()

    before = kept()
    docs = spark.createDataFrame([(0, "mail a@corp.example from 10.1.2.3"), (1, None), (2, "nothing")], "file_ord long, text string")
    run = scrub(docs, None, Options(ip=True))
    assert [r["text"] for r in run.documents.orderBy("file_ord").collect()] == ["mail user_001@example.test from 203.0.113.2", "", "nothing"]
    assert len(kept() - before) == 1
    assert run.hits.count() == 2
