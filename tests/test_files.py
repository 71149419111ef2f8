"""Files, the map on disk, staging, the gate, the command line and streams."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.functions import fernet
from palimpsest.functions.register import register
from palimpsest.sources import commit_gate, files, mapstore, staging
from palimpsest.streaming import intake

KEY = b"cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="


def test_published_token_vector():
    """The format's published test vector."""
    token = b"gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
    assert fernet.encrypt(b"hello", KEY, 499162800, bytes(range(16))) == token
    assert fernet.decrypt(token, KEY) == b"hello"
    for bad in (token[:-8] + b"AAAAAAA=", b"xx", token[:40]):
        with pytest.raises(fernet.InvalidToken):
            fernet.decrypt(bad, KEY)


@pytest.fixture
def tree(tmp_path, monkeypatch):
    for d in ("inbox/raw/sub", "inbox/clean", "src/stories/STORY-1", "config", "inbox/raw/source-export"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "inbox/raw/_a.md").write_bytes(b"mail jane@corp.example\r\nok\xff")
    (tmp_path / "inbox/raw/sub/b.txt").write_text("| Reporter | Sam Jansen |\nSam called")
    (tmp_path / "inbox/raw/x.pdf").write_bytes(b"%PDF")
    (tmp_path / "inbox/raw/source-export/y.md").write_text("z@corp.example")
    (tmp_path / "inbox/clean/.gitkeep").write_text("")
    (tmp_path / "config/pii-allowlist.txt").write_text("# none\nNoReply@example.org\n")
    (tmp_path / "config/pii-org-scrub.txt").write_text("Esprit\nesprit\n")
    monkeypatch.setenv(mapstore.ENV_KEY, KEY.decode())
    monkeypatch.delenv(mapstore.ENV_PLAINTEXT, raising=False)
    return tmp_path


def run(spark, tree, *args):
    return cli.main([*map(str, args), "--root", str(tree)], spark)


def test_listing(tree):
    found = files.list_files([tree / "inbox/raw", tree / "inbox/raw/_a.md"])
    assert [p.rsplit("/", 1)[-1] for p, _ in found.files] == ["_a.md", "b.txt"] and (found.skipped_binary, found.skipped_export) == (1, 1)


def test_write_promote_and_maps(spark, tree, capsys):
    assert run(spark, tree, "--dry-run") == 0 and (tree / "inbox/raw/_a.md").exists()
    assert "jane" not in capsys.readouterr().out
    assert run(spark, tree, "--map-audit") == 0
    assert (tree / "inbox/clean/_a.md").read_bytes() == "mail user_001@example.test\nok�".encode()
    assert (tree / "inbox/clean/sub/b.txt").read_text() == "| Reporter | PERSON_001 |\nPERSON_001 called"
    assert not (tree / "inbox/raw/_a.md").exists() and (tree / "inbox/raw/x.pdf").exists()
    manifest = staging.Manifest(tree)
    assert manifest.is_verified(tree / "inbox/clean/_a.md") and len(manifest.read()) == 2
    saved = json.loads((tree / ".local/pii-map.json").read_text())
    assert saved["format"] == "fernet-v1"
    data = mapstore.Envelope.open(saved, KEY)
    assert data["counters"]["email"] == 1 and data["names"]["Sam"] == "PERSON_001" and data["orgs"] == {"Esprit": "ORG_001"}
    assert "hits" in json.loads((tree / ".local/pii-map-audit.jsonl").read_text())["counts"]
    (tree / "inbox/raw/x.pdf").unlink()
    (tree / "inbox/raw/source-export/y.md").unlink()
    (tree / "inbox/clean/sub/b.txt").write_text("tampered")
    assert run(spark, tree, "--promote", "STORY-1") == 2  # adopting needs every checksum
    (tree / "inbox/clean/sub/b.txt").unlink()
    assert run(spark, tree, "--promote", "STORY-1") == 0
    assert (tree / "src/stories/STORY-1/intake-clean/_a.md").exists() and not staging.staged_files(tree / "inbox/clean")
    # the same address gets the same token in a later run
    (tree / "inbox/raw/c.txt").write_text("JANE@corp.example")
    assert run(spark, tree, "--keep-raw") == 0 and (tree / "inbox/clean/c.txt").read_text() == "user_001@example.test"
    assert run(spark, tree, "--clear-clean") == 0 and (tree / "inbox/clean/.gitkeep").exists()


def test_gate_refuses(spark, tree, capsys):
    (tree / "src/stories/STORY-1/a.md").write_text("NoReply@example.org only")
    assert run(spark, tree, "--summary", "src/stories") == 0
    (tree / "src/stories/STORY-1/a.md").write_text("x@corp.example")
    assert run(spark, tree, "--summary", "src/stories") == 1
    assert "x@corp" not in capsys.readouterr().out
    for args in (["--summary"], ["--summary", "inbox/raw"], ["--summary", "--report", "src/stories"], ["--in-place", "--out", "x"], ["--promote", "a", "--promote-to", "b"], ["nowhere"], ["--agent-safe", "--report"], ["src"], ["--irreversible", "--map-prune-unused"]):
        assert run(spark, tree, *args) == 2


def test_missing_key_writes_nothing(spark, tree, monkeypatch):
    path = tree / ".local/pii-map.json"
    mapstore.save_payload(path, {"counters": {}}, mapstore.KeyStore(tree))
    monkeypatch.delenv(mapstore.ENV_KEY)
    keys = mapstore.KeyStore(tree, default=tree.parent / "none.key")
    before = path.read_text()
    with pytest.raises(mapstore.MapError):
        mapstore.save_payload(path, {}, keys)
    assert path.read_text() == before and mapstore.load_payload(path, keys) == ({}, "unavailable")
    monkeypatch.setenv(mapstore.ENV_KEY_FILE, str(tree / "k.key"))
    with pytest.raises(mapstore.MapError):
        keys.key()


def test_migrate_and_roll_back(tree):
    path, keys = tree / "m.json", mapstore.KeyStore(tree)
    assert mapstore.migrate(path, keys) == "missing"
    path.write_text('{"emails": {"a@b.co": "user_001@example.test"}}')
    assert mapstore.migrate(path, keys) == "migrated" and mapstore.migrate(path, keys) == "already_encrypted"
    mapstore.roll_back(path)
    assert mapstore.load_payload(path, keys)[1] == "plaintext"


def test_payload_round_trip(spark):
    data = {"counters": {"email": 4}, "emails": {"A@b.co": "user_004@example.test"}, "names": {"Sam": "PERSON_001"}}
    back = mapstore.table_to_payload(mapstore.payload_to_table(spark, data))
    assert back["emails"] == {"a@b.co": "user_004@example.test"} and back["counters"]["email"] == 4 and back["names"] == data["names"]


def test_targets_and_manifest(tmp_path):
    assert staging.promote_target("STRY7", tmp_path).name == "intake-clean"
    for bad in ("/abs", "../x", "inbox/x", ".local", ""):
        with pytest.raises(ValueError):
            staging.promote_target(bad, tmp_path)
    m = staging.Manifest(tmp_path)
    (tmp_path / "inbox/clean").mkdir(parents=True)
    for n in "ab":
        (tmp_path / f"inbox/clean/{n}").write_text(n)
    m.record([tmp_path / "inbox/clean"])
    assert m.retain_clean({"inbox/clean/a"}) == 1 and m.drop_clean() == 1 and m.read() == {}


def test_commit_gate(spark, tmp_path):
    assert commit_gate.denied_paths([".env", "a/x.key", "inbox/raw/a", "inbox/clean/.gitkeep", "ok.md"]) == [".env", "a/x.key", "inbox/raw/a"]
    git = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    assert commit_gate.gate(spark, tmp_path)[0] == 0
    (tmp_path / "src/stories").mkdir(parents=True)
    (tmp_path / "src/stories/a.md").write_text("x@corp.example")
    git("add", ".")
    code, summary = commit_gate.gate(spark, tmp_path)
    assert code == 1 and summary["hits_by_kind"] == {"email": 1}
    assert "unset" in commit_gate.hooks_warning(tmp_path)
    assert commit_gate.gate(spark, tmp_path / "none")[0] == 2


def test_sql_functions(spark):
    register(spark)
    rows = spark.sql("select t.* from (select 'mail a@b.co NL91ABNA0417164300' as x) d, lateral find_pii(d.x) t").collect()
    assert [tuple(r) for r in rows] == [("email", "a@b.co", 5, 11), ("iban", "NL91ABNA0417164300", 12, 30)]
    assert spark.sql("select iban_ok('NL91ABNA0417164300') as a, is_pii_token(null) as b").first()[:] == (True, False)


def test_stream(spark, tmp_path):
    src, state = tmp_path / "in", tmp_path / "state"
    for n, text in enumerate(("one a@b.co", "two A@B.co c@d.co")):
        spark.createDataFrame([(1, text)], "file_ord long, text string").coalesce(1).write.mode("append").parquet(str(src))
        intake.start(spark.readStream.schema("file_ord long, text string").parquet(str(src)), str(state)).awaitTermination(120)
        got = spark.read.parquet(f"{state}/documents/batch={n}").select(F.col("text")).first()[0]
        assert got == ("one user_001@example.test", "two user_001@example.test user_002@example.test")[n]


def test_a_dry_run_promotes_nothing(spark, tmp_path, capsys):
    from palimpsest import cli

    (tmp_path / "inbox" / "raw").mkdir(parents=True)
    clean = tmp_path / "inbox" / "clean"
    clean.mkdir()
    (clean / "a.md").write_text("fine")
    manifest = staging.Manifest(tmp_path)
    manifest.record([clean / "a.md"])
    before = manifest.read()
    args = ["--root", str(tmp_path), "--promote-to", "out"]
    assert cli.main([*args, "--dry-run"], spark) == 0 and "dry-run" in capsys.readouterr().out
    assert (clean / "a.md").exists() and not (tmp_path / "out").exists() and manifest.read() == before
    assert cli.main([*args, "--keep-clean"], spark) == 0 and (clean / "a.md").exists() and (tmp_path / "out" / "a.md").exists()
    manifest.record([clean / "a.md"])
    (clean / "b.md").write_text("not in the manifest")
    assert cli.main(args, spark) == 2 and (clean / "a.md").exists()
    (clean / "b.md").unlink()
    assert cli.main(args, spark) == 0 and not (clean / "a.md").exists()
    assert cli.main([*args, "--dry-run"], spark) == 2  # nothing is staged


def test_commit_gate_reads_named_files_and_settings(spark, tmp_path, capsys):
    import subprocess

    def git(*a):
        subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    story = tmp_path / "src" / "stories" / "S"
    (story / "source-export").mkdir(parents=True)
    (story / "t.conf").write_text("write to someone@corp.example")  # no text suffix, but named
    (story / "x.pdf").write_text("other@corp.example")
    (story / "source-export" / "e.md").write_text("third@corp.example")
    (tmp_path / "inbox" / "clean").mkdir(parents=True)
    (tmp_path / "inbox" / "clean" / ".gitkeep").write_text("")
    git("add", "-f", ".")
    (tmp_path / "inbox" / "clean" / ".gitkeep").unlink()  # staged, gone from the tree: empty
    assert commit_gate.main(["--root", str(tmp_path)], spark) == 1
    shown = capsys.readouterr()
    assert '"files": 1' in shown.out and '"hits": 1' in shown.out and "hooksPath" in shown.err
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "pii-allowlist.txt").write_text("someone@corp.example\n")
    assert commit_gate.main(["--root", str(tmp_path)], spark) == 0
