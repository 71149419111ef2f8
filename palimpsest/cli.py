"""Command line: scrub a drop folder into staging, gate, promote, and keep the map."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass
from pathlib import Path

from .functions import fixed as X
from .operators.options import Options, PersonFields
from .sources import files, mapstore, staging
from .sources.mapstore import KeyStore, MapError

SWITCHES = "dry-run report summary per-file-summary fail-on-prose-damage also-ip also-machines also-paths also-commands also-certificates also-technical also-sn-export also-nl-id harvest-single-token irreversible map-prune-unused map-migrate map-rollback fail-on-hits force-path in-place replace-target allow-skipped-binary clear-clean fail-on-leftover-clean keep-raw keep-clean".split()
TOGGLES = {"agent-safe": True, "also-p2": True, "ner": False, "expand-name-parts": True, "scrub-orgs": True, "map-audit": False, "harvest-names": True}
VALUES = {"out": "", "map": ".local/pii-map.json", "allowlist": "config/pii-allowlist.txt", "org-list": "config/pii-org-scrub.txt", "promote": "", "promote-to": "", "person-fields": "config/pii-person-fields.json", "ner-config": "config/pii-ner.json"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("paths", nargs="*")
    p.add_argument("--root", default=".", help="the tree that relative paths refer to")
    for name in SWITCHES:
        p.add_argument(f"--{name}", action="store_true")
    for name, default in TOGGLES.items():
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)
    for name, default in VALUES.items():
        p.add_argument(f"--{name}", default=default)
    return p


def conflict(a: argparse.Namespace, explicit_agent_safe: bool) -> str | None:
    """Why these options can't go together; None if they can."""
    gate = [n for n in ("report", "in_place", "promote", "promote_to", "clear_clean", "out") if getattr(a, n)]
    if a.summary and gate:
        return f"--summary only detects: not with --{gate[0].replace('_', '-')}"
    if a.per_file_summary and a.report:
        return "--per-file-summary shows counts only: not with --report"
    if explicit_agent_safe and a.agent_safe and a.report:
        return "--agent-safe shows counts only: not with --report"
    if a.in_place and (a.out or a.promote or a.promote_to):
        return "--in-place writes nowhere else: not with --out, --promote or --promote-to"
    if a.promote and a.promote_to:
        return "one of --promote and --promote-to"
    if a.clear_clean and (a.promote or a.promote_to or a.out or a.in_place):
        return "--clear-clean stands alone"
    if a.irreversible and a.map_prune_unused:
        return "--irreversible keeps no map to prune"
    return None


def options_of(a: argparse.Namespace, spark, root: Path) -> Options:
    o = Options(
        allowlist=files.load_allowlist(spark, root / a.allowlist), orgs=files.load_orgs(spark, root / a.org_list) if a.scrub_orgs else (),
        ip=a.also_ip, machines=a.also_machines, paths=a.also_paths, commands=a.also_commands, certificates=a.also_certificates, nl_id=a.also_nl_id,
        p2=a.also_p2, harvest_names=a.harvest_names, single_token_names=a.harvest_single_token, expand_name_parts=a.expand_name_parts,
        scrub_orgs=a.scrub_orgs, recognise=a.ner, ner_config=str(root / a.ner_config), irreversible=a.irreversible, fields=PersonFields.load(root / a.person_fields),
    )
    return o.technical() if a.also_technical or a.also_sn_export else o


@dataclass
class Tree:
    """The folders of a tree."""

    root: Path

    @property
    def raw(self) -> Path:
        return self.root / "inbox" / "raw"

    @property
    def clean(self) -> Path:
        return self.root / "inbox" / "clean"

    def within(self, path: Path, folder: Path) -> bool:
        return path.resolve().is_relative_to(folder.resolve())

    def destination(self, src: Path, a: argparse.Namespace, n_files: int) -> Path:
        inside = self.within(src, self.raw)
        rel = src.resolve().relative_to(self.raw.resolve()) if inside else Path(src.name)
        if a.in_place:
            return src
        if not a.out:
            return self.clean / rel
        out = self.root / a.out
        return out if n_files == 1 and (out.suffix or not out.exists() or out.is_file()) else out / rel


def _fail(message: str, code: int = 2) -> int:
    print(f"error: {message}", file=sys.stderr)
    return code


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code: 0 fine, 1 findings that a gate refuses, 2 wrong use."""
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    tree, keys = Tree(Path(a.root).resolve()), KeyStore(Path(a.root))
    map_path, manifest = tree.root / a.map, staging.Manifest(tree.root)
    try:
        if a.map_rollback:
            mapstore.roll_back(map_path)
            print("map rolled back")
            return 0
        if a.map_migrate:
            print(f"map {mapstore.migrate(map_path, keys)}")
            return 0
    except MapError as e:
        return _fail(str(e))
    if why := conflict(a, "--agent-safe" in argv):
        return _fail(why)
    detect_only = a.dry_run or a.summary or a.per_file_summary
    a.fail_on_hits = a.fail_on_hits or a.summary
    if a.clear_clean:
        n = len(staging.staged_files(tree.clean))
        if a.dry_run:
            print(f"clear_clean=dry-run would_delete={n}")
        else:
            print(f"deleted_clean={staging.clear(tree.clean)} dropped_manifest={manifest.drop_clean()}")
        return 0
    targets = [tree.root / p for p in a.paths] or ([] if a.summary else [tree.raw])
    if not targets:
        return _fail("the gate needs paths under src/stories")
    if missing := [str(p) for p in targets if not p.exists()]:
        return _fail(f"no such path: {missing[0]}")
    stories = tree.root / X.STORIES
    if a.summary and not all(tree.within(p, stories) for p in targets):
        return _fail("the gate takes paths under src/stories only")
    if not (a.force_path or a.in_place or a.summary or a.per_file_summary) and not all(tree.within(p, tree.raw) for p in targets):
        return _fail("paths must lie under inbox/raw (or say --force-path or --in-place)")
    listing = files.list_files(targets)
    if not listing.files:
        return _nothing(a, listing, tree, manifest)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    return _run(a, spark, tree, keys, map_path, manifest, listing, detect_only)


def _nothing(a, listing: files.Listing, tree: Tree, manifest: staging.Manifest) -> int:
    """No text file: adopt what is staged, or say what was passed over."""
    if a.promote or a.promote_to:
        try:
            target = staging.promote_target(a.promote or a.promote_to, tree.root)
            good, bad = staging.verified_files(tree.clean, manifest)
            if bad or not good:
                return _fail(f"{len(bad)} staged files have no valid checksum" if bad else "nothing is staged")
            if a.dry_run:
                print(f"promote=dry-run staging={len(good)} verified={len(good)} (would copy, then clear staging)")
                return 0
            staging.promote(tree.clean, target, manifest, a.replace_target, all_verified=True)
        except ValueError as e:
            return _fail(str(e))
        manifest.record([target])
        manifest.drop_clean()
        if a.keep_clean:
            print(f"promoted={len(good)} verified={len(good)} keep_clean=1")
        else:
            print(f"deleted_clean={staging.clear(tree.clean)} promoted={len(good)} verified={len(good)}")
        return 0
    if listing.skipped_export and not listing.skipped_binary:
        return _fail("all paths lie in export folders")
    print(f"processed=0 skipped_binary={listing.skipped_binary} skipped_export={listing.skipped_export}", file=sys.stderr)
    return 2 if a.summary else 0


def _run(a, spark, tree: Tree, keys: KeyStore, map_path: Path, manifest: staging.Manifest, listing: files.Listing, detect_only: bool) -> int:
    from pyspark.sql import functions as F

    from .operators import allocate, reports
    from .operators.scrub import scrub

    try:
        payload, map_status = ({}, "irreversible") if a.irreversible else mapstore.load_payload(map_path, keys)
    except MapError as e:
        if not detect_only:
            return _fail(str(e))
        payload, map_status = {}, "unavailable"
    if map_status == "unavailable" and not detect_only:
        return _fail("the map can't be read: without its key nothing is written")
    docs = files.read_documents(spark, listing, tree.root)
    run = scrub(docs, mapstore.payload_to_table(spark, payload), options_of(a, spark, tree.root))
    summary = reports.gate_summary(run.hits, run.residuals)
    damage = reports.prose_damage(run.hits, run.documents).first().asDict()
    poison = allocate.poison_count(run.pii_map).first()[0]
    damage |= {"map_poison_keys": poison, "total": damage["total"] + poison}
    ner = reports.ner_status(run.documents).first()[0]
    facts = {"files": len(listing.files), "skipped_export": listing.skipped_export, "skipped_binary": listing.skipped_binary, "dry_run": detect_only, "ner": ner, "map": map_status}
    if a.fail_on_prose_damage and damage["total"]:
        return _fail("prose was damaged: " + " ".join(f"{k}={v}" for k, v in damage.items() if v), 1)
    if summary["high_confidence"] and not detect_only:
        return _fail(f"residual high-confidence values: {summary['high_confidence']}; nothing is written", 1)
    leftover = 0
    if not detect_only:
        # nothing was written before this point: texts, then the map, the manifest, and last the raw files go
        sources = {i: Path(p) for i, (p, _) in enumerate(listing.files)}
        dests = {i: tree.destination(p, a, len(sources)) for i, p in sources.items()}
        names = spark.createDataFrame([(i, str(p)) for i, p in dests.items()], "file_ord long, dest string")
        files.write_named(run.documents.join(F.broadcast(names), "file_ord"), "/")  # a row a listed file
        pii_map = allocate.prune(run.pii_map, run.hits) if a.map_prune_unused else run.pii_map
        if not a.irreversible:
            try:
                if map_status == "plaintext":
                    mapstore.keep_old_form(map_path)
                mapstore.save_payload(map_path, mapstore.table_to_payload(pii_map), keys)
            except MapError as e:
                return _fail(str(e))
        if a.map_audit:
            mapstore.append_audit(map_path.parent / "pii-map-audit.jsonl", "irreversible" if a.irreversible else "save", map_path, {"hits": summary["hits"], "wrote": len(dests)})
        staged = {d.resolve() for d in dests.values() if tree.within(d, tree.clean)}
        manage = not a.keep_clean and not a.in_place
        if manage and staged:
            staging.prune(tree.clean, staged)
        if not a.in_place:
            manifest.record(dests.values())
        if a.promote or a.promote_to:
            if listing.skipped_binary and not a.allow_skipped_binary:
                return _fail(f"skipped_binary={listing.skipped_binary}: not promoted")
            try:
                target = staging.promote_target(a.promote or a.promote_to, tree.root)
                staging.promote(tree.clean, target, manifest, a.replace_target)
            except ValueError as e:
                return _fail(str(e))
            manifest.record([target])
        if not a.keep_raw and not a.in_place:
            for i, p in sources.items():
                if tree.within(p, tree.raw) and p.resolve() != dests[i].resolve():
                    try:
                        p.unlink(missing_ok=True)
                        facts["deleted_raw"] = facts.get("deleted_raw", 0) + 1
                    except OSError as e:  # what is written stays good; the file is told and counted
                        facts["delete_raw_failures"] = facts.get("delete_raw_failures", 0) + 1
                        print(f"warning: {p.name} was not deleted: {e.strerror}", file=sys.stderr)
        if manage and (a.promote or a.promote_to):
            staging.clear(tree.clean)
            manifest.drop_clean()
        elif manage and staged:
            manifest.retain_clean({manifest.key(d) for d in staged})
        leftover = len(staging.staged_files(tree.clean)) if manage else 0
    _print(a, run, summary, damage, facts, listing)
    if summary["high_confidence"] or a.fail_on_hits and summary["hits"]:
        return 1
    return 2 if a.fail_on_leftover_clean and leftover else 0


def _print(a, run, summary: dict, damage: dict, facts: dict, listing: files.Listing) -> None:
    from .operators import reports

    residual = {k: v for k, v in summary.items() if k.startswith("residual_")}
    if a.report:  # the one report that shows values, asked for by name
        hits = [r.asDict() for r in run.hits.orderBy("file_ord", "seq").toLocalIterator()]
        print(json.dumps({**facts, "hits": hits, "residual": residual}, indent=2, ensure_ascii=False))
    elif a.per_file_summary:
        rows = []
        for r in reports.per_file_summary(run.hits, run.residuals).toLocalIterator():
            rows.append({"file": listing.files[r["file_ord"]][0], "hits": r["hits"], "hits_by_kind": r["hits_by_kind"], **({"residual": r["residual"]} if r["residual"] else {})})
        print(json.dumps({"mode": "per_file_summary", **facts, "hits": summary["hits"], "residual": residual, "by_file": rows}, indent=2))
    elif a.summary:
        print(json.dumps({"mode": "gate", **facts, **summary, "prose_damage": {k: v for k, v in damage.items() if v}}, indent=2))
    else:
        print(" ".join(f"{k}={v}" for k, v in {"processed": facts["files"], "hits": summary["hits"], "residual": summary["high_confidence"], **{k: v for k, v in facts.items() if k != "files"}, **{k: v for k, v in residual.items() if v}}.items()))


if __name__ == "__main__":
    sys.exit(main())
