"""Checksum-verified staging: the manifest, promotion, pruning and clearing."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# --- as tables ----------------------------------------------------------------------------------
def is_intake_output(rel_path: Column) -> Column:
    """Under the clean staging folder or any folder of promoted files; placeholders aside."""
    low = F.lower(rel_path)
    inside = (low == "inbox/clean") | low.startswith("inbox/clean/") | F.concat(F.lit("/"), low, F.lit("/")).contains("/intake-clean/")
    return inside & (F.element_at(F.split(low, "/"), -1) != ".gitkeep")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def verified(staging: DataFrame, manifest: DataFrame) -> DataFrame:
    """Staged files (rel_path, sha256) whose checksum the manifest has."""
    return staging.join(manifest.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_semi")


def to_prune(staging: DataFrame, written: DataFrame) -> DataFrame:
    """Staged files that this run did not write; placeholders stay."""
    kept = F.element_at(F.split("rel_path", "/"), -1) != ".gitkeep"
    return staging.filter(kept).join(written.select("rel_path"), "rel_path", "left_anti")


def upsert(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """The manifest with new checksums in place of old ones."""
    rest = manifest.join(written.select("rel_path"), "rel_path", "left_anti")
    new = written.filter(F.element_at(F.split("rel_path", "/"), -1) != ".gitkeep").select(*manifest.columns)
    return rest.unionByName(new)


def retain(manifest: DataFrame, keep: DataFrame) -> DataFrame:
    """Staging keys only where this run wrote them; others untouched."""
    staged = F.lower("rel_path").startswith("inbox/clean/")
    kept = manifest.filter(staged).join(keep.select("rel_path"), "rel_path", "left_semi")
    return manifest.filter(~staged).unionByName(kept.select(*manifest.columns))


def story_target(spec: Column) -> Column:
    """Where a story's files go; null for anything else."""
    return F.when(spec.rlike(r"(?i)^(STORY-[0-9]+|STRY[0-9]+)$"), F.concat(F.lit("src/stories/"), spec, F.lit("/intake-clean")))


# --- as files -------------------------------------------------------------------------------------
class Manifest:
    """rel_path -> sha256 of what was written, in one JSON file."""

    def __init__(self, root: Path, path: Path | None = None) -> None:
        self.root, self.path = root.resolve(), path or root / ".local" / "intake-manifest.json"

    def read(self) -> dict[str, str]:
        try:
            data = json.loads(self.path.read_text(encoding="utf-8"))
            return {k: v["sha256"] for k, v in data["files"].items()}
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return {}

    def _write(self, files: dict[str, str]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        data = {"version": 1, "files": {k: {"sha256": v} for k, v in sorted(files.items())}, "written_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
        part = self.path.with_name(self.path.name + ".tmp")
        part.write_text(json.dumps(data, indent=2) + "\n", encoding="utf-8")
        part.replace(self.path)

    def key(self, path: Path) -> str | None:
        path = path.resolve()
        return path.relative_to(self.root).as_posix() if path.is_relative_to(self.root) else None

    def record(self, paths: Iterable[Path]) -> None:
        """Checksums of files, folders in full, in one write."""
        files = [f for p in paths for f in (p.rglob("*") if p.is_dir() else [p]) if f.is_file() and f.name != ".gitkeep"]
        new = {k: hashlib.sha256(f.read_bytes()).hexdigest() for f in files if (k := self.key(f))}
        self._write(self.read() | new)

    def is_verified(self, path: Path) -> bool:
        key = self.key(path)
        return bool(key) and path.is_file() and self.read().get(key) == hashlib.sha256(path.read_bytes()).hexdigest()

    def drop_clean(self) -> int:
        old = self.read()
        new = {k: v for k, v in old.items() if not k.lower().startswith("inbox/clean/")}
        if len(new) < len(old):
            self._write(new)
        return len(old) - len(new)

    def retain_clean(self, keep: set[str]) -> int:
        old = self.read()
        new = {k: v for k, v in old.items() if not k.lower().startswith("inbox/clean/") or k in keep}
        if len(new) < len(old):
            self._write(new)
        return len(old) - len(new)


def staged_files(clean: Path) -> list[Path]:
    return sorted(p for p in clean.rglob("*") if p.is_file() and p.name != ".gitkeep") if clean.is_dir() else []


def promote_target(spec: str, root: Path) -> Path:
    """A story's folder, or a folder of the tree outside of the inbox and the local one."""
    if re.fullmatch(r"STORY-\d+|STRY\d+", spec, re.IGNORECASE):
        return root / "src" / "stories" / spec / "intake-clean"
    target = (root / spec).resolve()
    parts = target.relative_to(root.resolve()).parts if target.is_relative_to(root.resolve()) else ()
    if Path(spec).is_absolute() or not parts or parts[0].lower() in ("inbox", ".local"):
        raise ValueError(f"not a folder of the tree outside inbox and .local: {spec}")
    return target


def verified_files(clean: Path, manifest: Manifest) -> tuple[list[Path], list[Path]]:
    """Staged files whose checksum the manifest has, and the others."""
    known, split = manifest.read(), ([], [])
    for f in staged_files(clean):
        split[known.get(manifest.key(f) or "") != hashlib.sha256(f.read_bytes()).hexdigest()].append(f)
    return split


def promote(clean: Path, target: Path, manifest: Manifest, replace: bool = False, all_verified: bool = False) -> tuple[int, int]:
    """Copy verified staged files; returns how many were copied and how many passed over."""
    good, bad = verified_files(clean, manifest)
    if not good and not bad:
        raise ValueError("nothing is staged")
    if not good or all_verified and bad:
        raise ValueError(f"{len(bad)} staged files have no valid checksum")
    if replace and target.exists():
        shutil.rmtree(target)
    for f in good:
        dest = target / f.relative_to(clean)
        dest.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(f, dest)
    return len(good), len(bad)


def prune(clean: Path, keep: set[Path]) -> int:
    """Delete staged files that are not kept, and folders that are then empty."""
    gone = [f for f in staged_files(clean) if f.resolve() not in keep]
    for f in gone:
        f.unlink()
    for d in sorted((p for p in clean.rglob("*") if p.is_dir()), reverse=True):
        if not any(d.iterdir()):
            d.rmdir()
    return len(gone)


def clear(clean: Path) -> int:
    return prune(clean, set()) if clean.is_dir() else 0


__all__ = ["Manifest", "promote", "promote_target", "prune", "clear", "staged_files"]
