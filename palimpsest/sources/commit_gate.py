"""The gate in front of a commit: refused paths, then a detect-only run over the index.

``python -m palimpsest.sources.commit_gate --root TREE`` runs it with the tree's allowlist,
organisations, person fields and map, as a detect-only run of the command line does.
"""

from __future__ import annotations

import argparse
import fnmatch
import json
import re
import subprocess
import sys
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators.options import Options
from .files import decode


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\Z", r"\z").replace("(?s:", "(?s:")


def denied(path: Column, empty_placeholder: Column | None = None) -> Column:
    """Whether a staged path is refused: quarantined payload, or a name that keys and maps have."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    quarantined = F.lit(False)
    for prefix in X.QUARANTINE:
        quarantined = quarantined | path.startswith(prefix)
    placeholder = (name == ".gitkeep") & (F.lit(True) if empty_placeholder is None else empty_placeholder)
    out = quarantined & ~placeholder
    for pattern in X.DENIED_GLOBS:
        out = out | path.rlike(f"^{_glob(pattern)}") | name.rlike(f"^{_glob(pattern)}")
    return out


def is_story(path: Column) -> Column:
    from .files import is_export_path

    return path.startswith(X.STORIES) & ~is_export_path(path)


def denied_paths(paths: list[str], empty: set[str] | None = None) -> list[str]:
    """The same on the driver, for a handful of staged paths."""
    out = []
    for p in paths:
        norm = p.replace("\\", "/")
        name = PurePosixPath(norm).name
        quarantined = norm.startswith(tuple(X.QUARANTINE)) and not (name == ".gitkeep" and (empty is None or p in empty))
        if quarantined or any(fnmatch.fnmatchcase(norm, g) or fnmatch.fnmatchcase(name, g) for g in X.DENIED_GLOBS):
            out.append(p)
    return out


def staged_paths(root: Path) -> list[str]:
    """Added, copied, changed and renamed paths of the index."""
    raw = subprocess.run(["git", "diff", "--cached", "--name-only", "--diff-filter=ACMR", "-z"], cwd=root, capture_output=True, check=True).stdout
    return [p for p in raw.decode("utf-8", "surrogateescape").split("\0") if p]


def read_index(spark: SparkSession, root: Path, paths: list[str]) -> DataFrame:
    """path, content and text of the index's blobs; nothing is written to disk."""
    blobs = [(i, p, bytearray(subprocess.run(["git", "show", f":{p}"], cwd=root, capture_output=True, check=True).stdout)) for i, p in enumerate(paths)]
    return spark.createDataFrame(blobs, "file_ord long, rel_path string, content binary").withColumn("text", decode(F.col("content")))


def hooks_warning(root: Path, wanted: str = ".githooks") -> str | None:
    """A hint if the repository's hooks are not the ones that run this gate."""
    got = subprocess.run(["git", "config", "--get", "core.hooksPath"], cwd=root, capture_output=True, text=True).stdout.strip()
    return None if got.replace("\\", "/").rstrip("/").endswith(wanted) else f"core.hooksPath is {got or 'unset'}, not {wanted}: the gate does not run on commit"


def scanned(path: Column) -> Column:
    """Whether a staged path is scanned: a story's file of any suffix but the binary ones, as files named by hand are."""
    from .files import suffix_of

    return is_story(path) & ~suffix_of(path).isin(X.BINARY_SUFFIXES)


def _empty(path: Path) -> bool:
    """Whether a staged placeholder holds nothing; one that is gone from the tree holds nothing."""
    return not path.is_file() or not path.read_bytes().strip()


def gate(spark: SparkSession, root: Path, options: Options = Options(), pii_map: DataFrame | None = None) -> tuple[int, dict]:
    """Exit code and summary: 1 for refused paths or findings, 2 if git fails, else 0."""
    from ..operators.reports import gate_summary
    from ..operators.scrub import scrub

    try:
        paths = staged_paths(root)
        empty = {p for p in paths if PurePosixPath(p).name == ".gitkeep" and _empty(root / p)}
        if bad := denied_paths(paths, empty):
            return 1, {"denied": bad}
        stories = [p for p in paths if p.startswith(X.STORIES) and not any(d in PurePosixPath(p).parts for d in X.EXPORT_DIRS)]
        stories = [p for p in stories if PurePosixPath(p).suffix.lower() not in X.BINARY_SUFFIXES]
        if not stories:
            return 0, {"files": 0}
        docs = read_index(spark, root, stories)
    except (OSError, subprocess.CalledProcessError) as e:
        return 2, {"error": re.sub(r"\s+", " ", str(e))}
    run = scrub(docs, pii_map, options)
    summary = {"mode": "gate", "files": len(stories), **gate_summary(run.hits, run.residuals)}
    return int(summary["hits"] > 0 or summary["high_confidence"] > 0), summary


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The gate over a tree's index, with the tree's own settings; its summary is printed."""
    from .. import cli
    from . import mapstore

    p = argparse.ArgumentParser(prog="palimpsest-gate", description=__doc__)
    p.add_argument("--root", default=".")
    root = Path(p.parse_args(argv).root).resolve()
    if hint := hooks_warning(root):
        print(f"warning: {hint}", file=sys.stderr)
    a = cli.parser().parse_args([])
    spark = spark or SparkSession.builder.appName("palimpsest-gate").getOrCreate()
    try:
        payload = mapstore.load_payload(root / a.map, mapstore.KeyStore(root))[0]
    except mapstore.MapError:
        payload = {}  # a detect-only run goes on without the map
    code, summary = gate(spark, root, cli.options_of(a, spark, root), mapstore.payload_to_table(spark, payload))
    print(json.dumps(summary, indent=2))
    return code


if __name__ == "__main__":
    sys.exit(main())
