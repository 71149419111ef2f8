"""Files as documents: listing on the driver, reading on the executors, named outputs.

Spark's own file source passes over names that begin with ``_`` or ``.``, which here would
leave personal data unseen; so paths are listed first and read as bytes by name.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X

PATHS = "file_ord long, path string, rel_path string, suffix string, explicit boolean"


@dataclass
class Listing:
    """What a scan found: files in order, and how many it passed over."""

    files: list[tuple[str, bool]] = field(default_factory=list)
    skipped_export: int = 0
    skipped_binary: int = 0


def is_export(path: Path) -> bool:
    """Whether any part of the resolved path is an export folder."""
    return any(p in X.EXPORT_DIRS for p in path.resolve().parts)


def list_files(targets: Iterable[str | Path]) -> Listing:
    """Files of folders and single files, in order of path components, each once."""
    out, seen = Listing(), set()
    for target in map(Path, targets):
        single = target.is_file()
        for p in [target] if single else sorted(x for x in target.rglob("*") if x.is_file()):
            if not single and p.name == ".gitkeep":
                continue
            real = p.resolve()
            if real in seen:
                continue
            if is_export(p):
                seen.add(real)
                out.skipped_export += 1
            elif p.suffix.lower() in X.BINARY_SUFFIXES:
                seen.add(real)
                out.skipped_binary += 1
            elif single or not p.suffix or p.suffix.lower() in X.TEXT_SUFFIXES:
                seen.add(real)
                out.files.append((str(p), single))
    return out


def decode(content: Column) -> Column:
    """UTF-8, invalid bytes replaced, line ends as line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def read_documents(spark: SparkSession, listing: Listing, root: str | Path = ".") -> DataFrame:
    """file_ord, path, rel_path, suffix, explicit, content and text; files are read by the executors."""
    root = Path(root).resolve()

    def rel(p: str) -> str:
        q = Path(p).resolve()
        return q.relative_to(root).as_posix() if q.is_relative_to(root) else q.as_posix()

    rows = [(i, p, rel(p), Path(p).suffix.lower(), single) for i, (p, single) in enumerate(listing.files)]
    paths = spark.createDataFrame(rows, PATHS).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                data = Path(row.column(1)[0].as_py()).read_bytes()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*b.schema.names, "content"])

    return paths.mapInArrow(read, PATHS + ", content binary").withColumn("text", decode(F.col("content")))


# --- listings as tables, for the same decisions on any scale ---------------------------------
def is_export_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in X.EXPORT_DIRS]))


def suffix_of(path: Column) -> Column:
    """The suffix as path libraries see it: none for names that only begin with a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def scan_filter(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Each path with what the scan does with it: keep, export, binary, placeholder or other."""
    path = F.col(path_col)
    suffix = suffix_of(path)
    what = (
        F.when(F.element_at(F.split(path, "/"), -1) == ".gitkeep", "placeholder").when(is_export_path(path), "export")
        .when(suffix.isin(X.BINARY_SUFFIXES), "binary").when((suffix == "") | suffix.isin(X.TEXT_SUFFIXES), "keep").otherwise("other")
    )
    return paths.withColumn("decision", what)


def component_order(path: Column) -> Column:
    """Sorts as path components do, not as plain text."""
    return F.split(path, "/")


def mirror_path(rel_path: Column, raw_root: str = "inbox/raw", clean_root: str = "inbox/clean") -> Column:
    """Where a scrubbed file goes: beside its place under the raw root, else by its name."""
    name = F.element_at(F.split(rel_path, "/"), -1)
    inside = rel_path.startswith(raw_root + "/")
    below = F.substring(rel_path, len(raw_root) + 1, 100_000)
    return F.when(inside, F.concat(F.lit(clean_root), below)).otherwise(F.concat(F.lit(clean_root + "/"), name))


def write_named(documents: DataFrame, root: str | Path, dest_col: str = "dest", text_col: str = "text") -> list[str]:
    """Each text to its own file under ``root``, UTF-8 with line feeds; returns the names.

    A file is written beside its place and renamed, so a task that runs again leaves whole
    files. ``root`` must be a folder that all executors share.
    """
    root = str(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = Path(root, dest)
                path.parent.mkdir(parents=True, exist_ok=True)
                part = path.with_name(f".{path.name}.{os.getpid()}.part")
                part.write_bytes((text or "").encode("utf-8"))
                part.replace(path)
            yield b.select([names[0]])

    names = [dest_col, text_col]
    done = documents.select(*names).mapInArrow(write, f"{dest_col} string")
    return sorted(r[0] for r in done.collect())


# --- small line files -------------------------------------------------------------------------
def _lines(spark: SparkSession, path: str | Path) -> DataFrame | None:
    if "://" not in str(path) and not Path(path).is_file():
        return None
    rows = spark.read.text(str(path), wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return rows.select("line_no", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def load_allowlist(spark: SparkSession, path: str | Path) -> frozenset[str]:
    """Lower-cased lines, comments aside; none where the file is missing."""
    rows = _lines(spark, path)
    return frozenset() if rows is None else frozenset(r[0] for r in rows.select(F.lower("line")).distinct().collect())


def load_orgs(spark: SparkSession, path: str | Path) -> tuple[str, ...]:
    """Lines in order; of spellings that differ by case the first."""
    rows = _lines(spark, path)
    if rows is None:
        return ()
    firsts = rows.groupBy(F.lower("line").alias("low")).agg(F.min(F.struct("line_no", "line")).alias("f"))
    return tuple(r["line"] for r in sorted(firsts.select("f.*").collect()))
