"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the least of its inner s-mers (by hash)
lies at its first or its last place. That depends on the k-mer alone, so a passage keeps
its anchors wherever it stands. The fingerprint is the bottom ``size`` of the distinct
anchors' hashes, 8 hex digits each in ascending order; likeness is the Jaccard estimate
from the bottom of the union of two fingerprints.

Defined results: texts without a closed syncmer (all that are shorter than a k-mer, and
some of up to about 22 characters) have a single anchor, the whole text; null
and empty texts have the empty fingerprint, whose likeness is 1 to another empty one and
0 to any other; equal texts have equal fingerprints; rows that repeat an id are each
other's neighbours, by the first 64 characters of the text and then by its hash, descending;
other columns, whatever their names, are not read. Likeness from 64 values has a standard
error of sqrt(j (1 - j) / 64), at most 0.06. A text of any length is hashed whole, which
takes some 60 bytes a character while it lasts.

Scale: fingerprints are one narrow pass. The edited texts need each document's neighbour
in descending order of id: one shuffle by ranges of the id, the text's beginning and hash and
the row's place, so that rows that repeat or lack an id are spread as well, and a stitch of
one row per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, pick, random_words, stash

K, S, SIZE = 16, 9, 64
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_START = random_words(1, 21)[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of ``width`` values, by doubling."""
    n = max(0, len(values) - width + 1)
    if not n:
        return values[:0]
    total, done = None, 0  # hash of the first ``done`` values of each run
    have, part = 1, values  # hashes of runs of ``have`` values
    while True:
        power = np.uint64(pow(int(_M), have, 2**64))
        if width & have:
            total = part[:n] if total is None else total * power + part[done : done + n]
            done += have
        have *= 2
        if have > width:
            return total
        part = part[: len(part) - have // 2] * power + part[have // 2 :]


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of a run of code points."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    values = points.astype(np.uint64) + _START
    small = mix64(_windows(values, s))
    span = k - s + 1
    # the least of each span of s-mers, by doubling
    least, have = small, 1
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: n], least[span - have : span - have + n])
    least = least[:n]
    at = np.flatnonzero((small[:n] == least) | (small[span - 1 : span - 1 + n] == least))
    return at, mix64(_windows(values, k)[at] ^ _START)


def anchors(points: np.ndarray) -> np.ndarray:
    """32-bit anchor hashes: of the syncmers, or of the text as a whole where it has none."""
    if not len(points):
        return np.empty(0, np.uint32)
    found = (syncmers(points)[1] >> np.uint64(32)).astype(np.uint32)
    return found if len(found) else whole(points)


def whole(points: np.ndarray) -> np.ndarray:
    """The one anchor of a text that has no syncmer."""
    return np.array([int.from_bytes(hashlib.blake2b(points.tobytes(), digest_size=4).digest(), "big")], np.uint32)


def bottom(values: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` least distinct values, ascending."""
    if len(values) > 8 * size:
        # enough of the smallest to hold ``size`` distinct ones, or else all
        part = np.unique(np.partition(values, 4 * size)[: 4 * size])
        if len(part) >= size:
            return part[:size]
    return np.unique(values)[:size]


def to_bytes(values: np.ndarray) -> bytes:
    return values.astype(">u4").tobytes()


def to_text(values: np.ndarray) -> str:
    return to_bytes(values).hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two anchor sets, from their bottoms."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def fingerprints(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [code_points(t or "") for t in b.column(1).to_pylist()]
            prints = [to_text(bottom(anchors(p))) for p in points]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in points], pa.int64()), pa.array(prints)], names=["doc_id", "n_chars", "fingerprint"])

    return pick(documents, [(doc_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def positions(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos and hash of every anchor, for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, h = syncmers(code_points(t or ""))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(h.view(np.int64))], names=["doc_id", "pos", "hash"])

    return pick(documents, [(doc_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, pos long, hash long")


class _Doc:
    """What a row's own fingerprint and its neighbour's edit need."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.points = code_points(self.text)
        self.at, self.hash = syncmers(self.points)
        self.hash = (self.hash >> np.uint64(32)).astype(np.uint32)
        self.print = bottom(self.hash if len(self.hash) or not len(self.points) else whole(self.points))

    def edited(self, other: _Doc) -> tuple[str, np.ndarray]:
        """The text with its last third replaced by the other's beginning, and its fingerprint.

        Anchors are context-free: those inside the kept part and inside the other's
        beginning are taken over, and only the seam is hashed again.
        """
        n = len(self.points)
        cut = n - n // 3
        text = self.text[:cut] + other.text[: n // 3]
        m = len(text) - cut
        if len(text) < K or cut < K or m < K:
            return text, bottom(anchors(code_points(text)))
        seam = syncmers(np.concatenate([self.points[cut - K + 1 : cut], other.points[: K - 1]]))[1]
        found = np.concatenate([
            self.hash[: np.searchsorted(self.at, cut - K, side="right")],
            (seam >> np.uint64(32)).astype(np.uint32),
            other.hash[: np.searchsorted(other.at, m - K, side="right")],
        ])
        return text, bottom(found if len(found) else whole(code_points(text)))


#: Digests and fingerprints travel as bytes, half as long as their text.
_OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(a: _Doc, b: _Doc) -> tuple:
    text, edited = a.edited(b)
    return (a.doc_id, len(a.points), hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), to_bytes(a.print), to_bytes(edited), likeness(a.print, edited), likeness(a.print, b.print))


def _batch(rows: list[tuple], part: int, kinds: list[str], texts: list[str | None]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int64()), pa.array(kinds), pa.array(texts, pa.string())], names=[*[x.split()[0] for x in _OUT.split(", ")], "part", "kind", "text"])


def edited_fingerprints(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, by descending doc_id, and likenesses.

    Each partition also leaves its first and its last document as edge rows; the last one's
    neighbour is the first of the next partition that has rows.
    """
    docs = pick(documents, [(doc_col, "doc_id"), (text_col, "text")])
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", F.substring("text", 1, 64).alias("lead"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = [F.col(c).desc_nulls_last() for c in ("doc_id", "lead", "hash", "place")]
    docs = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        blank = (0, b"", b"", b"", 0.0, 0.0)
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            rows, kinds, texts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = _Doc(i, t)
                if last is None:
                    rows.append((i, *blank)), kinds.append("first"), texts.append(t)
                else:
                    rows.append(_row(last, doc)), kinds.append("done"), texts.append(None)
                last = doc
            if rows:
                yield _batch(rows, part, kinds, texts)
        if last is not None:
            yield _batch([(last.doc_id, *blank)], part, ["last"], [last.text])

    made = stash(docs.mapInArrow(run, _OUT + ", part long, kind string, text string"), "syncmers", parts="kind")
    done = made.filter("kind = 'done'").select(*[x.split()[0] for x in _OUT.split(", ")])
    # partition numbers alone are ordered in one task; texts of edges are joined by number
    firsts = made.filter("kind = 'first'").select(F.col("part").alias("f_part"), F.col("doc_id").alias("f_id"), F.col("text").alias("f_text"))
    lasts = made.filter("kind = 'last'").select("part", F.col("doc_id").alias("l_id"), F.col("text").alias("l_text"))
    parts = firsts.select(F.col("f_part").alias("p"))
    w = W.partitionBy(F.lit(0)).orderBy("p")
    whole = W.partitionBy(F.lit(0)).orderBy("p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follow = parts.select("p", F.coalesce(F.lead("p").over(w), F.first("p").over(whole)).alias("f_part"))
    seams = lasts.join(follow, F.col("part") == F.col("p")).join(firsts, "f_part").select("l_id", "l_text", "f_id", "f_text")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(_Doc(i, t), _Doc(j, u)) for i, t, j, u in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(_batch(rows, 0, [""] * len(rows), [None] * len(rows)).columns[:7], names=[x.split()[0] for x in _OUT.split(", ")])

    out = done.unionByName(seams.mapInArrow(stitch, _OUT))
    return out.select(*[F.lower(F.hex(c)).alias(c) if kind == "binary" else c for c, kind in out.dtypes])


def likeness_udf():
    """A column function of two fingerprints: their likeness."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(from_text(x or ""), from_text(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")

    return f
