"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, every run of other ASCII than 0-9 and a-z one
space). Each window of ``n`` consecutive item words becomes a pattern between spaces;
an item of fewer words, but at least one, is a single pattern. A document's normalised
form is scanned once; hits are mapped back to word numbers and to offsets in the
original text.

Defined results: null or empty text has no words and is not contaminated; repeated
benchmark rows count once for each distinct item id; rows without an item id are not
items; an empty benchmark hits nothing; other columns, whatever their names, are not
read.

Scale: one narrow pass over the documents, no shuffle. The benchmark's size is summed
first: up to ``slice_chars`` characters it is broadcast, and each Python worker builds and
keeps one automaton of it. A larger one is cut by the hash of the item id into slices of
about that size; the documents, written with a key for each row, are scanned once for each
slice, with one broadcast and one automaton at a time, and a document's hits meet it again
by its key. A text of any length is scanned whole; its words take some 60 bytes each while
it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stash

#: A-Z to a-z; 0-9, a-z and bytes of other scripts as they are; the rest to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")
RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int,item_id:string>>"


def words_of(text: bytes | None) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return (text or b"").translate(_FOLD).split()


def windows_of(text: bytes | None, n: int) -> set[bytes]:
    """The distinct windows of ``n`` words; one of all words where there are fewer."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class Matcher:
    """One automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        owners: dict[bytes, set[str]] = {}
        for item_id, text in items:
            for w in windows_of(text, n):
                owners.setdefault(w, set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            # bytes as latin-1: the automaton walks one character a byte
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w) + 1, w.count(b" ") + 1, tuple(sorted(ids))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, normal: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, words, item ids) for each occurrence; ``normal`` has a space at each end."""
        out: list[tuple[int, int, tuple[str, ...]]] = []
        if self.empty:
            return out
        seen, word = 0, 0
        for end, (back, n_words, ids) in self.automaton.iter(normal):
            word += normal.count(" ", seen, end)  # words closed before this end
            seen = end
            out.append((word - n_words, n_words, ids))
        return out


Hit = tuple[int, int, tuple[str, ...]]


def scan_text(text: bytes | None, matchers: list[Matcher], spans: bool = True) -> tuple[int, int, list[str], list]:
    """Words, hit words, sorted item ids and the hits' character spans in the original."""
    words = words_of(text)
    return summary(text, words, hits_of(words, matchers), spans)


def hits_of(words: list[bytes], matchers: list[Matcher]) -> list[Hit]:
    """Where windows occur among the words of a text."""
    normal = f" {b' '.join(words).decode('latin-1')} "
    return [hit for m in matchers for hit in m.scan(normal)] if words else []


def summary(text: bytes | None, words: list[bytes], found: list[Hit], spans: bool) -> tuple[int, int, list[str], list]:
    """The same as ``scan_text``, of hits that are known."""
    if not found:
        return len(words), 0, [], []
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for first, n_words, _ in found:
        edge[first] += 1
        edge[first + n_words] -= 1
    n_hit = int((np.cumsum(edge)[:-1] > 0).sum())
    ids = sorted({i for _, _, owners in found for i in owners})
    places = []
    if spans:
        at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]  # byte for byte as long as the text
        for first, n_words, owners in found:
            start = len(text[: at[first][0]].decode("utf-8"))
            stop = start + len(text[at[first][0] : at[first + n_words - 1][1]].decode("utf-8"))
            places += [{"start": start, "stop": stop, "item_id": i} for i in owners]
    return len(words), n_hit, ids, places


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_chars: int) -> list[DataFrame]:
    """Items with an id and a text, cut into tables of about ``slice_chars`` characters."""
    rows = pick(benchmark, [(item_col, "item"), (text_col, "text")]).dropna().distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_chars))
    return [rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


class _Matchers:
    """The automaton of a broadcast slice; the worker keeps the one that it used last."""

    _kept: tuple[list, int, list[Matcher]] | None = None

    def __init__(self, items: DataFrame, n: int) -> None:
        found = [(str(r["item"]), r["text"].encode("utf-8")) for r in items.collect()]  # at most a slice
        self.shared, self.n = items.sparkSession.sparkContext.broadcast(found), n

    def all(self) -> list[Matcher]:
        items, kept = self.shared.value, _Matchers._kept
        if kept is None or kept[0] is not items or kept[1] != self.n:
            # the value is held with its automaton, so that no other can take its place in memory
            _Matchers._kept = kept = (items, self.n, [Matcher(items, self.n)])
        return kept[2]


_HITS = "key long, hits array<struct<first:int,size:int,items:array<string>>>"
_HIT = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("items", pa.list_(pa.string()))]))


def _sliced_hits(keyed: DataFrame, slices: list[DataFrame], n: int) -> DataFrame:
    """key and all hits of the documents (key, text) that have any; a pass for each slice."""
    found = None
    for items in slices:
        kept = _Matchers(items, n)

        def run(batches: Iterator[pa.RecordBatch], kept: _Matchers = kept) -> Iterator[pa.RecordBatch]:
            for b in batches:
                matchers = kept.all()
                hits = [hits_of(words_of(t), matchers) for t in b.column(1).cast(pa.binary()).to_pylist()]
                mine = [k for k, h in enumerate(hits) if h]
                column = pa.array([[{"first": f, "size": s, "items": list(i)} for f, s, i in hits[k]] for k in mine], _HIT)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine, pa.int64())), column], names=["key", "hits"])

        part = stash(keyed.select("key", "text").mapInArrow(run, _HITS), "hits")
        kept.shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 8,
    spans: bool = True,
    slice_chars: int = 20_000_000,
) -> DataFrame:
    """One row per document: words, hit words, the items found and where they stand."""
    slices = _slices(benchmark, item_col, item_text_col, slice_chars)
    docs = pick(documents, [(doc_col, "doc_id"), (text_col, "text")])
    kept = None
    if len(slices) == 1:
        kept = _Matchers(slices[0], n)
    else:
        keyed = stash(docs.withColumn("key", F.monotonically_increasing_id()), "keyed")
        docs = keyed.join(_sliced_hits(keyed, slices, n), "key", "left").select("doc_id", "text", "hits")
    place = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item_id", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            if kept is not None:
                rows = [scan_text(t, kept.all(), spans) for t in texts]
            else:
                hits = [[(h["first"], h["size"], tuple(h["items"])) for h in x or []] for x in b.column(2).to_pylist()]
                rows = [summary(t, words_of(t), h, spans) for t, h in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([r[3] for r in rows], place),
                ],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return docs.mapInArrow(run, RESULT)


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_items: int = 1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 8, slice_chars: int = 20_000_000) -> DataFrame:
    """The documents, all columns, in which fewer than ``min_items`` items have windows."""
    slices = _slices(benchmark, item_col, item_text_col, slice_chars)
    if len(slices) > 1:
        keyed = documents.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
        keyed = stash(keyed.withColumn("key", F.monotonically_increasing_id()), "keyed")
        hits = _sliced_hits(keyed, slices, n).withColumn("n", F.size(F.array_distinct(F.flatten("hits.items"))))
        return keyed.join(hits.filter(F.col("n") >= min_items), "key", "left_anti").select("row.*")
    kept = _Matchers(slices[0], n)

    @F.pandas_udf("int")
    def n_items(texts: pd.Series) -> pd.Series:
        matchers = kept.all()
        found = [scan_text(t.encode("utf-8"), matchers, spans=False)[2] if t is not None else [] for t in texts]
        return pd.Series([len(x) for x in found], dtype="int32")

    return documents.filter(n_items(F.col(f"`{text_col}`")) < min_items)


def items_digest(ids: list[str]) -> str:
    """The digest of sorted ids that the query returns."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
