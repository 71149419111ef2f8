"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full sets.

1. Sketch (one narrow pass): a document's set of distinct word shingles as 64-bit hashes,
   its size, a 128-bit digest of the set, 160 minima of which 32 bands of 5 become band
   keys, and of which the low 4 bits are packed into a signature of ten 64-bit words.
2. Classes: documents of equal sets collapse, with map-side aggregation, to the one with
   the least id; only these representatives go on, so a group of copies of any size is
   one node.
3. Candidates: in each band bucket every member is paired with the bucket's least member
   (a star, linear in the bucket). With C = 2^-b chance agreement of b-bit values,
   similarity is (equal share - C) / (1 - C); pairs whose estimate lies ``slack`` below the
   threshold (over five standard deviations) are dropped. What is left hangs together in
   clusters.
4. Each member of a cluster is compared in full with the cluster's least member: whether
   they are linked, and a bitmap of the shingles of the least member that it has.
5. Buckets whose members are not all linked to the same one are then compared in blocks of
   bounded size: those outside of the bucket's commonest label with all members. By the estimate, and by an exact bound,
   as two sets share no more than the common bits of their bitmaps and the shingles that
   are in no bitmap and not in one document alone. No pair is emitted unless it passes
   both; the few that do are confirmed on their full sets, built again from the texts.
6. Components: large-star / small-star contraction, each round written to the shared
   folder.

A pair exactly at similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6,
one at 0.85 with 7e-9.

Defined results: without words (null, empty or white space) a set is empty, linked with
nothing, and the document is its own component; with fewer words than a shingle the whole
sequence is the one shingle; a row without id has no component of its own (null) and is
kept; rows that repeat an id are one node, with the links of all their texts; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stash, mix64, pick, random_words, stash, trim

BANDS, ROWS, BITS = 32, 5, 4
PERMUTATIONS = BANDS * ROWS
WORDS = PERMUTATIONS * BITS // 64
SIG = [f"s{i}" for i in range(WORDS)]
_LOW = np.uint64(0x1111111111111111)

_MUL = random_words(PERMUTATIONS, 11) | np.uint64(1)
_ADD = random_words(PERMUTATIONS, 12)
_BAND = random_words(BANDS, 13)
_BYTE = random_words(256, 14)
_BASE = int(random_words(1, 15)[0]) | 1
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of an odd base modulo 2^64, grown as longer texts come."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 2**64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def shingle_set(text: bytes | None, size: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text.

    Words are runs without ASCII white space, A-Z lower-cased, joined by one space; each
    shingle is hashed from prefix sums of a polynomial with random byte values.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _UP.upto(n)[:n], out=total[1:])
    ends = np.append(np.flatnonzero(data == 32), n)
    starts = np.append(0, ends[:-1] + 1)
    k = min(size, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    hashes = (total[last] - total[first]) * _DOWN.upto(n)[first]
    return np.unique(mix64(hashes + (last - first).astype(np.uint64)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over a non-empty set."""
    best = None
    for at in range(0, len(hashes), 2048):
        low = (_MUL[:, None] * hashes[None, at : at + 2048] + _ADD[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def pack(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima's mixed form, 16 values a word."""
    bits = (mix64(low) & np.uint64(2**BITS - 1)).reshape(WORDS, 64 // BITS)
    return (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]).sum(axis=1, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, from its minima in full."""
    key = _BAND.copy()
    for column in low.reshape(BANDS, ROWS).T:
        key = mix64(key ^ column)
    return key


def unequal_values(x: np.ndarray) -> np.ndarray:
    """How many b-bit values differ, from the exclusive or of two signatures (rows of words)."""
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & _LOW
    return np.bitwise_count(x).sum(axis=-1)


def estimate(unequal, k: int = PERMUTATIONS, bits: int = BITS):
    """Similarity from the number of unequal b-bit values, corrected for chance agreement."""
    chance = 1.0 / 2**bits
    return ((1.0 - unequal / k) - chance) / (1.0 - chance)


def most_unequal(threshold: float, slack: float) -> int:
    """Unequal values beyond which the estimate lies under threshold - slack."""
    chance = 1.0 / 2**BITS
    return int(PERMUTATIONS * (1.0 - (chance + (1.0 - chance) * (threshold - slack))))


def sketches(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, n_shingles, set digest (hi, lo), signature words and band keys."""
    schema = "doc_id long, n_shingles long, hi long, lo long, sig binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo, sig, bands = [], [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(t, shingle)
                n.append(len(s))
                if not len(s):
                    hi.append(0), lo.append(0), sig.append(None), bands.append(None)
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                hi.append(int.from_bytes(d[:8], "big", signed=True))
                lo.append(int.from_bytes(d[8:], "big", signed=True))
                low = minima(s)
                sig.append(pack(low).tobytes())
                bands.append(band_keys(low).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "hi", "lo", "sig", "bands"],
            )
        trim()

    return documents.mapInArrow(run, schema)


def _passing(pairs: DataFrame, reps: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most ``limit`` values."""
    sigs = reps.select("rep", "sig")
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), dtype=np.uint64).reshape(-1, WORDS) for i in (2, 3))
            keep = pa.array(unequal_values(x ^ y) <= limit)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Up to so many ids go to every executor (some 30 MB); more meet the documents by a shuffle.
BROADCAST_IDS = 1_000_000


def _by_id(documents: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents with (left_semi) or without (left_anti) one of these ids, a column ``doc_id``.

    While the ids are few, counted, texts stay where they are.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return documents.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _compared(pairs: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked, bits): whether 100 * intersection >= percent * union on the full sets,
    and which of a's sorted shingles b has."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = _by_id(documents, ids, "left_semi")
    # an id that stands on several rows is one node; its text is the least by hash
    texts = stash(texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("u")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()  # sets of cluster heads recur

        def of(i: int, text: pa.Scalar) -> np.ndarray:
            if i not in kept:
                kept[i] = shingle_set(text.as_py(), shingle)
                if len(kept) > 32:
                    kept.popitem(last=False)
            kept.move_to_end(i)
            return kept[i]

        for t in batches:
            x, y = t.column(2).cast(pa.binary()), t.column(3).cast(pa.binary())
            linked, bits = [], []
            for row, i in enumerate(t.column(0).to_pylist()):
                s, u = of(i, x[row]), shingle_set(y[row].as_py(), shingle)
                has = np.zeros(len(s), bool)
                has[np.intersect1d(s, u, assume_unique=True, return_indices=True)[1]] = True
                n = int(has.sum())
                linked.append(100 * n >= percent * (len(s) + len(u) - n))
                bits.append(np.packbits(has).tobytes())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(linked, pa.bool_()), pa.array(bits, pa.binary())], names=["a", "b", "linked", "bits"])
        trim()

    out = stash(both.select("a", "b", "t", "u").mapInArrow(run, "a long, b long, linked boolean, bits binary"), "compared")
    drop_stash(texts)
    return out


def _looked_up(table: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """A table of at most 2 * n keys for a join by key, and what to drop after it.

    While it is small it goes to every executor. Else it is written first, so that the join
    stands on two plain exchanges, of which adaptive execution splits a hot key's rows.
    """
    if 2 * n <= BROADCAST_IDS:
        return F.broadcast(table), None
    written = stash(table, "least")
    return written, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node it reaches.

    Alternates large-star and small-star steps until the links no longer change; each step
    is an aggregate and a join by node, and a node's links are never collected.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    check = [F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)]
    before, n = None, edges.count()
    while True:
        # large star: hang every larger neighbour on the least one
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, drop = _looked_up(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), n)
        large = edges.join(least, F.col("v") == F.col("c")).select("u", F.col("m").alias("v")).filter("u != v").distinct()
        # small star: hang the smaller neighbours and the node itself on the least
        low, drop_low = _looked_up(large.groupBy("u").agg(F.min("v").alias("m")), n)
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        new = stash(small, "edges")
        drop_stash(edges, drop, drop_low)
        edges = new
        now = tuple(edges.agg(*check).first())
        if now == before:
            break
        before, n = now, now[0]
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _own_shingles(documents: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(rep, n, own): set sizes of these documents, and how many shingles no other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingle_set(t, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(s.view(np.int64))], names=["rep", "hash"])

    some = _by_id(documents, ids.select(F.col("rep").alias("doc_id")), "left_semi").select("doc_id", "text")
    rows = some.mapInArrow(run, "rep long, hash long")
    alone = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    return alone.groupBy("rep").agg(F.count("*").alias("own"))


def _mixed_buckets(members: DataFrame, labels: DataFrame, reps: DataFrame, documents: DataFrame, shingle: int, percent: int, limit: int, block: int) -> DataFrame:
    """Pairs that share a bucket under different labels and pass the estimate and the exact bound.

    ``labels``: rep, label, head, bits. Shingles in one document alone can't be shared; of
    the others, those in the head's set are told by the bitmaps.
    """
    rows = members.join(labels.select("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    mixed = mixed.agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("m")).filter("m > n_top")
    mixed = stash(mixed.select("key", "top", F.ceil((F.col("m") - F.col("n_top")) / F.lit(block)).cast("int").alias("others"), F.ceil(F.col("n_top") / F.lit(block)).cast("int").alias("tops")), "mixed")
    rows = stash(rows.join(mixed, "key"), "mixed")
    drop_stash(mixed)
    here = rows.select("rep").distinct()
    heads = labels.join(here, "rep", "left_semi").select(F.col("head").alias("rep"))
    own = _own_shingles(documents, here.union(heads).distinct(), shingle)
    facts = reps.join(here, "rep", "left_semi").join(own, "rep", "left").join(labels.select("rep", "head", "bits"), "rep", "left")
    facts = facts.select("rep", "sig", "n_shingles", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("head", F.lit(-1)).alias("head"), F.coalesce("bits", F.lit(b"")).alias("bits"))
    # the rows of the commonest label need not meet each other, only the other rows' blocks
    top, others, tops = F.col("label") == F.col("top"), F.col("others"), F.col("tops")
    spread = F.xxhash64("rep")
    mine = F.when(top, others + F.pmod(spread, tops)).otherwise(F.pmod(spread, others)).cast("int")
    meets = F.sequence(F.lit(0), F.when(top, others).otherwise(others + tops) - 1)
    rows = rows.join(facts, "rep").withColumn("mine", mine).withColumn("other", F.explode(meets))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "label", "rep", "n_shingles", "own", "head", "sig", "bits")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for t in batches:
            cols = [t.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            cols.append(np.frombuffer(b"".join(t.column(9).to_pylist()), dtype=np.uint64).reshape(-1, WORDS))
            cols.append(np.array([*t.column(10).to_pylist(), None], dtype=object)[:-1])
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            key, i, j = cols[:3]
            same = (key == key[-1]) & (i == i[-1]) & (j == j[-1]) if len(key) else np.zeros(0, bool)
            cut = len(key) - int(same.sum())  # the last group may go on in the next batch
            held = [c[cut:] for c in cols]
            for at in _whole_groups(cols[:3], cut):
                yield from pairs([c[at] for c in cols])
        if held is not None:
            yield from pairs(held)

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, i, j, mine, label, rep, n, own, head, sig, raw = cols
        width = -(-max([1, *map(len, raw)]) // 8) * 8
        bits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), dtype=np.uint64).reshape(len(raw), -1)
        common = n - own
        rest = common - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # neither in the head's set nor alone
        step = 1
        while step < len(key):
            a, b = slice(None, -step), slice(step, None)
            group = (key[a] == key[b]) & (i[a] == i[b]) & (j[a] == j[b])
            if not group.any():
                return
            # two members of one block meet in that block's own square only
            x = np.flatnonzero(group & (label[a] != label[b]) & ((mine[a] != mine[b]) | (i[a] == j[a])))
            x = x[unequal_values(sig[x] ^ sig[x + step]) <= limit]
            x = x[(head[x] != rep[x + step]) & (head[x + step] != rep[x])]  # compared with the head already
            y = x + step
            most = np.minimum(common[x], common[y])
            told = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(rest[x], rest[y])
            most = np.where((head[x] == head[y]) & (head[x] >= 0), np.minimum(most, told), most)
            x = x[100 * most >= percent * (n[x] + n[y] - most)]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[x + step])], names=["a", "b"])
            step += 1

    return rows.mapInArrow(run, "a long, b long").distinct()


def _whole_groups(keys: list[np.ndarray], cut: int, rows: int = 2048) -> Iterator[slice]:
    """Slices of about ``rows`` rows up to ``cut`` that part no group."""
    if not cut:
        return
    change = np.flatnonzero(np.any([k[1:cut] != k[: cut - 1] for k in keys], axis=0)) + 1
    start = 0
    for end in [*change.tolist(), cut]:
        if end - start >= rows or end == cut:
            yield slice(start, end)
            start = end


def _folded(docs: DataFrame, clashing: DataFrame, **more) -> DataFrame:
    """``near_duplicates`` where ids stand on rows of different sets: each such row is a node
    under a free number, and nodes of one id are joined once the components are known."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number, room = F.monotonically_increasing_id(), 2**55
    if high < 2**63 - room:
        free = F.lit(high + 1) + number
    elif low > room - 2**63:
        free = F.lit(low - 1) - number
    else:
        raise ValueError("the ids leave no room for numbers of their own")
    again = stash(_by_id(docs, clashing, "left_semi").select("doc_id", "text", free.alias("node")), "again")
    once = _by_id(docs, clashing, "left_anti").select("doc_id", "text")
    found = near_duplicates(once.unionByName(again.select(F.col("node").alias("doc_id"), "text")), **more)
    found = found.select(F.col("doc_id").alias("node"), "n_shingles", F.col("class_id").alias("set"), F.col("component_id").alias("part"))
    found = found.join(again.select("node", F.col("doc_id").alias("given")), "node", "left")
    found = stash(found.withColumn("doc_id", F.coalesce("given", "node")), "found")
    sets = found.groupBy("set").agg(F.min("doc_id").alias("class_id"))
    parts = stash(found.groupBy("part").agg(F.min("doc_id").alias("least")), "parts")
    folds = components(found.filter("given is not null").join(parts, "part").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    folds = stash(folds.select(F.col("node").alias("least"), F.col("component")), "folds")
    parts = parts.join(folds, "least", "left").select("part", F.coalesce("component", "least").alias("component_id"))
    out = found.join(sets, "set", "left").join(parts, "part", "left")
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(
    documents: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    slack: float = 0.2,
    block: int = 512,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id and kept.

    class_id is the least id with the same set, component_id the least id reachable over
    links of at least ``percent`` per cent similarity, kept whether they are the same.
    """
    docs = pick(documents, [(doc_col, "doc_id"), (text_col, "text")])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    limit = most_unequal(percent / 100, slack)
    sketched = stash(sketches(docs, shingle), "sketch")
    light = sketched.select("doc_id", "n_shingles", "hi", "lo")
    sets = F.struct("hi", "lo")
    clashing = light.filter("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("x"), F.max(sets).alias("y")).filter("x != y").select("doc_id")
    clashing = stash(clashing, "clashing")
    if not clashing.isEmpty():
        drop_stash(sketched)
        return _folded(docs, clashing, shingle=shingle, percent=percent, slack=slack, block=block)
    classes = light.filter("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    classes = stash(classes, "classes")
    reps = sketched.join(classes.select(F.col("rep").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi").filter("n_shingles > 0")
    reps = stash(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "bands").dropDuplicates(["rep"]), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    # written first: the join then has two plain exchanges, of which a hot key's rows can be split
    shared = stash(buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).filter("m > 1").select("key", "pivot"), "shared")
    members = stash(buckets.join(shared, "key").select("key", "rep", "pivot"), "members")
    drop_stash(shared)
    stars = members.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    close = stash(_passing(stars, reps, limit), "close")
    clusters = components(close).withColumnRenamed("node", "rep")
    near = _compared(stash(clusters.filter("rep != component").select(F.col("component").alias("a"), F.col("rep").alias("b")), "pairs"), docs, shingle, percent)
    labels = near.select(F.col("b").alias("rep"), F.when(F.col("linked"), F.col("a")).otherwise(F.col("b")).alias("label"), F.col("a").alias("head"), "bits")
    more = stash(_mixed_buckets(members, labels, reps, docs, shingle, percent, limit, block), "pairs")
    labels = labels.select("rep", "label")
    links = _compared(more, docs, shingle, percent).filter("linked").select("a", "b")
    if not links.isEmpty():
        known = labels.select("rep", "label")
        ends = links.join(known.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a", "left").join(known.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b", "left")
        merged = stash(components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), "merged")
        alone = merged.join(known.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("node").alias("label"))
        labels = known.union(alone).join(merged.withColumnRenamed("node", "label"), "label", "left").select("rep", F.coalesce("component", "label").alias("label"))
    of_class = classes.join(labels, "rep", "left").select("hi", "lo", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    drop_stash(reps)
    out = light.join(of_class, ["hi", "lo"], "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), component.alias("component_id"),
        F.when(known, component == F.col("doc_id")).otherwise(True).alias("kept"),
    )


def without_near_duplicates(documents: DataFrame, doc_col: str = "doc_id", **more) -> DataFrame:
    """One document of each component, all columns; rows without id pass.

    Of rows that repeat an id one stays. Texts are shuffled for those alone, unless the
    ids to drop are too many to broadcast.
    """
    names = [F.col(f"`{c}`") for c in documents.columns]
    found = stash(near_duplicates(documents, doc_col=doc_col, **more).select("doc_id", "kept"), "kept")
    gone = found.filter("not kept").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    rows = documents.select(F.col(f"`{doc_col}`").cast("long").alias("doc_id"), F.struct(*names).alias("row"))
    rows = _by_id(rows, gone, "left_anti")
    if not again.isEmpty():
        one = W.partitionBy("doc_id").orderBy(F.xxhash64("row"))
        firsts = _by_id(rows, again, "left_semi").withColumn("copy", F.row_number().over(one)).filter("copy = 1").drop("copy")
        rows = _by_id(rows, again, "left_anti").unionByName(firsts)
    return rows.select("row.*")
