"""Mixing sources to target weights with hash-threshold histograms.

Sources, in code-point order with null last, get weights from a repeating list; together
they share ``share`` times all words, and a source's target stops at ``most`` times its
size, the excess going to the others by weight. A target is met by whole copies of the
source, and for the rest by the documents whose hash lies below a threshold. Thresholds
are nested: words are summed by source and hash bucket (12 bits a level), the boundary
bucket is found from running sums over at most 4,096 buckets, and only its documents go
to the next level, until few are left, of which the threshold is one. Documents are then
filtered by hash, unsorted. A larger budget only adds documents, so mixes are nested.

Defined results: a null text has size 0; null is a source of its own; rows that repeat a
doc_id share its hash, so they are taken together; documents without words are never counted but kept when their hash
falls below the threshold; an empty table gives an empty result; other columns, whatever
their names, are not read. The same rows give the same mix, in any order and partitioning.

Scale: one pass over the texts for the sizes, stashed as (id, source, size, hash); every
level is a map-side aggregate whose width is sources x 4,096, so a source with a third of
all rows costs no more than another. The list of sources (at most ``max_sources``) is the
one thing that comes to the driver: it is the mixing table itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stash, pick, stable_hash, stash

BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    """How many runs without space, tab, line feed, vertical tab, form feed or return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> dict[str | None, float]:
    """The target of each source; sizes holds (source, words)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    target, left, free = {}, share * sum(n for _, n in order), [s for s, _ in order]
    while free:
        rate = left / sum(weight[s] for s in free)
        full = [s for s in free if rate * weight[s] > cap[s]]
        if not full:
            target |= {s: rate * weight[s] for s in free}
            break
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
        free = [s for s in free if s not in target]
    return target


def _prefix(bits: int) -> Column:
    return F.shiftright("h", BITS - bits)


def thresholds(rows: DataFrame, rest: dict[str | None, float], few: int = 1024) -> dict[str | None, int]:
    """For each source the hash up to which its documents' words come nearest to ``rest``.

    ``rows``: (source, size, h). -1 takes none, 2**60 all.
    """
    spark = rows.sparkSession
    cut = {s: -1 for s, r in rest.items() if r <= 0}
    schema = T.StructType([T.StructField("s", rows.schema["source"].dataType), T.StructField("left", T.DoubleType()), T.StructField("cell", T.LongType())])
    state = [(s, float(r), 0) for s, r in rest.items() if r > 0]
    bits = 0
    while state:
        at = F.broadcast(spark.createDataFrame(state, schema))  # a row per source of the mixing table
        here = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (_prefix(bits) == F.col("cell")))
        finer = min(BITS, bits + LEVEL_BITS)
        sums = here.groupBy("s", "left", _prefix(finer).alias("c")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        w = W.partitionBy("s").orderBy("c").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(w))
        past = sums.filter(F.col("upto") > F.col("left")).groupBy("s").agg(F.min(F.struct("c", "upto", "n", "rows", "left")).alias("b"))
        found = {r["s"]: r["b"] for r in past.collect()}
        # where no bucket passes the budget, everything below the last boundary is taken
        cut |= {s: ((cell + 1) << (BITS - bits)) - 1 for s, _, cell in state if s not in found}
        state = [(s, b["left"] - (b["upto"] - b["n"]), b["c"]) for s, b in found.items()]
        bits = finer
        if bits == BITS or all(b["rows"] <= few for b in found.values()):
            break
    if state:  # the documents of the last boundary buckets, one by one
        at = F.broadcast(spark.createDataFrame(state, schema))
        last = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (_prefix(bits) == F.col("cell")))
        last = last.groupBy("s", "left", "h").agg(F.sum("size").alias("n"))
        w = W.partitionBy("s").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
        last = last.withColumn("off", F.abs(F.sum("n").over(w) - F.col("left")))
        best = {r["s"]: r["b"] for r in last.groupBy("s").agg(F.min(F.struct("off", "h")).alias("b")).collect()}
        for s, left, cell in state:
            b = best[s]
            cut[s] = b["h"] if b["off"] < left else (cell << (BITS - bits)) - 1
    return cut


def mixing_plan(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The stashed rows (doc_id, source, size, h), and per source (p, source_size, target, whole, cut)."""
    spark = documents.sparkSession
    rows = pick(documents, [(doc_col, "doc_id"), (source_col, "source"), (text_col, "text")])
    rows = stash(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), stable_hash(F.col("doc_id")).alias("h")), "mix")
    sizes = [(r["source"], r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()]
    if len(sizes) > max_sources:
        raise ValueError(f"over {max_sources} sources: no mixing table")
    targets = source_targets(sizes, weights, share, most)
    whole = {s: int(min(most, targets[s] // n)) if n else 0 for s, n in sizes}
    rest = {s: targets[s] - whole[s] * n if whole[s] < most else 0.0 for s, n in sizes}
    cut = thresholds(rows, rest)
    schema = T.StructType([
        T.StructField("p", rows.schema["source"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("whole", T.LongType()), T.StructField("cut", T.LongType()),
    ])
    return rows, spark.createDataFrame([(s, n, float(targets[s]), whole[s], cut[s]) for s, n in sizes], schema)


def mix(documents: DataFrame, source_col: str = "source", **more) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows, plan = mixing_plan(documents, source_col=source_col, **more)
    out = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p")))  # at most max_sources rows
    copies = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(documents: DataFrame, doc_col: str = "doc_id", source_col: str = "source", **more) -> DataFrame:
    """Each document as often as the mix takes it, all columns kept; texts are not shuffled."""
    rows, plan = mixing_plan(documents, doc_col=doc_col, source_col=source_col, **more)
    drop_stash(rows)
    # the caller's columns travel in one struct, where no name can clash
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    out = documents.select(row.alias("row"), F.col(f"`{source_col}`").alias("source"), stable_hash(F.col(f"`{doc_col}`")).alias("h"))
    out = out.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p")))  # at most max_sources rows
    copies = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")
