"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of this machine is used only where the session names none, as in tests.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str, parts: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there.

    ``parts``: a column of few values, each of which gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(parts) if parts else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null where the id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where the id falls into the held-out remainder; a null id is not held out."""
    return F.coalesce(crc_bucket(doc_id, modulus) == F.lit(remainder), F.lit(False))


def stable_hash(*cols: Column) -> Column:
    """A 60-bit number from the md5 of the columns' text, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def bounded_sample(labelled: DataFrame, id_col: str, group_col: str, bound: int, cells: int = 256) -> DataFrame:
    """At most ``bound`` rows of each group: those with the least hash of their id.

    ``labelled`` holds an id once a group (many rows of one id share their hash). A count
    for each group gives a hash threshold that keeps about four times the bound; only
    those rows are shuffled, whatever the table's size. They are ranked inside ``cells`` equal ranges of the hash, to which the counts of the ranges before are
    added, so that a group with most of the rows is ranked by many tasks.
    """
    rows = labelled.withColumn("__h", stable_hash(F.col(id_col)))
    counts = rows.groupBy(F.col(group_col).alias("__group")).agg(F.count("*").alias("__n"))
    kept = F.least(F.lit(1.0), F.lit(4.0 * bound + 32) / F.col("__n")) * F.lit(float(2**60))
    near = rows.join(counts, F.col(group_col).eqNullSafe(F.col("__group"))).withColumn("__cell", F.floor(F.col("__h") / kept * cells))
    near = near.filter(F.col("__h") <= kept).repartition("__group", "__cell")
    before = W.partitionBy("__of").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    sums = near.groupBy(F.col("__group").alias("__of"), F.col("__cell").alias("__at")).agg(F.count("*").alias("__here"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__here").over(before), F.lit(0))).filter(F.col("__before") < bound)
    ranked = near.withColumn("__rank", F.row_number().over(W.partitionBy("__group", "__cell").orderBy("__h", id_col)))
    found = ranked.join(sums, F.col("__group").eqNullSafe(F.col("__of")) & (F.col("__cell") == F.col("__at")))
    return found.filter(F.col("__before") + F.col("__rank") <= bound).select(*labelled.columns)


def batches_of(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(b.nbytes, 1))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def prefix_sums(df: DataFrame, order_col: str, value_col: str, out_col: str, block: int = 1024) -> DataFrame:
    """The sum of ``value_col`` over all rows before each one, by a dense integer order.

    Blocks of ``block`` rows are summed on their own and only the blocks' totals meet in
    one task, so no task sees more than a thousandth of the rows.
    """
    rows = df.withColumn("__block", F.floor(F.col(order_col) / block))
    inner = W.partitionBy("__block").orderBy(order_col).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value_col).over(inner), F.lit(0)))
    totals = rows.groupBy("__block").agg(F.sum(value_col).alias("__total"))
    outer = W.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("__block", F.coalesce(F.sum("__total").over(outer), F.lit(0)).alias("__base"))
    return (
        rows.join(bases, "__block")
        .withColumn(out_col, F.col("__in") + F.col("__base"))
        .drop("__block", "__in", "__base")
    )


_WORDS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters: of word characters those that are no digit, underscore or other number (as ½, ² or Ⅷ)."""
    found = _WORDS.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def trim() -> None:
    """Give memory that a finished task has freed back to the machine: Python workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64, endpoint=False)


def pick(df: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Only the named columns, under new names: other columns can't clash with the operator's own."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping])
