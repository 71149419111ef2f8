"""Cutting a plan's lineage in the shared folder, by a checkpoint or by a written table; spreading rows over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A folder of this machine is used only where the session names none. It holds texts, so
    it must be as private as they are.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint that survives lost executors."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a compressed table in the shared folder.

    For wide rows of texts: what follows reads only the columns that it needs.
    """
    path = f"{_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows in even partitions, where one task would read far more than its share.

    A file of one row group is read by one task, however large it is. Rows are counted by
    partition, which reads no column but ``key``; rows that lie well are left where they are.
    """
    counts = [r["count"] for r in df.select(key).groupBy(F.spark_partition_id()).count().collect()]  # a row a partition
    parts = min(4 * df.sparkSession.sparkContext.defaultParallelism, sum(counts) // 64)
    return df.repartition(parts, key) if parts > 1 and max(counts) * parts > 4 * sum(counts) else df
