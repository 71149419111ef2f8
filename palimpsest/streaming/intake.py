"""Scrubbing a stream of documents: each micro-batch is a run with the map as state.

Allocation needs one order over all documents, so batches follow one another: a batch's
documents come after those of all batches before. Outputs carry the batch number and are
overwritten by it, so a batch that is run again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.allocate import MAP_SCHEMA, empty_map
from ..operators.options import Options
from ..operators.scrub import scrub

#: Documents of a batch are numbered from batch * SPAN on.
SPAN = 1 << 40
FILES = "path string, modificationTime timestamp, length long, content binary"


def map_before(spark: SparkSession, state: str, batch: int) -> DataFrame:
    """The map that the batch before left."""
    if batch == 0:
        return empty_map(spark)
    return spark.read.schema(MAP_SCHEMA).parquet(f"{state}/map/batch={batch - 1}")


def scrub_batch(state: str, options: Options, ord_col: str, text_col: str) -> Callable[[DataFrame, int], None]:
    """The function of a micro-batch: texts, hits, residuals and map under ``state``."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        docs = df.withColumn("__ord", F.col(ord_col).cast("long") + F.lit(batch * SPAN))
        done = scrub(docs, map_before(spark, state, batch), options, "__ord", text_col)
        tables = {"documents": done.documents.drop("original"), "hits": done.hits, "residuals": done.residuals, "map": done.pii_map}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{state}/{name}/batch={batch}")

    return run


def start(stream: DataFrame, state: str, options: Options = Options(), ord_col: str = "file_ord", text_col: str = "text", once: bool = True) -> StreamingQuery:
    """Start scrubbing a stream; ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(scrub_batch(state, options, ord_col, text_col)).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
