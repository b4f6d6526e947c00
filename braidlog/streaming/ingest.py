"""Streaming ingestion: operations that arrive late or twice change nothing.

State is a function of the set of operations, so late ones need no watermark.
Each micro-batch is appended under its batch number; a batch that runs again
overwrites its own folder, and readers drop operations delivered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import dedupe
from ..schema import OPS


def ingest(stream: DataFrame, log: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream of operations to the log below ``log``."""
    def write(batch: DataFrame, number: int) -> None:
        dedupe(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Each operation of an ingested log once."""
    return dedupe(spark.read.schema(OPS).parquet(log).select(*[f.name for f in spark.createDataFrame([], OPS).schema]))
