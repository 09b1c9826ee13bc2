"""Streaming ingest: files that arrive in a folder become units, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import artifact as S

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, folder: str, facts: str, checkpoint: str, depth: int = S.DEPTH, per_batch: int = 1000) -> StreamingQuery:
    """Decode the files of ``folder`` as they come and append their units to ``facts``; stops when all there are are done.

    A batch that is repeated after a failure replaces its own output, so no file is decoded into the store twice.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        S.decoded(batch, depth).write.mode("overwrite").parquet(f"{facts}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
