"""Continuous triage of arriving files: a file stream, each batch analysed whole and appended once.

An extension: batches are idempotent, since each is written under its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.triage import analyze, recover_bytes


def triage_stream(spark: SparkSession, path: str, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).load(path)
    files = arriving.select(F.sha2("path", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")

    def write(batch: DataFrame, number: int) -> None:
        analyze(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recovery_stream(spark: SparkSession, path: str, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Bytes to bytes: each arriving file comes out repaired, or unchanged with a warning."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).load(path)
    files = arriving.select(F.sha2("path", 256).alias("file_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def write(batch: DataFrame, number: int) -> None:
        recover_bytes(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
