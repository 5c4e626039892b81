"""The same extraction over a folder that files arrive in: stateless, so the batch code runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unspool.operators.extract import parse, records
from unspool.sources.binaries import SCHEMA


def stream_binaries(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(SCHEMA)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select(F.col("path").alias("binary_id"), "content")


def stream_records(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the records of all files there now, and of later ones on the next call, each file once."""
    rows = records(parse(stream_binaries(spark, path))).drop("encrypted_data", "decrypted_data", "decompressed_data")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
