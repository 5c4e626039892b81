"""The size of what a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to `most` bytes if they are larger: rows are whole texts, and a worker holds a batch and its kernel's arrays at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name) or "").rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, f"{most}b")
