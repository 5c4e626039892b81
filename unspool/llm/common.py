"""What several operators share: the shared folder, the train/held-out split, typed inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unspool.batches import small_batches
from unspool.storage import delete, materialize, release, shared_dir, written

__all__ = ["delete", "fit_sample", "held_out", "lower_ascii", "materialize", "release", "shared_dir", "shuffle_partitions", "small_batches", "table", "written"]

#: White space of the word definition, as code points: space and 0x09 to 0x0D.
SPACE_CHARS = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE_CHARS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fit_sample(rows: DataFrame, doc_id: str, limit: int) -> DataFrame:
    """At most `limit` rows in an order that depends only on the ids: the same rows on every run and cluster."""
    order = [F.xxhash64(F.lit(20), F.col(doc_id)), F.col(doc_id)]
    return rows.orderBy(*order).limit(limit)
