"""Tables that are written to the folder which driver and executors share, so that lineage ends there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: For each application the tables that it wrote and has not deleted.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, as in tests, gets a temporary one where none is set."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} can't read what others write to their own disks")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="unspool-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of it: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables that this application wrote and has not deleted, the oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete some of the tables that this application wrote; nothing may read them any more."""
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in own:
            own.remove(path)


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results that still read it must be written before."""
    app = spark.sparkContext.applicationId
    delete(spark, [f"{shared_dir(spark)}/{app}"])
    _written.pop(app, None)
