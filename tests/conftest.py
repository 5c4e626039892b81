import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(rows, columns):
    """Rows as sorted tuples in the order of column names, doubles rounded."""

    def value(x):
        if isinstance(x, float):
            return f"{x:.6g}"
        return repr(bytes(x)) if isinstance(x, (bytes, bytearray)) else repr(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


def agree(frame, duck, sql):
    """Whether a query and its SQL have the same columns and rows."""
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(cursor.fetchall(), names)
