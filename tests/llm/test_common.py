"""The shared folder."""

from pathlib import Path

from unspool.llm import common


def test_written_tables_are_read_back_and_released(spark):
    frame = common.materialize(spark.range(5), "five")
    assert frame.count() == 5
    folder = Path(common.shared_dir(spark)) / spark.sparkContext.applicationId
    assert list(folder.glob("five-*"))
    common.release(spark)
    assert not folder.exists()
