"""Tables a job writes for itself in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.session import work_dir


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table of the shared folder: computed once, read as often as needed, kept when executors are lost."""
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
