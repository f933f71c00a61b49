"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """A narrow dimension table, hinted for broadcast only after its rows were counted.

    Below Spark's own broadcast threshold nothing has to be decided. Above it the estimate may be
    far too high (a distinct over a large table, say), so up to one row more than the bound is
    counted; a larger table stays without a hint and is joined by shuffle.
    """
    spark = df.sparkSession
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if threshold < 0 or estimate <= threshold:
        return df
    if df.limit(MAX_DIMENSION_ROWS + 1).count() <= MAX_DIMENSION_ROWS:
        return F.broadcast(df)
    return df
