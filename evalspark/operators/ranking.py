"""Top-k building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    spread: list[str] | None = None,
) -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1.

    Ranking runs twice: first per (key, salt), so that a key holding a large part of all rows is
    ranked by up to ``SALTS`` tasks, then per key over at most ``SALTS * k`` survivors. The rank
    filters become WindowGroupLimit nodes, which also cut rows before each shuffle. ``spread``
    names the columns the salt is taken from; they have to vary within a key.
    """
    spread = spread or [c for c in df.columns if c not in keys]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    far = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_near", F.row_number().over(near))
        .where(F.col("_near") <= k)
        .drop("_near", "_salt")
        .withColumn(rank, F.row_number().over(far).cast("long"))
        .where(F.col(rank) <= k)
    )


def number_rows(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Number short lists (at most a page or a fetch cap per key) from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a global order; Spark plans it as TakeOrderedAndProject."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_counts(df: DataFrame, key: str, limit: int, count: str = "n") -> DataFrame:
    """The ``limit`` most frequent values of ``key``; ties go to the smaller key."""
    return page(
        df.groupBy(key).agg(F.count("*").alias(count)),
        [F.desc(count), F.asc(key)],
        limit,
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spreads rows over all cores when the input is too small to fill the cluster.

    For work that is heavy per row. The size comes from the optimizer's estimate, so nothing runs;
    an input with at least one scan partition per core passes through without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scan_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if estimate >= cores * scan_bytes:
        return df
    return df.repartition(cores, *keys)
