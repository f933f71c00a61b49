"""Reading a raw dataset split by split, and profiling a source before it is mapped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_ROWS = 5


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system the path belongs to, local or remote."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def scan_splits(
    spark: SparkSession,
    paths: dict[str, str],
    splits: list[str],
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """The declared splits of a dataset that exist, with a literal ``split`` column."""
    present = [s for s in splits if s in paths and path_exists(spark, paths[s])]
    if not present:
        raise FileNotFoundError(f"none of the splits {splits} exist")
    parts = [
        spark.read.format(fmt).options(**options).load(paths[s]).withColumn("split", F.lit(s))
        for s in present
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def profile_source(df: DataFrame, order_by: str, rows: int = PROFILE_ROWS) -> DataFrame:
    """Column names and types beside the first rows, one line per (row, column)."""
    sample = df.orderBy(order_by).limit(rows)
    cells = F.array(
        *[
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                F.col(field.name).cast("string").alias("value"),
            )
            for field in df.schema.fields
        ]
    )
    return sample.select(F.col(order_by).cast("string").alias("row_key"), F.inline(cells))
