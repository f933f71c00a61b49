"""What the operators of this subpackage share: row keys, table copies in the shared folder, worker caches."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import configure, work_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


def row_name(doc_id: Column, text: Column) -> Column:
    """128 bits of id and text: rows that repeat an id, or have none, stay apart if their texts differ."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), text)))


def keyed(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, row and text (null: empty) of documents; with ``keep`` also all columns as one struct ``whole``.

    ``row`` names a row by its id and text, see :func:`row_name`. Columns of the input can't clash with the operators'
    own, which never stand beside them.
    """
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    columns = [doc_id.alias("doc_id"), row_name(doc_id, text).alias("row"), text.alias("text")]
    return docs.select(*columns, *([F.struct("*").alias("whole")] if keep else []))


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = work_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def replaced_text(whole: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The rows of ``whole`` with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return whole.select(*[new[c].alias(c) if c in new else F.col("whole")[c].alias(c) for c in columns])


def worker_cache(name: str) -> dict:
    """A dictionary that outlives a task in a reused Python worker. Functions are sent by value, so module variables don't."""
    return sys.__dict__.setdefault("_evalspark_llm", {}).setdefault(name, {})
