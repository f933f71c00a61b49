"""Recording interaction events: whole rows, ids that a repeated run gives again, one folder per batch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import schemas
from evalspark.operators.mining import normalise

# What an event may carry beside its id, type and time, with the type each field is stored as.
FIELDS = {
    f.name: f.dataType.simpleString()
    for f in schemas.CURATION_EVENTS.fields
    if f.name not in ("id", "event_type", "created_at")
}
# The longest texts the log holds.
LONGEST = {"event_type": 50, "user_id": 100, "search_mode": 50, "export_format": 50}
BATCH_NAME = r"[0-9a-zA-Z_\-]{1,100}"


def event_id(batch: str, key: Column) -> Column:
    """A number that depends on the batch and the event's key in it alone."""
    digest = F.md5(F.concat(F.lit(f"{batch}/"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def event_rows(requests: DataFrame, batch: str, key: str) -> DataFrame:
    """Whole event rows of any requests with ``event_type``, ``created_at`` and some of ``FIELDS``.

    Fields that the requests lack are NULL; an invalid session id becomes NULL and the event stays; maps and structs
    under ``event_metadata`` become JSON. ``key`` names an event within its batch.
    """
    kinds = dict(requests.dtypes)

    def field(name: str, kind: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast(kind).alias(name)
        nested = kinds[name].startswith(("struct", "map", "array"))
        return (F.to_json(name) if nested else F.col(name).cast(kind)).alias(name)

    rows = requests.select(
        event_id(batch, F.col(key)).alias("id"),
        F.col("event_type").cast("string").alias("event_type"),
        *[field(n, t) for n, t in FIELDS.items()],
        F.col("created_at").cast("timestamp").alias("created_at"),
    )
    return normalise(rows)


def storable(rows: DataFrame) -> Column:
    """Whether the log can hold a row: a type, and no text longer than its column."""
    fits = F.col("event_type").isNotNull()
    for name, longest in LONGEST.items():
        fits = fits & (F.col(name).isNull() | (F.length(name) <= longest))
    return fits


def record(requests: DataFrame, path: str, batch: str, key: str) -> DataFrame:
    """Appends a batch to the log under ``path`` and returns the requests that it could not hold.

    A batch is a folder of its own. Running it again, whole or after a failure, replaces that folder with the same rows,
    so nothing is recorded twice. Recording never stops a caller: rows that don't fit are handed back, not raised.
    """
    if not re.fullmatch(BATCH_NAME, batch):
        raise ValueError(f"a batch name must match {BATCH_NAME}")
    rows = event_rows(requests, batch, key)
    rows.where(storable(rows)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return rows.where(~storable(rows))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All recorded events with the batch they came with."""
    return spark.read.schema(T.StructType([*schemas.CURATION_EVENTS.fields, T.StructField("batch", T.StringType())])).parquet(path)


def searches(hits: DataFrame, mode: str, at: Column) -> DataFrame:
    """One search event per request that was answered. ``hits`` has query_id and query."""
    return hits.select("query_id", "query").distinct().select(
        "query_id", F.lit("search").alias("event_type"), "query", F.lit(mode).alias("search_mode"), at.alias("created_at")
    )


def exports(collection_ids: DataFrame, export_format: str, at: Column) -> DataFrame:
    """One export event per exported collection. ``collection_ids`` has collection_id."""
    if export_format not in schemas.EXPORT_FORMATS:
        raise ValueError(f"format must be one of {schemas.EXPORT_FORMATS}")
    return collection_ids.select("collection_id").distinct().select(
        "collection_id", F.lit("export").alias("event_type"), F.lit(export_format).alias("export_format"), at.alias("created_at")
    )
