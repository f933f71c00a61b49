"""Event log as a stream: windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import work_dir


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """The parquet files called ``name`` below a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def event_counts(events: DataFrame, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Running counts per window and type; state older than the watermark is dropped."""
    return (
        events.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", width), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n")
    )


def run_counts(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Drains the stream and returns the newest count of every window.

    Update mode writes only changed windows. Each micro-batch goes to its own folder, so a batch
    that is retried replaces its own output; the newest batch of a window holds its count.
    """
    out = work_dir(spark, "counts")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def drain(rows: DataFrame, spark: SparkSession, purpose: str) -> DataFrame:
    """Runs an append-mode stream to its present end and returns everything it wrote."""
    out = work_dir(spark, purpose)
    query = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
