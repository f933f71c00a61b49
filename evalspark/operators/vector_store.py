"""A stored set of vector collections: dims and metric are registered, payload stands beside the vector, files are dealt by
(collection, bucket of the id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators.ranking import top_k_per_key
from evalspark.operators.tables import written
from evalspark.operators.vector import METRICS

PAYLOAD = {
    "dataset_id": "long",
    "dataset_name": "string",
    "task_type": "string",
    "question": "string",
    "subject": "string",
    "split": "string",
}
POINT_SCHEMA = ", ".join(["example_id long", "vector array<float>", *(f"{n} {t}" for n, t in PAYLOAD.items()), "bucket int", "collection string"])
REGISTRY_SCHEMA = "dims int, metric string, buckets int, collection string"
BUCKETS = 16


class VectorStore:
    """Collections below one path of the shared folder.

    A search with a payload filter reads collection, id, vector and the filter's column of one scan; nothing is
    joined before the ranking. An upsert reads and replaces the buckets it touches, all others keep their files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def registry(self) -> DataFrame:
        """collection, dims, metric, buckets of every collection."""
        rows = self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.path}/registry")
        return rows.select("collection", "dims", "metric", "buckets")

    def _registered(self, name: str) -> tuple[int, str, int] | None:
        schemas.check_collection(name)
        try:
            found = self.registry().where(F.col("collection") == name).select("dims", "metric", "buckets").first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return None if found is None else tuple(found)

    def create(self, name: str, dims: int, metric: str = "COSINE", buckets: int = BUCKETS) -> None:
        """Registers a collection if it is missing. One that exists with other dims or another metric is refused."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if dims < 1 or buckets < 1:
            raise ValueError("dims and buckets must be at least 1")
        known = self._registered(name)
        if known is not None:
            if known[:2] != (dims, metric):
                raise ValueError(f"{name} holds {known[0]} dims under {known[1]}")
            return
        row = self.spark.createDataFrame([(dims, metric, buckets)], "dims int, metric string, buckets int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/registry/collection={name}")

    def metric(self, name: str) -> str:
        known = self._registered(name)
        if known is None:
            raise ValueError(f"no collection {name}")
        return known[1]

    def points(self) -> DataFrame:
        """All points with their payload, one file group per (collection, bucket)."""
        return self.spark.read.schema(POINT_SCHEMA).parquet(f"{self.path}/points")

    def payload(self) -> DataFrame:
        """The payload by example id, without vectors."""
        return self.points().select(F.col("example_id").alias("id"), *PAYLOAD).dropDuplicates(["id"])

    def _stored(self, name: str, buckets: list[int]) -> DataFrame | None:
        try:
            rows = self.points()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return rows.where((F.col("collection") == name) & F.col("bucket").isin(buckets))

    def upsert(self, name: str, rows: DataFrame, order: str = "batch") -> list[int]:
        """Last write per example_id wins, by ``order`` within ``rows``. Returns the buckets that were replaced.

        ``rows`` has example_id, vector, ``order`` and any payload columns; those it lacks are NULL. A vector of another
        width than the collection's ends the job before anything is replaced. Changed buckets are written to the
        shared folder first, so that a failed run can be repeated.
        """
        known = self._registered(name)
        if known is None:
            raise ValueError(f"no collection {name}")
        dims, _, buckets = known
        newest = top_k_per_key(rows, ["example_id"], [F.desc(order)], 1, rank="_latest", spread=[order])
        wide = F.raise_error(F.lit(f"vector width differs from {dims}")).cast("array<float>")
        vector = F.when(F.size("vector") == dims, F.col("vector").cast("array<float>")).otherwise(wide)
        given = [F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in PAYLOAD.items()]
        bucket = F.pmod("example_id", F.lit(buckets)).cast("int").alias("bucket")
        incoming = newest.select(F.col("example_id").cast("long").alias("example_id"), vector.alias("vector"), *given, bucket)
        incoming = written(incoming.withColumn("collection", F.lit(name)), "incoming-points")
        # At most as many numbers as the collection has buckets.
        touched = sorted(r[0] for r in incoming.select("bucket").distinct().collect())
        if not touched:
            return []
        stored = self._stored(name, touched)
        merged = incoming
        if stored is not None:
            kept = stored.join(incoming.select("example_id"), "example_id", "left_anti")
            merged = written(kept.select(*incoming.columns).unionByName(incoming), "merged-points")
        replaced = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replaced.partitionBy("collection", "bucket").parquet(f"{self.path}/points")
        return touched
