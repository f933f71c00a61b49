"""Subscription changes as a stream: what each micro-batch changed, the newest state of every user, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.accounts import fold_subscriptions


class SubscriptionState:
    """Users below one path of the shared folder: a base, and a folder of changed users for each micro-batch.

    A batch writes only the users whose events it holds. The state is the base with the newest change of each
    user. ``compact`` makes it a base of its own; changes up to there are pruned by their folder's name from then on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _through(self) -> int | None:
        """The last batch that the newest whole base holds: -1 for the users at the start, None without a base."""
        try:
            ready = self.spark.read.schema("n int, through long").parquet(f"{self.path}/ready")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return ready.agg(F.max("through")).first()[0]

    def _publish(self, users: DataFrame, through: int) -> None:
        """A base counts once its mark stands beside it, so one that was written in part is never read."""
        users.write.mode("overwrite").parquet(f"{self.path}/base/through={through}")
        mark = self.spark.range(1, numPartitions=1).select(F.lit(1).alias("n"))
        mark.write.mode("overwrite").parquet(f"{self.path}/ready/through={through}")

    def create(self, users: DataFrame) -> None:
        """The users at the start, with no events applied. A state that exists stays as it is."""
        if self._through() is None:
            self._publish(users.withColumn("applied", F.lit(0).cast("long")), -1)

    def changes(self) -> DataFrame | None:
        """All changed users with the batch that changed them; None before the first batch."""
        base = self.spark.read.parquet(f"{self.path}/base/through={self._through()}")
        try:
            return self.spark.read.schema(base.schema.add("batch", "long")).parquet(f"{self.path}/changes")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def users(self, before: int | None = None) -> DataFrame:
        """Every user in the newest state, or in that before a batch newer than the base; ``applied`` counts their events."""
        through = self._through()
        if through is None:
            raise ValueError(f"no subscription state at {self.path}")
        base = self.spark.read.parquet(f"{self.path}/base/through={through}")
        changes = self.changes()
        if changes is None:
            return base
        changes = changes.where(F.col("batch") > through)
        if before is not None:
            changes = changes.where(F.col("batch") < before)
        newest = changes.groupBy("id").agg(F.max_by(F.struct(*base.columns), "batch").alias("newest"))
        state = F.coalesce("newest", F.struct(*base.columns))
        return base.join(newest, "id", "left").select(state.alias("state")).select("state.*")

    def apply(self, events: DataFrame, batch: int, ultra_product: str) -> None:
        """Writes the users that a batch of events changes. A batch that runs again replaces its own folder, and one that
        the base holds already is left out."""
        if batch <= self._through():
            return
        users = self.users(before=batch)
        folded = fold_subscriptions(events, users.withColumnRenamed("applied", "_before"), ultra_product)
        changed = folded.where("applied > 0").withColumn("applied", F.col("applied") + F.col("_before"))
        changed.select(*users.columns).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    def compact(self) -> None:
        """Makes the newest state the base. Interrupted, it leaves the old base in use."""
        changes = self.changes()
        last = None if changes is None else changes.agg(F.max("batch")).first()[0]
        if last is not None and last > self._through():
            self._publish(self.users(), last)


def run_subscriptions(
    events: DataFrame, users: DataFrame, path: str, ultra_product: str, compact_every: int = 50
) -> SubscriptionState:
    """Drains a stream of subscription events into the state below ``path`` and returns it.

    Events are applied in their order within a micro-batch, batches in the order of their arrival. ``users`` counts on the first start only;
    a restart goes on where the stream stopped. Every ``compact_every`` batches the state is compacted.
    """
    state = SubscriptionState(users.sparkSession, path)
    state.create(users)

    def apply(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch, batch_id, ultra_product)
        if batch_id % compact_every == compact_every - 1:
            state.compact()

    query = (
        events.writeStream.option("checkpointLocation", f"{state.path}/stream")
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )
    query.awaitTermination()
    return state
