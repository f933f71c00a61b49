"""Deletions as change sets: one log of keys, applied to whole frames or to the touched partitions of stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.tables import written


@dataclass(frozen=True)
class Rule:
    """Rows of ``table`` whose ``column`` holds a key of the log: they go, or lose what stands in ``clears``."""

    table: str
    column: str
    clears: tuple[str, ...] = ()


@dataclass(frozen=True)
class Changes:
    """Rules and the log of their keys (rule int, key string). A null matches no key."""

    rules: tuple[Rule, ...]
    log: DataFrame

    def _keys(self, number: int) -> DataFrame:
        return self.log.where(F.col("rule") == number).select(F.col("key").alias("_key"))

    def _of(self, table: str) -> list[tuple[int, Rule]]:
        return [(i, rule) for i, rule in enumerate(self.rules) if rule.table == table]

    def applied(self, frame: DataFrame, table: str) -> DataFrame:
        """The frame after all rules of its table. Every rule looks at the row as it was before."""
        columns = frame.columns
        cleared: dict[str, list[str]] = {}
        for number, rule in self._of(table):
            keys, own = self._keys(number), F.col(rule.column).cast("string")
            if not rule.clears:
                frame = frame.join(keys, own == F.col("_key"), "left_anti")
                continue
            flag = f"_hit{number}"
            frame = frame.join(keys.withColumn(flag, F.lit(True)), own == F.col("_key"), "left").drop("_key")
            for name in rule.clears:
                cleared.setdefault(name, []).append(flag)
        kept = {name: reduce(lambda a, b: a & b, [F.col(f).isNull() for f in flags]) for name, flags in cleared.items()}
        return frame.select(*[F.when(kept[c], F.col(c)).alias(c) if c in kept else F.col(c) for c in columns])

    def touched(self, frame: DataFrame, table: str, partition: str) -> list:
        """Values of the partition column with rows that a rule speaks about; only key columns are read."""
        parts = [
            frame.select(partition, F.col(rule.column).cast("string").alias("_own"))
            .join(self._keys(number), F.col("_own") == F.col("_key"), "left_semi")
            .select(partition)
            for number, rule in self._of(table)
        ]
        if not parts:
            return []
        # One value per partition of the table, which its listing holds anyway.
        return sorted(row[0] for row in reduce(DataFrame.unionByName, parts).distinct().collect())

    def rewrite(self, spark, path: str, table: str, partition: str) -> list:
        """Applies the rules to a stored table, partitioned by ``partition``, and returns the partitions it replaced.

        Files of other partitions are neither read whole nor written. Changed partitions are first written to the shared
        folder and then replace the old ones, so that a run that fails midway can be repeated: all rules give the
        same result when applied again.
        """
        stored = spark.read.parquet(path)
        touched = self.touched(stored, table, partition)
        if not touched:
            return []
        changed = written(self.applied(stored.where(F.col(partition).isin(touched)), table), f"changed-{table}")
        replaced = changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replaced.partitionBy(partition).parquet(path)
        left = {row[0] for row in changed.select(partition).distinct().collect()}
        for value in touched:
            # A partition that lost all rows is not among those written; it gets an empty file.
            if value not in left:
                nothing = spark.createDataFrame([], changed.drop(partition).schema)
                nothing.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{partition}={value}")
        return touched


def change_set(*parts: tuple[Rule, DataFrame]) -> Changes:
    """Rules, each with a frame of one column of keys. The log is written once and holds each key once."""
    rules = tuple(rule for rule, _ in parts)
    keys = [
        frame.select(F.lit(i).alias("rule"), F.col(frame.columns[0]).cast("string").alias("key"))
        for i, (_, frame) in enumerate(parts)
    ]
    log = reduce(DataFrame.unionByName, keys).where(F.col("key").isNotNull()).distinct()
    return Changes(rules, written(log, "changes"))


def deleted_collections(ids: DataFrame) -> Changes:
    """Collections go with their links; events forget them. ``ids`` has one column."""
    return change_set(
        (Rule("collections", "id"), ids),
        (Rule("links", "collection_id"), ids),
        (Rule("events", "collection_id", ("collection_id",)), ids),
    )


def deleted_datasets(names: DataFrame, ids: DataFrame, example_ids: DataFrame, name: str) -> Changes:
    """Datasets go with their examples and the links to these; events forget both.

    ``name`` is the column of examples that names their dataset; ``names`` has its values.
    """
    return change_set(
        (Rule("examples", name), names),
        (Rule("links", "example_id"), example_ids),
        (Rule("events", "example_id", ("example_id",)), example_ids),
        (Rule("events", "dataset_id", ("dataset_id",)), ids),
    )


def deleted_users(user_ids: DataFrame, collection_ids: DataFrame) -> Changes:
    """Users go with their collections, the links of these and their keys; events stay without user, session and
    without the collections that go."""
    return change_set(
        (Rule("users", "id"), user_ids),
        (Rule("collections", "user_id"), user_ids),
        (Rule("links", "collection_id"), collection_ids),
        (Rule("api_keys", "user_id"), user_ids),
        (Rule("events", "user_id", ("user_id", "session_id")), user_ids),
        (Rule("events", "collection_id", ("collection_id",)), collection_ids),
    )
