"""Collections: listing, contents, adding, removing, editing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = ["collection_id", "example_id"]
# Pairs that one task groups, sorts and joins; so its memory stays the same as the tables grow.
PAIRS_PER_TASK = 500_000


def list_collections(
    collections: DataFrame, links: DataFrame, owner: object | None = None
) -> DataFrame:
    """Collections with their size, newest first; an owner sees only their own."""
    if owner is not None:
        collections = collections.where(F.col("user_id") == owner)
        links = links.join(
            collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi"
        )
    sizes = links.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        collections.join(sizes, "id", "left")
        .withColumn("example_count", F.coalesce("n", F.lit(0).cast("long")))
        .drop("n")
        .orderBy(F.desc("created_at"), F.asc("id"))
    )


def contents(links: DataFrame, examples: DataFrame) -> DataFrame:
    """Every collection's examples with the time they were added."""
    return links.join(examples.withColumnRenamed("id", "example_id"), "example_id")


def datasets_in(links: DataFrame, examples: DataFrame, dataset: str) -> DataFrame:
    """Distinct datasets per collection."""
    members = examples.select(F.col("id").alias("example_id"), dataset)
    return links.join(members, "example_id").select("collection_id", dataset).distinct()


def dealt_pairs(
    requests: DataFrame, pairs: DataFrame, pairs_per_task: int = PAIRS_PER_TASK
) -> tuple[DataFrame, DataFrame]:
    """Requests and the distinct links of ``pairs``, both dealt by pair to as many tasks as their rows need.

    The tasks are counted, not left to the session's partitions: their number there does not follow the
    input, and merged partitions hold far more pairs than their compressed bytes tell.
    """
    requests, pairs = requests.select(*LINK), pairs.select(*LINK)
    tasks = -(-requests.unionByName(pairs).count() // pairs_per_task)
    tasks = max(tasks, requests.sparkSession.sparkContext.defaultParallelism)
    return requests.repartition(tasks, *LINK), pairs.repartition(tasks, *LINK).distinct()


def classify_adds(requests: DataFrame, links: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per distinct request with its outcome and how often it was repeated.

    A request asks for (collection_id, example_id). Outcomes: added, present, not_found. What
    :func:`dealt_pairs` has dealt is joined where it lies.
    """
    asked = requests.groupBy(*LINK).agg(F.count("*").alias("times"))
    present = links.select(*LINK).withColumn("_present", F.lit(True))
    known = examples.select(F.col("id").alias("example_id"), "dataset_id").withColumn(
        "_known", F.lit(True)
    )
    outcome = (
        F.when(F.col("_present"), F.lit("present"))
        .when(F.col("_known"), F.lit("added"))
        .otherwise(F.lit("not_found"))
    )
    return (
        asked.join(present, LINK, "left")
        .join(known, "example_id", "left")
        .select(*LINK, "times", "dataset_id", outcome.alias("outcome"))
    )


def add_summary(classified: DataFrame) -> DataFrame:
    """Per collection: added, skipped_duplicates, not_found. Repeats of one request are duplicates."""
    is_added = F.col("outcome") == "added"
    is_present = F.col("outcome") == "present"
    is_missing = F.col("outcome") == "not_found"
    return classified.groupBy("collection_id").agg(
        F.count_if(is_added).alias("added"),
        F.sum(
            F.when(is_present, F.col("times"))
            .when(is_added, F.col("times") - 1)
            .otherwise(F.lit(0))
        ).alias("skipped_duplicates"),
        F.sum(F.when(is_missing, F.col("times")).otherwise(F.lit(0))).alias("not_found"),
    )


def pick_events(classified: DataFrame) -> DataFrame:
    """One pick event per row that was really added."""
    return classified.where(F.col("outcome") == "added").select(
        F.lit("pick").alias("event_type"), *LINK, "dataset_id"
    )


def remove(links: DataFrame, requests: DataFrame) -> DataFrame:
    """Links without the requested pairs; pairs that are not linked are ignored."""
    return links.join(requests.select(*LINK), LINK, "left_anti")


def removed(links: DataFrame, requests: DataFrame) -> DataFrame:
    """The links a removal takes away."""
    return links.join(requests.select(*LINK), LINK, "left_semi")


def remove_events(removed_links: DataFrame) -> DataFrame:
    """Remove events of single removals; bulk removals record none."""
    return removed_links.select(F.lit("remove").alias("event_type"), *LINK)


def update_collections(
    collections: DataFrame, patches: DataFrame, deleted: DataFrame, created: DataFrame | None = None
) -> DataFrame:
    """Applies patches (NULL keeps the old value), deletions and new rows.

    ``patches`` has at most one row per id: (id, new_name, new_description).
    """
    kept = collections.join(deleted.select("id"), "id", "left_anti")
    patched = (
        kept.join(patches, "id", "left")
        .withColumn("name", F.coalesce("new_name", "name"))
        .withColumn("description", F.coalesce("new_description", "description"))
        .select(*collections.columns)
    )
    return patched if created is None else patched.unionByName(created)
