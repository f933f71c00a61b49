"""The interaction log: recording rules, statistics, popular and co-picked examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators.ranking import top_counts, top_k_per_key

TOP = 10


def normalise(events: DataFrame) -> DataFrame:
    """An invalid session id becomes NULL; the event itself is kept."""
    valid = F.col("session_id").rlike(schemas.SESSION_ID)
    return events.withColumn("session_id", F.when(valid, F.col("session_id")))


def _picks(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "pick") & F.col("example_id").isNotNull())


def event_stats(events: DataFrame, user_id: object | None = None) -> DataFrame:
    """(stat, key, n): total, by type, top picks; top queries only when a user asks for their own."""
    if user_id is not None:
        events = events.where(F.col("user_id") == user_id)
    by_type = events.groupBy("event_type").agg(F.count("*").alias("n"))

    def labelled(df: DataFrame, stat: str, key: str) -> DataFrame:
        return df.select(F.lit(stat).alias("stat"), F.col(key).cast("string").alias("key"), "n")

    out = (
        by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        .select(F.lit("total").alias("stat"), F.lit(None).cast("string").alias("key"), "n")
        .unionByName(labelled(by_type, "type", "event_type"))
        .unionByName(labelled(top_counts(_picks(events), "example_id", TOP), "pick", "example_id"))
    )
    if user_id is not None:
        searches = events.where((F.col("event_type") == "search") & F.col("query").isNotNull())
        out = out.unionByName(labelled(top_counts(searches, "query", TOP), "query", "query"))
    return out


def top_queries_per_user(events: DataFrame, limit: int = TOP) -> DataFrame:
    """Every user's most frequent queries."""
    searches = events.where((F.col("event_type") == "search") & F.col("query").isNotNull())
    counted = searches.groupBy("user_id", "query").agg(F.count("*").alias("n"))
    return top_k_per_key(
        counted, ["user_id"], [F.desc("n"), F.asc("query")], limit, spread=["query"]
    )


def pick_counts(events: DataFrame, examples: DataFrame) -> DataFrame:
    """Pick count of every example, zero included."""
    counted = _picks(events).groupBy(F.col("example_id").alias("id")).agg(F.count("*").alias("n"))
    return examples.select("id").join(counted, "id", "left").select(
        "id", F.coalesce("n", F.lit(0).cast("long")).alias("pick_count")
    )


def popular(events: DataFrame, limit: int = 20) -> DataFrame:
    schemas.check_page(limit, top=schemas.MAX_ANALYTICS_LIMIT)
    return top_counts(_picks(events), "example_id", limit, "pick_count")


def co_picked(events: DataFrame, example_id: int, limit: int = TOP) -> DataFrame:
    """Examples most often picked in the collections that hold the given one.

    Counts pick events, not collections. One plan: distinct collections, semi join, count.
    """
    schemas.check_page(limit, top=schemas.MAX_ANALYTICS_LIMIT)
    picks = events.where(F.col("event_type") == "pick")
    holding = (
        picks.where((F.col("example_id") == example_id) & F.col("collection_id").isNotNull())
        .select("collection_id")
        .distinct()
    )
    others = picks.where(F.col("example_id").isNotNull() & (F.col("example_id") != example_id))
    return top_counts(
        others.join(holding, "collection_id", "left_semi"), "example_id", limit, "co_pick_count"
    )


def co_picked_for(events: DataFrame, wanted: DataFrame, limit: int = TOP) -> DataFrame:
    """The same for a bounded list of examples at once. ``wanted`` has at most a page of ids.

    Picks are counted per (collection, example) first. Each pre-counted row then meets only the
    wanted examples of its collection, so the work is linear in the log times the page size; pairs
    among all members of a collection are never formed.
    """
    bound = schemas.MAX_ANALYTICS_LIMIT
    ids = [r[0] for r in wanted.select("example_id").distinct().limit(bound + 1).collect()]
    if len(ids) > bound:
        raise ValueError(f"at most {bound} examples at once")
    picks = _picks(events).where(F.col("collection_id").isNotNull())
    counted = picks.groupBy("collection_id", "example_id").agg(F.count("*").alias("n"))
    holding = counted.where(F.col("example_id").isin(ids))
    # One row per collection: the anchors it holds, at most a page of them.
    holding = holding.groupBy("collection_id").agg(F.collect_set("example_id").alias("anchors"))
    pairs = (
        counted.join(holding, "collection_id")
        .select("example_id", "n", F.explode("anchors").alias("anchor_id"))
        .where(F.col("example_id") != F.col("anchor_id"))
        .groupBy("anchor_id", "example_id")
        .agg(F.sum("n").alias("co_pick_count"))
    )
    return top_k_per_key(
        pairs,
        ["anchor_id"],
        [F.desc("co_pick_count"), F.asc("example_id")],
        limit,
        spread=["example_id"],
    )
