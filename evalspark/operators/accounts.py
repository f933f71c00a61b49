"""Per-user jobs: limits, personal export, erasure, subscription changes."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import instant
from evalspark.functions.tiers import UNLIMITED, effective_tier, limit_of
from evalspark.operators.changes import deleted_users
from evalspark.operators.ranking import top_k_per_key

# Fixed values of subscription changes.
STARTING = ("subscription.created", "subscription.updated")
ENDING = ("subscription.canceled", "subscription.revoked")
ACTIVE = ("active", "trialing")


def limit_audit(
    users: DataFrame,
    collections: DataFrame,
    links: DataFrame,
    api_keys: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """What each user holds against the limits of their effective tier, one row per subject.

    Usage is counted before any join. ``at_limit`` is what blocks the next addition, ``over`` a
    true overflow.
    """
    tiers = users.select(
        F.col("id").alias("user_id"),
        effective_tier(F.col("tier"), F.col("trial_ends_at"), as_of).alias("tier"),
    )
    sizes = links.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("used"))
    parts = {
        "max_collections": collections.groupBy("user_id").agg(F.count("*").alias("used")).select(
            "user_id", F.col("user_id").alias("subject_id"), "used"
        ),
        "max_examples_per_collection": collections.join(sizes, "id").select(
            "user_id", F.col("id").alias("subject_id"), "used"
        ),
        "max_api_keys": api_keys.where("is_active")
        .groupBy("user_id")
        .agg(F.count("*").alias("used"))
        .select("user_id", F.col("user_id").alias("subject_id"), "used"),
    }
    allowed: Column = F.lit(None)
    for name in parts:
        allowed = F.when(F.col("limit_name") == name, limit_of(F.col("tier"), name)).otherwise(
            allowed
        )
    usage = reduce(
        DataFrame.unionByName,
        [df.withColumn("limit_name", F.lit(name)) for name, df in parts.items()],
    )
    return (
        usage.join(tiers, "user_id")
        .withColumn("allowed", allowed)
        .withColumn("bounded", F.col("allowed") != UNLIMITED)
        .select(
            "user_id",
            "tier",
            "limit_name",
            "subject_id",
            "used",
            "allowed",
            (F.col("bounded") & (F.col("used") >= F.col("allowed"))).alias("at_limit"),
            (F.col("bounded") & (F.col("used") > F.col("allowed"))).alias("over"),
        )
    )


def personal_export(
    users: DataFrame,
    collections: DataFrame,
    links: DataFrame,
    api_keys: DataFrame,
    events: DataFrame,
    newest: int | None = None,
) -> DataFrame:
    """All data of the given users as one line per item: (user_id, section, item_id, payload).

    Lines instead of one nested record, so that a user of any size stays spread over tasks. Key
    hashes never appear. All events are given; ``newest`` keeps that many a user where the caller sets it.
    """

    def lines(df: DataFrame, section: str, item: str, **payload: Column) -> DataFrame:
        fields = [value.alias(name) for name, value in payload.items()]
        return df.select(
            "user_id",
            F.lit(section).alias("section"),
            F.col(item).cast("long").alias("item_id"),
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"),
        )

    wanted = users.select(F.col("id").alias("user_id"))
    mine = collections.join(wanted, "user_id", "left_semi")
    content = links.join(mine.select(F.col("id").alias("collection_id"), "user_id"), "collection_id")
    keys = api_keys.join(wanted, "user_id", "left_semi")
    log = events.join(wanted, "user_id", "left_semi")
    if newest is not None:
        order = [F.desc("created_at"), F.asc("id")]
        log = top_k_per_key(log, ["user_id"], order, newest, spread=["id"])
    parts = [
        lines(
            users.withColumn("user_id", F.col("id")),
            "account",
            "id",
            email=F.col("email"),
            tier=F.col("tier"),
            trial_ends_at=instant(F.col("trial_ends_at")),
        ),
        lines(
            mine,
            "collection",
            "id",
            name=F.col("name"),
            description=F.col("description"),
            created_at=instant(F.col("created_at")),
        ),
        lines(content, "collection_example", "example_id", collection_id=F.col("collection_id")),
        lines(
            keys,
            "api_key",
            "id",
            prefix=F.col("key_prefix"),
            created_at=instant(F.col("created_at")),
        ),
        lines(
            log,
            "event",
            "id",
            event_type=F.col("event_type"),
            query=F.col("query"),
            example_id=F.col("example_id"),
            collection_id=F.col("collection_id"),
            created_at=instant(F.col("created_at")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def erase(
    tables: dict[str, DataFrame], leaving: DataFrame
) -> dict[str, DataFrame]:
    """Removes users: events stay without user and session, everything else of theirs goes.

    Events of any user forget the collections that go.

    ``tables`` holds users, collections, links, api_keys and events; ``leaving`` has user_id.
    """
    gone = leaving.select("user_id").distinct()
    theirs = tables["collections"].join(gone, "user_id", "left_semi").select("id")
    changes = deleted_users(gone, theirs)
    return {name: changes.applied(frame, name) for name, frame in tables.items()}


def paid_tier(product_id: Column, ultra_product: str) -> Column:
    """The configured ultra product gives ultra, any other product pro."""
    return F.when(product_id == ultra_product, F.lit("ultra")).otherwise(F.lit("pro"))


def match_subscribers(events: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the user of each event: by customer id, else by email, else the event is dropped.

    Events without an email are ignored, whatever else they carry.
    """
    by_customer = users.where(F.coalesce("customer_id", F.lit("")) != "").select(
        "customer_id", F.col("id").alias("_by_customer")
    )
    by_email = users.select("email", F.col("id").alias("_by_email"))
    return (
        events.where(F.coalesce(F.col("email"), F.lit("")) != "")
        .join(by_customer, "customer_id", "left")
        .join(by_email, "email", "left")
        .withColumn("user_id", F.coalesce("_by_customer", "_by_email"))
        .where(F.col("user_id").isNotNull())
        .drop("_by_customer", "_by_email")
    )


def fold_subscriptions(
    events: DataFrame, users: DataFrame, ultra_product: str
) -> DataFrame:
    """Users after all subscription events, in event order.

    Each field is decided by the last event that sets it, so the fold is one aggregation with
    map-side combine and a user with very many events needs no ordered replay.
    """
    matched = match_subscribers(events, users)
    order = F.struct("created_at", "event_id")
    starts = F.col("type").isin(*STARTING)
    ends = F.col("type").isin(*ENDING)
    upgrades = starts & F.col("status").isin(*ACTIVE)
    new_tier = F.when(upgrades, paid_tier(F.col("product_id"), ultra_product)).when(
        ends, F.lit("free")
    )

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.struct(value.alias("v")), F.when(when, order))["v"]

    folded = matched.where(starts | ends).groupBy("user_id").agg(
        last(new_tier, upgrades | ends).alias("new_tier"),
        F.max(upgrades).alias("superseded"),
        last(F.col("status"), F.lit(True)).alias("new_status"),
        last(F.col("customer_id"), starts).alias("new_customer"),
        last(F.col("subscription_id"), starts).alias("new_subscription"),
        F.count("*").alias("applied"),
    )
    return (
        users.join(folded, F.col("id") == F.col("user_id"), "left")
        .withColumn("tier", F.coalesce("new_tier", "tier"))
        .withColumn(
            "trial_ends_at",
            F.when(~F.coalesce("superseded", F.lit(False)), F.col("trial_ends_at")),
        )
        .withColumn("customer_id", F.coalesce("new_customer", "customer_id"))
        .withColumn("subscription_id", F.coalesce("new_subscription", "subscription_id"))
        .withColumn("subscription_status", F.coalesce("new_status", "subscription_status"))
        .withColumn("applied", F.coalesce("applied", F.lit(0).cast("long")))
        .drop("user_id", "new_tier", "superseded", "new_status", "new_customer", "new_subscription")
    )
