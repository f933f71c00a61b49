"""Table layouts of the curation model and the checks applied to request arguments."""

from __future__ import annotations

import re

from pyspark.sql import types as T

DATASETS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("license", T.StringType()),
        T.StructField("task_type", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("stats", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# subject and split are also kept inside the metadata JSON; as columns they can be pushed to the scan.
EXAMPLES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("dataset_id", T.LongType(), False),
        T.StructField("question", T.StringType(), False),
        T.StructField("answer", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("example_metadata", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

COLLECTIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

COLLECTION_EXAMPLES = T.StructType(
    [
        T.StructField("collection_id", T.LongType(), False),
        T.StructField("example_id", T.LongType(), False),
        T.StructField("added_at", T.TimestampType()),
    ]
)

CURATION_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("collection_id", T.LongType()),
        T.StructField("dataset_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("search_mode", T.StringType()),
        T.StructField("result_position", T.LongType()),
        T.StructField("result_score", T.DoubleType()),
        T.StructField("export_format", T.StringType()),
        T.StructField("event_metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("email", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("trial_ends_at", T.TimestampType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("subscription_id", T.StringType()),
        T.StructField("subscription_status", T.StringType()),
        T.StructField("llm_calls_today", T.LongType()),
        T.StructField("semantic_searches_today", T.LongType()),
        T.StructField("quota_reset_at", T.TimestampType()),
    ]
)

API_KEYS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("key_prefix", T.StringType()),
        T.StructField("key_hash", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("last_used_at", T.TimestampType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# The ranges a request may carry.
MAX_QUERY_CHARS = 500
MAX_PAGE = 100
MAX_BATCH = 64
MAX_BULK_IDS = 1000
MAX_ANALYTICS_LIMIT = 200
MAX_PASSES = 5
SORT_ORDERS = ("relevance", "newest", "dataset")
COLLECTION_NAME = r"^[a-z0-9_]{1,64}$"
SESSION_ID = r"^[0-9a-zA-Z\-_]{1,100}$"
EVENT_TYPES = ("search", "pick", "remove", "export", "view")
EXPORT_FORMATS = ("json", "jsonl", "csv", "langfuse")


def check_query(text: str) -> str:
    if not 1 <= len(text) <= MAX_QUERY_CHARS:
        raise ValueError(f"query length must be 1..{MAX_QUERY_CHARS}")
    return text


def check_page(limit: int, offset: int = 0, top: int | None = MAX_PAGE) -> None:
    if limit < 1 or top is not None and limit > top:
        raise ValueError(f"limit must be 1..{top or 'any'}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def check_sort(sort_by: str) -> str:
    if sort_by not in SORT_ORDERS:
        raise ValueError(f"sort_by must be one of {SORT_ORDERS}")
    return sort_by


def check_unit(value: float, name: str) -> float:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be within [0, 1]")
    return value


def check_collection(name: str) -> str:
    if not re.match(COLLECTION_NAME, name):
        raise ValueError(f"collection must match {COLLECTION_NAME}")
    return name


def check_batch(requests: list) -> list:
    if not 1 <= len(requests) <= MAX_BATCH:
        raise ValueError(f"a search batch holds 1..{MAX_BATCH} requests")
    return requests
