"""Tier rules: effective tier and the limit table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

UNLIMITED = -1
# Limits per tier; -1 is unlimited, 0 is blocked.
LIMITS = {
    "free": {
        "keyword_rpm": 30,
        "semantic_searches_per_day": 50,
        "llm_calls_per_day": 0,
        "max_collections": 10,
        "max_examples_per_collection": 1000,
        "max_api_keys": 1,
    },
    "pro": {
        "keyword_rpm": 120,
        "semantic_searches_per_day": -1,
        "llm_calls_per_day": 180,
        "max_collections": -1,
        "max_examples_per_collection": -1,
        "max_api_keys": 10,
    },
    "ultra": {
        "keyword_rpm": 120,
        "semantic_searches_per_day": -1,
        "llm_calls_per_day": 300,
        "max_collections": -1,
        "max_examples_per_collection": -1,
        "max_api_keys": 10,
    },
}


def effective_tier(tier: Column, trial_ends_at: Column, as_of: dt.datetime) -> Column:
    """A free user with a running trial counts as ultra."""
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return F.when(
        (tier == "free") & (trial_ends_at.cast("timestamp_ntz") > now), F.lit("ultra")
    ).otherwise(tier)


def limit_of(tier: Column, name: str) -> Column:
    """The named limit for a tier; no tier or an unknown one gets the free limit."""
    return (
        F.when(tier == "ultra", F.lit(LIMITS["ultra"][name]))
        .when(tier == "pro", F.lit(LIMITS["pro"][name]))
        .otherwise(F.lit(LIMITS["free"][name]))
        .cast("long")
    )
