"""A training-data pipeline over ``documents``: classifier, line, near-duplicate and substring dedup, packing.

Each stage reads the whole Parquet output of the one before it; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import line_dedup, minhash, packing, quality_model, substring_dedup
from evalspark.llm.common import stored
from evalspark.session import configure

STAGES = [
    ("quality_model", quality_model.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash", minhash.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]

# No SQL: the stages learn weights, sketch and tokenize. The tests hold each of them against plain Python, see test_plain_versions.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
