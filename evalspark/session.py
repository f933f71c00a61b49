"""Session settings every job relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import evalspark

# Runtime SQL settings. All are per-session and safe to set on a running cluster session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Rows hold whole texts: without a bound in bytes, 10 000 long ones would make one Arrow batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Of a repeated key in a model's JSON answer the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}
PARTITIONS = "spark.sql.shuffle.partitions"
DEFAULT_PARTITIONS = "200"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it.

    Functions that run in Python workers are sent by value, so the executors need no copy of this
    package.
    """
    cloudpickle.register_pickle_by_value(evalspark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Stream state cannot be coalesced later; the default is far too wide for one machine only.
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get(PARTITIONS) == DEFAULT_PARTITIONS:
        spark.conf.set(PARTITIONS, str(context.defaultParallelism))
    return spark


def local_session(cpus: int = 8, app: str = "evalspark", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may fall back to a
    folder of this machine, because there the driver and the executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="evalspark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
