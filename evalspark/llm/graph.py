"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id reachable (component) of every id in ``edges`` (a, b).

    Labels move along edges and then jump to their label's own label, so that rounds grow with the
    logarithm of a component's width. Each round is written to the shared folder; only the question
    whether anything changed reaches the driver. Minima are pre-aggregated, so a hub costs one row per task.
    """
    edges = edges.where("a <> b")
    pairs = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component"), F.lit(None).cast("long").alias("was")), "labels")
    while True:
        near = pairs.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        hooked = label.join(near, "id").select("id", F.least("component", "low").alias("hook"), F.col("component").alias("was"))
        jump = label.select(F.col("id").alias("hook"), F.col("component").alias("further"))
        label = stored(hooked.join(jump, "hook", "left").select("id", F.least("hook", F.coalesce("further", "hook")).alias("component"), "was"), "labels")
        if label.where("component <> was").isEmpty():
            return label.select("id", "component")
