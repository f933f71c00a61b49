"""Merging ranked lists: reciprocal rank fusion, several passes, supplied rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import sanitize_literal
from evalspark.operators.ranking import number_rows
from evalspark.operators.search import RESULT_COLUMNS

RRF_K = 60
KEYWORD_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
# What a ranking model gets to see.
RANK_VIEW = {"rows": 50, "chars": 120}
EVALUATE_VIEW = {"rows": 40, "chars": 100}

# The lists merged here are short: each is the top of a search, at most the fetch cap per query.


def reciprocal_rank_fusion(
    keyword: DataFrame,
    semantic: DataFrame,
    keyword_weight: float | Column = KEYWORD_WEIGHT,
    semantic_weight: float | Column = SEMANTIC_WEIGHT,
    k: int = RRF_K,
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Sum of weight / (k + position) over both lists; the keyword row supplies the payload.

    Inputs carry the keys, ``id`` and a 1-based ``rank``. Ties keep the keyword list's order first.
    """
    keys = list(keys)
    payload = [c for c in keyword.columns if c not in (*keys, "id", "rank", "score")]

    def tagged(df: DataFrame, order: int, weight: float | Column) -> DataFrame:
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        return df.select(
            *keys,
            "id",
            (weight / (F.lit(k) + F.col("rank"))).alias("part"),
            F.struct(F.lit(order).alias("list"), F.col("rank").alias("rank")).alias("first"),
            F.struct(*payload).alias("payload") if payload else F.lit(0).alias("payload"),
        )

    both = tagged(keyword, 0, keyword_weight).unionByName(tagged(semantic, 1, semantic_weight))
    merged = both.groupBy(*keys, "id").agg(
        F.sum("part").alias("score"),
        F.min("first").alias("first"),
        F.min_by("payload", "first").alias("payload"),
    )
    ranked = number_rows(merged, keys, [F.desc("score"), F.asc("first")])
    kept = [F.col(f"payload.{c}").alias(c) for c in payload]
    return ranked.select(*keys, "id", *kept, "score", "rank")


def merge_passes(hits: DataFrame, limit: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First occurrence of every id over all passes, best score first, unscored rows last.

    ``hits`` carries ``pass_no``, the 1-based ``rank`` inside the pass, ``id`` and ``score``.
    ``total`` is the number of distinct ids of the key.
    """
    keys = list(keys)
    known = hits.where(F.col("id").isNotNull())
    first = number_rows(known, [*keys, "id"], [F.asc("pass_no"), F.asc("rank")], "_n")
    first = first.where(F.col("_n") == 1).drop("_n")
    order = [F.desc_nulls_last("score"), F.asc("pass_no"), F.asc("rank")]
    sized = number_rows(first, keys, order, "position").withColumn(
        "total", F.count("*").over(Window.partitionBy(*keys))
    )
    return sized.where(F.col("position") <= limit)


def apply_ranking(
    results: DataFrame, ranks: DataFrame, keys: tuple[str, ...] = ("query_id",), first: int | None = None
) -> DataFrame:
    """Rows in the supplied order, the others after them in their own order.

    ``ranks`` has (keys, id, position). Unknown ids fall away, a repeated id counts once. With ``first`` only the
    rows up to that rank are reordered.
    """
    keys = list(keys)
    best = ranks.groupBy(*keys, "id").agg(F.min("position").alias("position"))
    joined = results.join(best, [*keys, "id"], "left")
    if first is not None:
        joined = joined.withColumn("position", F.when(F.col("rank") <= first, F.col("position")))
    late = F.col("rank") > (F.lit(first) if first is not None else F.col("rank"))
    return number_rows(
        joined, keys, [late, F.asc_nulls_last("position"), F.asc("rank")], "final_rank"
    ).drop("position")


def rank_candidates(
    results: DataFrame, rows: int = RANK_VIEW["rows"], chars: int = RANK_VIEW["chars"]
) -> DataFrame:
    """The short, cleaned view of the first hits that a ranking or evaluating model reads."""

    def snippet(name: str) -> Column:
        return sanitize_literal(F.substring(F.coalesce(F.col(name), F.lit("")), 1, chars))

    subject = F.get_json_object("example_metadata", "$.subject")
    return results.where(F.col("rank") <= rows).select(
        "query_id",
        "rank",
        "id",
        snippet("question").alias("question"),
        snippet("answer").alias("answer"),
        F.coalesce("dataset_name", F.lit("")).alias("dataset"),
        sanitize_literal(F.coalesce(subject, F.lit(""))).alias("subject"),
    )


def pass_trace(hits: DataFrame, passes: DataFrame) -> DataFrame:
    """How many rows every pass returned, zero included. ``passes`` describes them."""
    counted = hits.groupBy("pass_no").agg(F.count("*").alias("n"))
    return passes.join(counted, "pass_no", "left").withColumn(
        "result_count", F.coalesce("n", F.lit(0).cast("long"))
    ).drop("n")


__all__ = [
    "RESULT_COLUMNS",
    "apply_ranking",
    "merge_passes",
    "pass_trace",
    "rank_candidates",
    "reciprocal_rank_fusion",
]
