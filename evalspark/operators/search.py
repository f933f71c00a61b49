"""Keyword search, facets and the paging rules they share."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.columns import metadata_text
from evalspark.operators.joins import dimension
from evalspark.operators.ranking import page, top_k_per_key

RESULT_COLUMNS = [
    "id",
    "dataset_id",
    "dataset_name",
    "question",
    "answer",
    "choices",
    "example_metadata",
    "score",
]


@dataclass(frozen=True)
class SearchRequest:
    """One search of a batch. ``vec_id`` or ``vector`` gives the vector side its query."""

    query_id: str
    query: str
    vec_id: int | None = None
    vector: tuple[float, ...] | None = None
    collection: str = "mmlu_embeddings"
    dataset_name: str | None = None
    subject: str | None = None
    task_type: str | None = None
    keyword_weight: float = 0.4
    semantic_weight: float = 0.6
    literal: bool = False

    def __post_init__(self):
        schemas.check_query(self.query)
        schemas.check_collection(self.collection)
        schemas.check_unit(self.keyword_weight, "keyword_weight")
        schemas.check_unit(self.semantic_weight, "semantic_weight")


def like_pattern(text: str, literal: bool = False) -> str:
    """``%text%``. Wildcards in the text stay live unless ``literal`` asks for plain matching."""
    if literal:
        text = re.sub(r"([\\%_])", r"\\\1", text)
    else:
        # A backslash that escapes nothing is dropped; the pattern language would reject it.
        text = re.sub(r"\\(?![\\%_])", "", text)
        if (len(text) - len(text.rstrip("\\"))) % 2:
            text = text[:-1]
    return f"%{text}%"


def matches(query: str, literal: bool = False) -> Column:
    """Question or answer contains the query; an unknown answer never removes a question hit."""
    pattern = like_pattern(query, literal)
    return F.col("question").ilike(pattern) | F.col("answer").ilike(pattern)


def with_dataset(examples: DataFrame, datasets: DataFrame) -> DataFrame:
    """Inner join to the dataset dimension."""
    dims = datasets.select(
        F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "task_type"
    )
    return examples.join(dimension(dims), "dataset_id")


def sort_order(sort_by: str) -> list[Column]:
    schemas.check_sort(sort_by)
    if sort_by == "newest":
        return [F.desc("created_at"), F.asc("id")]
    if sort_by == "dataset":
        return [F.asc("dataset_name"), F.asc("question"), F.asc("id")]
    return [F.asc("id")]


def keyword_search(
    examples: DataFrame,
    datasets: DataFrame,
    query: str,
    *,
    limit: int = 20,
    offset: int = 0,
    sort_by: str = "relevance",
    literal: bool = False,
    answers: DataFrame | None = None,
    **filters: str | None,
) -> tuple[DataFrame, DataFrame]:
    """One page of hits and a one-row frame with the number of all hits.

    ``answers`` (id, answer) is for tables that keep the answer apart, see ``match_requests``.
    """
    schemas.check_page(limit, offset)
    request = [SearchRequest("q", query, literal=literal, **filters)]
    order = sort_order(sort_by)
    matched = match_requests(examples, datasets, request, answers)
    total = matched.agg(F.count("*").alias("total"))
    if answers is None:
        rows = page(matched, order, limit, offset)
    elif sort_by == "dataset":
        # This order reads the question of every hit.
        texts = examples.select("id", "question")
        wanted = page(matched.join(texts, "id"), order, limit, offset)
        rows = fetch(examples, datasets, answers, wanted.select("id"))
    else:
        wanted = page(matched, order, limit, offset)
        rows = fetch(examples, datasets, answers, wanted.select("id"))
    return rows.withColumn("score", F.lit(None).cast("double")).select(*RESULT_COLUMNS), total


def fetch(
    examples: DataFrame, datasets: DataFrame, answers: DataFrame, ids: DataFrame
) -> DataFrame:
    """Whole rows of a bounded list of ids; the list cuts both tables before they meet."""
    ids = F.broadcast(ids.distinct())
    rows = examples.drop("answer").join(ids, "id", "left_semi")
    given = answers.select("id", "answer").join(ids, "id", "left_semi")
    return with_dataset(rows.join(given, "id", "left"), datasets)


def _found_by(df: DataFrame, requests: list[SearchRequest], columns: tuple[str, ...]) -> Column:
    """Ids of the requests a row satisfies by one of the texts and by subject; each text is lowered
    once."""
    texts = F.struct(*[F.lower(c).alias(c) for c in columns])

    def listed(text: Column) -> Column:
        found = []
        for request in requests:
            pattern = like_pattern(request.query, request.literal).lower()
            keep = reduce(Column.__or__, [text[c].like(pattern) for c in columns])
            if request.subject is not None:
                keep = keep & (metadata_text(df, "subject") == request.subject)
            found.append(F.when(keep, F.lit(request.query_id)))
        return F.array_compact(F.array(*found))

    return F.element_at(F.transform(F.array(texts), listed), 1)


def _in_dimension(requests: list[SearchRequest]) -> Column | None:
    """The dataset and task type filters of the requests that have some."""
    keep = None
    for r in requests:
        wanted = [(c, getattr(r, c)) for c in ("dataset_name", "task_type")]
        for name, value in wanted:
            if value is not None:
                rule = (F.col("query_id") != r.query_id) | (F.col(name) == value)
                keep = rule if keep is None else keep & rule
    return keep


def _asked_of_all(requests: list[SearchRequest], field: str) -> list[str]:
    """The values of a filter that every request sets; empty if one request leaves it open."""
    values = {getattr(r, field) for r in requests}
    return [] if None in values else sorted(values)


def match_requests(
    examples: DataFrame,
    datasets: DataFrame,
    requests: list[SearchRequest],
    answers: DataFrame | None = None,
) -> DataFrame:
    """Every (request, hit) pair, from one scan and without a join to the requests.

    Each request becomes one predicate; a row carries the list of requests it satisfies. Where the
    answers are a table of their own, questions are matched before the join, so that ids meet and
    texts are not shuffled; the pairs then carry ids only and ``fetch`` reads the rows.
    """
    schemas.check_batch(requests)
    # What every request of the batch asks for is a plain filter: it reaches the scan, and on a table
    # partitioned by dataset the dimension's filter prunes partitions.
    if subjects := _asked_of_all(requests, "subject"):
        examples = examples.where(metadata_text(examples, "subject").isin(subjects))
    for field, column in (("dataset_name", "name"), ("task_type", "task_type")):
        if wanted := _asked_of_all(requests, field):
            datasets = datasets.where(F.col(column).isin(wanted))
    if answers is None:
        base = examples
        found = _found_by(examples, requests, ("question", "answer"))
    else:
        keys = [c for c in ("id", "dataset_id", "subject", "example_metadata", "created_at") if c in examples.columns]
        if "subject" in keys:
            keys.remove("example_metadata")
        base = examples.select(
            *keys, _found_by(examples, requests, ("question",)).alias("by_question")
        ).join(answers.select("id", "answer"), "id", "left")
        found = F.array_union("by_question", _found_by(base, requests, ("answer",)))
    # The outer form keeps Spark from evaluating the list a second time in an inferred filter.
    pairs = base.withColumn("query_id", F.explode_outer(found))
    pairs = with_dataset(pairs.where(F.col("query_id").isNotNull()), datasets)
    keep = _in_dimension(requests)
    return pairs if keep is None else pairs.where(keep)


def keyword_lists(
    examples: DataFrame,
    datasets: DataFrame,
    requests: list[SearchRequest],
    k: int,
    answers: DataFrame | None = None,
) -> DataFrame:
    """The first ``k`` hits by id of every request, ranked from 1."""
    schemas.check_page(k, top=None)
    matched = match_requests(examples, datasets, requests, answers)
    no_score = F.lit(None).cast("double")
    if answers is None:
        rows = matched.withColumn("score", no_score).select("query_id", *RESULT_COLUMNS)
        return top_k_per_key(rows, ["query_id"], [F.asc("id")], k, spread=["id"])
    first = top_k_per_key(
        matched.select("query_id", "id"), ["query_id"], [F.asc("id")], k, spread=["id"]
    )
    rows = fetch(examples, datasets, answers, first.select("id")).withColumn("score", no_score)
    return first.join(rows.select(*RESULT_COLUMNS), "id").select(
        "query_id", *RESULT_COLUMNS, "rank"
    )


def keyword_totals(
    examples: DataFrame,
    datasets: DataFrame,
    requests: list[SearchRequest],
    answers: DataFrame | None = None,
) -> DataFrame:
    """Number of hits per request, zero included."""
    matched = match_requests(examples, datasets, requests, answers)
    counted = matched.groupBy("query_id").agg(F.count("*").alias("n"))
    asked = F.explode(F.array(*[F.lit(r.query_id) for r in requests])).alias("query_id")
    listed = examples.sparkSession.range(1).select(asked)
    return listed.join(counted, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0).cast("long")).alias("total")
    )


def facets(
    examples: DataFrame,
    datasets: DataFrame,
    query: str | None = None,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Counts by dataset, by (subject, dataset), by task type and in total, as one frame.

    Rows are first counted per (dataset, subject), so the dimension join and the grouping sets work
    on a handful of partial counts instead of on the examples.
    """
    if query and answers is None:
        examples = examples.where(matches(query))
    elif query:
        by_question = F.col("question").ilike(like_pattern(query))
        ids = examples.withColumn("by_question", by_question).drop("question", "answer")
        examples = ids.join(answers.select("id", "answer"), "id", "left").where(
            F.col("by_question") | F.col("answer").ilike(like_pattern(query))
        )
    counted = examples.groupBy(
        "dataset_id", metadata_text(examples, "subject").alias("subject")
    ).agg(F.count("*").alias("n"))
    sets = [["dataset_name"], ["subject", "dataset_name"], ["task_type"], []]
    level = F.grouping_id("dataset_name", "subject", "task_type")
    joined = with_dataset(counted, datasets).select("dataset_name", "subject", "task_type", "n")
    # An all-NULL row of zero keeps the total present when nothing matches.
    zero = examples.sparkSession.range(1).selectExpr(
        "cast(null as string) dataset_name", "cast(null as string) subject",
        "cast(null as string) task_type", "0L n",
    )
    grouped = (
        joined.unionByName(zero)
        .groupingSets(
            [[F.col(c) for c in names] for names in sets], "dataset_name", "subject", "task_type"
        )
        .agg(F.sum("n").alias("n"), level.alias("level"))
    )
    kind = (
        F.when(F.col("level") == 0b011, F.lit("dataset"))
        .when(F.col("level") == 0b001, F.lit("subject"))
        .when(F.col("level") == 0b110, F.lit("task_type"))
        .otherwise(F.lit("total"))
    )
    return (
        grouped.select(
            kind.alias("facet"),
            F.coalesce(
                F.when(kind == "dataset", F.col("dataset_name")),
                F.when(kind == "subject", F.col("subject")),
                F.when(kind == "task_type", F.col("task_type")),
            ).alias("name"),
            F.when(kind == "subject", F.col("dataset_name")).alias("dataset"),
            F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        )
        .where((F.col("facet") == "total") | F.col("name").isNotNull())
    )
