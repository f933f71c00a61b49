"""Composite searches: hybrid, fallback to keyword, parsed-and-ranked, several passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.model_json import search_params
from evalspark.operators import fusion, vector
from evalspark.operators.ranking import top_k_per_key
from evalspark.operators.search import (
    RESULT_COLUMNS,
    SearchRequest,
    fetch,
    keyword_lists,
    keyword_totals,
    match_requests,
    with_dataset,
)
from evalspark.operators.tables import written

# Fixed value: how many rows beyond the page each pass of a multi-pass search returns.
RANKED_EXTRA = 30


def pass_size(limit: int, offset: int) -> int:
    """Rows every pass returns; it grows with the page, so that no page is cut short."""
    return limit + offset + RANKED_EXTRA


def depth(request: SearchRequest, last: int, k: int = fusion.RRF_K) -> int:
    """How deep both lists have to be read so that the first ``last`` fused hits are among what was read.

    A hit beyond this depth in both lists scores less than (sum of weights) / (k + depth); the first ``last`` rows of
    the heavier list alone score at least its weight / (k + last). A list shorter than that is read whole.
    """
    heavier = max(request.keyword_weight, request.semantic_weight)
    if not heavier:
        return last
    share = (request.keyword_weight + request.semantic_weight) / heavier
    return max(last, math.ceil(share * (k + last)) - k)


@dataclass(frozen=True)
class Corpus:
    """What a search reads: examples, dataset dimension, vectors, their payload, and the answers
    where they are a table of their own."""

    examples: DataFrame
    datasets: DataFrame
    vectors: DataFrame
    payload: DataFrame
    answers: DataFrame | None = None

    def keyword_lists(self, requests: list[SearchRequest], k: int) -> DataFrame:
        return keyword_lists(self.examples, self.datasets, requests, k, self.answers)

    def matched(self, requests: list[SearchRequest]) -> DataFrame:
        return match_requests(self.examples, self.datasets, requests, self.answers)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Whole rows of a bounded list of ids."""
        if self.answers is not None:
            return fetch(self.examples, self.datasets, self.answers, ids)
        return with_dataset(self.examples.join(F.broadcast(ids.distinct()), "id", "left_semi"), self.datasets)

    def keyword_totals(self, requests: list[SearchRequest]) -> DataFrame:
        found = keyword_totals(self.examples, self.datasets, requests, self.answers)
        return found.withColumnRenamed("total", "keyword_total")


def _weight(requests: list[SearchRequest], field: str) -> Column:
    weight = F.lit(None).cast("double")
    for request in requests:
        value = F.lit(float(getattr(request, field)))
        weight = F.when(F.col("query_id") == request.query_id, value).otherwise(weight)
    return weight


@dataclass(frozen=True)
class Fused:
    """The first fused hits of each request (query_id, id, score, rank, by_keyword) and the sizes of the whole lists
    (query_id, total, keyword_total). Both are bounded by the depth of the page, not by the corpus."""

    hits: DataFrame
    totals: DataFrame


def _places(matched: DataFrame, wanted: dict[str, list[int]]) -> DataFrame:
    """Per request and number of a wanted id: how many matches precede it (kind ahead), and whether it is one (kind own)."""
    arrays = {name: np.array(sorted(own), np.int64) for name, own in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = {name: np.zeros(len(own) + 1, np.int64) for name, own in arrays.items()}
        own = {name: np.zeros(len(own) + 1, np.int64) for name, own in arrays.items()}
        for batch in batches:
            coded = batch.column("query_id").dictionary_encode()
            numbers, found = coded.indices.to_numpy(), batch.column("id").to_numpy()
            for code, name in enumerate(coded.dictionary.to_pylist()):
                if name in arrays:
                    mine = found[numbers == code]
                    after = np.searchsorted(arrays[name], mine, "right")
                    ahead[name] += np.bincount(after, minlength=len(arrays[name]) + 1)
                    hit = after[np.isin(mine, arrays[name])] - 1
                    own[name] += np.bincount(hit, minlength=len(arrays[name]) + 1)
        rows = [(n, kind, i, int(c)) for kind, all_counts in (("ahead", ahead), ("own", own)) for n, counts in all_counts.items() for i, c in enumerate(counts) if c]
        if rows:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["query_id", "kind", "place", "n"])

    return matched.mapInArrow(run, "query_id string, kind string, place long, n long")


def _in_both(matched: DataFrame, vectors: DataFrame, requests: list[SearchRequest], used: tuple[str, ...]) -> DataFrame:
    """Per request, how many keyword matches are points of its scope; ids meet ids, texts and vectors stay where they are."""
    fields = ("collection", *used)
    asked = matched.sparkSession.createDataFrame(
        [(r.query_id, *(getattr(r, f) for f in fields)) for r in requests],
        ", ".join(["query_id string", *(f"want_{f} string" for f in fields)]),
    )
    points = vectors.select(F.col("example_id").alias("id"), *fields)
    points = points.where(F.col("collection").isin(sorted({r.collection for r in requests})))
    keep = reduce(Column.__and__, [F.col(f"want_{f}").isNull() | (F.col(f"want_{f}") == F.col(f)) for f in fields])
    met = matched.join(F.broadcast(asked), "query_id").join(points, "id").where(keep)
    counted = met.groupBy("query_id").agg(F.count("*").alias("n"))
    return counted.select("query_id", F.lit("both").alias("kind"), F.lit(None).cast("long").alias("place"), "n")


def _lists_and_counts(
    lists: DataFrame | None, counts: DataFrame, requests: list[SearchRequest]
) -> tuple[dict[str, dict[int, int]], dict[tuple, int]]:
    """Ranks by request and id, and summed counters by (request, kind, place), in one job.

    Both are bounded by the candidates of a page: a few numbers for each.
    """
    rows = counts.groupBy("query_id", "kind", "place").agg(F.sum("n").alias("n"))
    if lists is not None:
        rows = rows.unionByName(lists.select("query_id", F.lit("list").alias("kind"), F.col("id").alias("place"), F.col("rank").alias("n")))
    ranks: dict[str, dict[int, int]] = {r.query_id: {} for r in requests}
    sums: dict[tuple, int] = {}
    for name, kind, place, n in rows.collect():
        if kind == "list":
            ranks[name][place] = n
        else:
            sums[name, kind, place] = n
    return ranks, sums


def fused_hits(
    corpus: Corpus, requests: list[SearchRequest], last: int, strict_filters: bool = False
) -> Fused:
    """The first ``last`` hits of both whole lists, fused per request: ranks and totals that no page changes.

    Keyword matches are written once, as ids. The first rows of each list (see :func:`depth`) are the only
    candidates. What a candidate of one list is in the other is found by counting, not by sorting: every task
    counts the rows that stand ahead of each candidate, and the counts add up to its place in the whole list.

    The vector branch only knows the subject filter; ``strict_filters`` makes it honour the dataset
    and task type too.
    """
    schemas.check_batch(requests)
    spark = corpus.examples.sparkSession
    reach = max(depth(r, last) for r in requests)
    matched = written(corpus.matched(requests).select("query_id", "id"), "matched")
    first = top_k_per_key(matched, ["query_id"], [F.asc("id")], reach, spread=["id"])
    sizes = matched.groupBy("query_id").agg(F.count("*").alias("n"))
    keyword, counted = _lists_and_counts(
        first.select("query_id", "id", "rank"), sizes.select("query_id", F.lit("all").alias("kind"), F.lit(None).cast("long").alias("place"), "n"), requests
    )
    whole = {name: n for (name, _, _), n in counted.items()}

    filters = ("subject", "dataset_name", "task_type") if strict_filters else ("subject",)
    asked = [r for r in vector.resolve_vectors(corpus.vectors, requests) if r.vector is not None]
    semantic: dict[str, dict[int, int]] = {}
    points: dict[str, int] = {}
    shared: dict[str, int] = {}
    if asked:
        vectors, used = vector.with_filters(corpus.vectors, corpus.payload, asked, filters)
        probes = vector.scores_of(vectors, asked, {n: list(own) for n, own in keyword.items()}, used)
        seen = written(vector.survey(vectors, asked, reach, probes, used), "survey")
        order = [F.desc("score"), F.asc("example_id")]
        top = top_k_per_key(seen.where("kind = 'top'"), ["query_id"], order, reach, spread=["example_id"])
        rest = seen.where("kind <> 'top'").select("query_id", "kind", F.col("example_id").alias("place"), "n")
        semantic, counted = _lists_and_counts(
            top.select("query_id", F.col("example_id").alias("id"), "rank"), rest, requests
        )
        points = {name: n for (name, kind, _), n in counted.items() if kind == "all"}
        for name, own in probes.items():
            before = 0
            for i, (_, example_id) in enumerate(own):
                before += counted.get((name, "ahead", i), 0)
                semantic[name].setdefault(example_id, before + 1)
        # Candidates of the vector side that the keyword list has further down.
        wanted = {n: sorted(set(own) - set(keyword[n])) for n, own in semantic.items()}
        met = _in_both(matched, vectors, asked, used)
        _, counted = _lists_and_counts(None, met.unionByName(_places(matched, wanted)), requests)
        shared = {name: n for (name, kind, _), n in counted.items() if kind == "both"}
        for name, own in wanted.items():
            before = 0
            for i, example_id in enumerate(own):
                before += counted.get((name, "ahead", i), 0)
                if (name, "own", i) in counted:
                    keyword[name][example_id] = before + 1

    def listed(ranks: dict[str, dict[int, int]], flag: bool) -> DataFrame:
        rows = [(name, i, rank, flag) for name, own in ranks.items() for i, rank in own.items()]
        return spark.createDataFrame(rows, "query_id string, id long, rank long, by_keyword boolean")

    hits = fusion.reciprocal_rank_fusion(
        listed(keyword, True),
        listed(semantic, False),
        _weight(requests, "keyword_weight"),
        _weight(requests, "semantic_weight"),
    )
    totals = [(n, whole.get(n, 0) + points.get(n, 0) - shared.get(n, 0), whole.get(n, 0)) for n in keyword]
    totals = spark.createDataFrame(totals, "query_id string, total long, keyword_total long")
    return Fused(hits.where(F.col("rank") <= last), totals)


def _shown(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """The hits of a page with the row they show: the example where the keyword side found it, else the stored payload."""
    extra = [c for c in hits.columns if c not in ("query_id", "id", "score", "by_keyword")]
    found = hits.where("by_keyword")
    rows = corpus.fetch(found.select("id")).select(*[c for c in RESULT_COLUMNS if c != "score"])
    by_keyword = found.join(rows, "id")
    near = hits.where("NOT by_keyword").withColumnRenamed("id", "example_id")
    kept = ["query_id", *RESULT_COLUMNS, *extra]
    by_vector = vector.with_payload(near, corpus.payload, extra)
    return by_keyword.select(*kept).unionByName(by_vector.select(*kept))


def hybrid_search(
    corpus: Corpus,
    requests: list[SearchRequest],
    limit: int = 20,
    offset: int = 0,
    strict_filters: bool = False,
    max_limit: int = schemas.MAX_PAGE,
) -> DataFrame:
    """One page of fused hits per request, with ``rank``, ``total`` (all ids of both whole lists) and
    ``keyword_total`` (all keyword matches). Neither depends on the page."""
    schemas.check_page(limit, offset, max_limit)
    fused = fused_hits(corpus, requests, offset + limit, strict_filters)
    page = _shown(corpus, fused.hits.where(F.col("rank") > offset))
    return page.join(F.broadcast(fused.totals), "query_id")


def hybrid_with_fallback(
    corpus: Corpus,
    requests: list[SearchRequest],
    limit: int = 20,
    offset: int = 0,
    max_limit: int = schemas.MAX_PAGE,
) -> DataFrame:
    """Hybrid where the request's collection holds vectors, keyword search where it does not.

    ``total`` counts the ids of both whole lists or, in keyword mode, all matches; ``keyword_total`` counts
    all matches in both modes.
    """
    present = vector.collections_present(
        corpus.vectors, sorted({r.collection for r in requests})
    )
    able = [r for r in requests if r.collection in present]
    rest = [r for r in requests if r.collection not in present]
    parts = []
    columns = ["query_id", *RESULT_COLUMNS, "rank", "total", "keyword_total"]
    if able:
        found = hybrid_search(corpus, able, limit, offset, max_limit=max_limit)
        parts.append(found.select(*columns, F.lit("hybrid").alias("mode")))
    if rest:
        found = corpus.keyword_lists(rest, limit + offset)
        found = found.where(F.col("rank") > offset).join(corpus.keyword_totals(rest), "query_id")
        found = found.withColumn("total", F.col("keyword_total"))
        parts.append(found.select(*columns, F.lit("keyword").alias("mode")))
    return reduce(DataFrame.unionByName, parts)


def assisted_search(
    corpus: Corpus,
    requests: list[SearchRequest],
    ranks: DataFrame,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Hybrid over already parsed requests, reordered by a supplied ranking, then paged.

    A ranking speaks about the first ``RANK_VIEW`` rows, which are what a ranking model was shown; all others follow in
    fused order. So pages and ``total`` fit together whatever the page.
    """
    schemas.check_page(limit, offset)
    shown = fusion.RANK_VIEW["rows"]
    last = max(shown, offset + limit)
    found = hybrid_with_fallback(corpus, requests, last, max_limit=last)
    ordered = fusion.apply_ranking(found, ranks, first=shown)
    return ordered.where((F.col("final_rank") > offset) & (F.col("final_rank") <= offset + limit))


def parsed_requests(
    requests: list[SearchRequest], responses: DataFrame
) -> list[SearchRequest]:
    """Requests rewritten by a model's answers. ``responses`` has (query_id, response).

    The batch is bounded, so the parsed parameters are read back as one short list. The parsed task
    type is reported by the parser but does not filter.
    """
    schemas.check_batch(requests)
    originals = {r.query_id: r for r in requests}
    original = F.lit(None).cast("string")
    for r in requests:
        original = F.when(F.col("query_id") == r.query_id, F.lit(r.query)).otherwise(original)
    parsed = (
        responses.where(F.col("query_id").isin(list(originals)))
        .select("query_id", search_params(F.col("response"), original).alias("p"))
        .limit(len(requests))
        .collect()
    )
    by_id = {row["query_id"]: row["p"] for row in parsed}
    out = []
    for query_id, request in originals.items():
        params = by_id.get(query_id)
        if params is None:
            out.append(request)
            continue
        out.append(
            replace(
                request,
                query=params["search_query"],
                dataset_name=params["dataset"],
                subject=params["subject"],
            )
        )
    return out


@dataclass(frozen=True)
class Pass:
    """One pass of a multi-pass search."""

    tool: str
    request: SearchRequest


def run_passes(
    corpus: Corpus, passes: list[Pass], limit: int = 20, offset: int = 0
) -> DataFrame:
    """All rows of all passes with ``pass_no``; unknown tools run as hybrid.

    Passes of one tool run as one batch, so the corpus is read once per tool, not once per pass.
    """
    if not 1 <= len(passes) <= schemas.MAX_PASSES:
        raise ValueError(f"1..{schemas.MAX_PASSES} passes")
    fetch = pass_size(limit, offset)
    by_tool: dict[str, list[SearchRequest]] = {}
    for number, step in enumerate(passes):
        tool = step.tool if step.tool in ("keyword_search", "semantic_search") else "hybrid"
        by_tool.setdefault(tool, []).append(replace(step.request, query_id=str(number)))
    parts = []
    for tool, requests in by_tool.items():
        if tool == "keyword_search":
            found = corpus.keyword_lists(requests, fetch)
        elif tool == "semantic_search":
            found = vector.semantic_search(corpus.vectors, corpus.payload, requests, fetch)
        else:
            found = hybrid_with_fallback(corpus, requests, fetch, max_limit=fetch)
        parts.append(
            found.select(*RESULT_COLUMNS, "rank", F.col("query_id").cast("int").alias("pass_no"))
        )
    return reduce(DataFrame.unionByName, parts)


def multi_pass_search(
    corpus: Corpus, passes: list[Pass], limit: int = 20, offset: int = 0
) -> DataFrame:
    """Passes merged: first occurrence per id, best score first, one page of them."""
    schemas.check_page(limit, offset)
    rows = run_passes(corpus, passes, limit, offset).withColumn("query_id", F.lit("all"))
    return fusion.merge_passes(rows, offset + limit).where(F.col("position") > offset)
