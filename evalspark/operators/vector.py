"""Exact nearest-neighbour search, the vector table's upkeep, and the embedding job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.columns import embedding_text, metadata_text
from evalspark.operators.joins import dimension
from evalspark.operators.ranking import spread, top_k_per_key
from evalspark.operators.search import RESULT_COLUMNS, SearchRequest

METRICS = ("COSINE", "EUCLID", "DOT")
PAYLOAD_CHARS = 500
# Scores are ranked at this precision, so that equal vectors tie whatever the summation order.
SCORE_DIGITS = 9
BLOCK_ROWS = 8192

HIT_SCHEMA = "query_id string, example_id long, score double"


def resolve_vectors(vectors: DataFrame, requests: list[SearchRequest]) -> list[SearchRequest]:
    """Fills in the query vector of requests that name a stored point.

    A request batch is bounded, so this point lookup returns at most that many vectors.
    """
    schemas.check_batch(requests)
    wanted = sorted({r.vec_id for r in requests if r.vector is None and r.vec_id is not None})
    if not wanted:
        return requests
    rows = (
        vectors.where(F.col("example_id").isin(wanted))
        .select("example_id", "vector")
        .dropDuplicates(["example_id"])
        .collect()
    )
    known = {row["example_id"]: tuple(row["vector"]) for row in rows}
    return [
        r if r.vector is not None else replace(r, vector=known.get(r.vec_id)) for r in requests
    ]


def _similarities(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries scores in double precision; larger is nearer, so distances are negative."""
    if metric == "EUCLID":
        return -np.stack([np.linalg.norm(block - q, axis=1) for q in queries], axis=1)
    dots = block @ queries.T
    if metric == "DOT":
        return dots
    norms = np.linalg.norm(block, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _scopes(
    requests: list[SearchRequest], filters: tuple[str, ...]
) -> dict[tuple[tuple[str, str], ...], list[SearchRequest]]:
    """Requests grouped by what a point has to equal: the collection and the filters that are set."""
    scopes: dict[tuple[tuple[str, str], ...], list[SearchRequest]] = {}
    for request in requests:
        wanted = [("collection", request.collection)]
        wanted += [(f, getattr(request, f)) for f in filters if getattr(request, f) is not None]
        scopes.setdefault(tuple(wanted), []).append(request)
    return scopes


def _scored(
    batch: pa.RecordBatch,
    scopes: dict[tuple[tuple[str, str], ...], list[SearchRequest]],
    queries: dict[tuple[tuple[str, str], ...], np.ndarray],
    metric: str,
) -> Iterator[tuple[SearchRequest, np.ndarray, np.ndarray]]:
    """(request, ids, rounded scores) of the batch's points inside each request's scope, block by block."""
    ids, column = batch.column("example_id").to_numpy(zero_copy_only=False), batch.column("vector")
    for scope, group in scopes.items():
        mask = np.ones(batch.num_rows, dtype=bool)
        for name, value in scope:
            equal = pc.fill_null(pc.equal(batch.column(name), value), False)
            mask &= equal.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(mask)
        width = queries[scope].shape[1]
        for start in range(0, len(rows), BLOCK_ROWS):
            part = rows[start : start + BLOCK_ROWS]
            flat = column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)
            block = flat.astype(np.float64).reshape(len(part), width)
            scores = np.round(_similarities(block, queries[scope], metric), SCORE_DIGITS)
            for j, request in enumerate(group):
                yield request, ids[part], scores[:, j]


def _keep_best(
    held: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, scores: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the held points and the new ones."""
    if held is not None:
        ids, scores = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _scorer(
    requests: list[SearchRequest],
    filters: tuple[str, ...],
    k: int,
    threshold: float | None,
    metric: str,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores a partition block by block and keeps only k candidates per query in memory."""
    scopes = _scopes(requests, filters)
    # A distance passes when it is at most the threshold, a similarity when it is at least that.
    least = -threshold if threshold is not None and metric == "EUCLID" else threshold
    queries = {
        scope: np.asarray([r.vector for r in group], dtype=np.float64)
        for scope, group in scopes.items()
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for request, ids, scores in _scored(batch, scopes, queries, metric):
                if least is not None:
                    passed = scores >= least
                    ids, scores = ids[passed], scores[passed]
                best[request.query_id] = _keep_best(best.get(request.query_id), ids, scores, k)
        for query_id, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_id] * len(ids), pa.string()), pa.array(ids), pa.array(scores)],
                names=["query_id", "example_id", "score"],
            )

    return run


def nearest(
    vectors: DataFrame,
    requests: list[SearchRequest],
    k: int,
    threshold: float | None = None,
    metric: str = "COSINE",
    filters: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, example_id, score, rank) of the k nearest points in each request's collection.

    Every task reads its own vectors once, multiplies them with the bounded query matrix and emits
    at most k rows per request, so the shuffle carries candidates, never vectors. ``filters`` names
    columns of ``vectors`` that have to equal the request's field of the same name before ranking.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    schemas.check_page(k, top=None)
    requests = [r for r in resolve_vectors(vectors, requests) if r.vector is not None]
    if not requests:
        return vectors.sparkSession.createDataFrame([], f"{HIT_SCHEMA}, rank long")
    collections = sorted({r.collection for r in requests})
    scored = (
        vectors.where(F.col("collection").isin(collections))
        .select("collection", "example_id", "vector", *filters)
        .mapInArrow(_scorer(requests, filters, k, threshold, metric), HIT_SCHEMA)
    )
    best = top_k_per_key(
        scored, ["query_id"], [F.desc("score"), F.asc("example_id")], k, spread=["example_id"]
    )
    return best.withColumn("score", F.abs("score")) if metric == "EUCLID" else best


def _ahead(ids: np.ndarray, scores: np.ndarray, probes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many points stand ahead of each probe and of all probes after it only: one entry per probe, one for the rest.

    ``probes`` (ids, scores) are in list order. A probe's own point counts for the probes behind it.
    """
    probe_ids, probe_scores = probes
    place = np.searchsorted(-probe_scores, -scores, "left")
    tied = np.flatnonzero(np.searchsorted(-probe_scores, -scores, "right") > place)
    for i in tied:
        # Among equal scores the id decides.
        end = np.searchsorted(-probe_scores, -scores[i], "right")
        place[i] += np.searchsorted(probe_ids[place[i] : end], ids[i], "right")
    known = {int(x): j for j, x in enumerate(probe_ids)}
    for i in np.flatnonzero(np.isin(ids, probe_ids)):
        place[i] = known[int(ids[i])] + 1
    return np.bincount(place, minlength=len(probe_ids) + 1)


def _surveyor(
    requests: list[SearchRequest],
    filters: tuple[str, ...],
    k: int,
    metric: str,
    probes: dict[str, tuple[np.ndarray, np.ndarray]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One task's k nearest points, number of points, and points ahead of each probe, per request."""
    scopes = _scopes(requests, filters)
    queries = {s: np.asarray([r.vector for r in group], dtype=np.float64) for s, group in scopes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size: dict[str, int] = {}
        ahead: dict[str, np.ndarray] = {}
        for batch in batches:
            for request, ids, scores in _scored(batch, scopes, queries, metric):
                name = request.query_id
                best[name] = _keep_best(best.get(name), ids, scores, k)
                size[name] = size.get(name, 0) + len(ids)
                if name in probes:
                    counted = _ahead(ids, scores, probes[name])
                    ahead[name] = ahead[name] + counted if name in ahead else counted
        rows = [(n, "top", int(i), float(x), 1) for n, (ids, scores) in best.items() for i, x in zip(ids, scores)]
        rows += [(n, "all", None, None, count) for n, count in size.items()]
        rows += [(n, "ahead", i, None, int(c)) for n, counted in ahead.items() for i, c in enumerate(counted) if c]
        if rows:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64())
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "kind", "example_id", "score", "n"])

    return run


def scores_of(
    vectors: DataFrame, requests: list[SearchRequest], wanted: dict[str, list[int]], filters: tuple[str, ...], metric: str = "COSINE"
) -> dict[str, list[tuple[float, int]]]:
    """(score, id) of the wanted points of each request that lie in its scope, in list order.

    ``wanted`` is bounded like a page; it cuts the vectors by a broadcast semi join before they are scored.
    """
    spark = vectors.sparkSession
    ids = sorted({i for own in wanted.values() for i in own})
    requests = [r for r in requests if wanted.get(r.query_id)]
    if not requests:
        return {}
    listed = F.broadcast(spark.createDataFrame([(i,) for i in ids], "example_id long"))
    near = vectors.join(listed, "example_id", "left_semi").select("collection", "example_id", "vector", *filters)
    found = near.mapInArrow(_scorer(requests, filters, len(ids), None, metric), HIT_SCHEMA).collect()
    chosen = {name: set(own) for name, own in wanted.items()}
    out: dict[str, list[tuple[float, int]]] = {}
    for query_id, example_id, score in found:
        if example_id in chosen[query_id]:
            out.setdefault(query_id, []).append((score, example_id))
    return {name: sorted(own, key=lambda hit: (-hit[0], hit[1])) for name, own in out.items()}


SURVEY_SCHEMA = "query_id string, kind string, example_id long, score double, n long"


def survey(
    vectors: DataFrame,
    requests: list[SearchRequest],
    k: int,
    probes: dict[str, list[tuple[float, int]]],
    filters: tuple[str, ...] = (),
    metric: str = "COSINE",
) -> DataFrame:
    """One scan of the vectors: kind ``top`` (each task's k nearest), ``all`` (points in scope) and ``ahead`` (points that
    stand before probe number ``example_id`` and not before an earlier one), per request."""
    arrays = {n: (np.array([i for _, i in own], np.int64), np.array([s for s, _ in own])) for n, own in probes.items()}
    collections = sorted({r.collection for r in requests})
    rows = vectors.where(F.col("collection").isin(collections)).select("collection", "example_id", "vector", *filters)
    return rows.mapInArrow(_surveyor(requests, filters, k, metric, arrays), SURVEY_SCHEMA)


def with_payload(found: DataFrame, payload: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Joins the stored payload to the hits; a point without payload keeps its own id.

    Hits are bounded (fetch cap x batch), so they reduce the payload table by a broadcast semi join
    before the outer join; the payload is never shuffled whole.
    """
    ids = found.select(F.col("example_id").alias("id")).distinct()
    needed = payload.join(F.broadcast(ids), "id", "left_semi")
    metadata = F.to_json(
        F.struct(F.col("subject"), F.col("split")), {"ignoreNullFields": "false"}
    )
    return (
        found.withColumnRenamed("example_id", "id")
        .join(needed, "id", "left")
        .withColumn("answer", F.lit(None).cast("string"))
        .withColumn("choices", F.lit(None).cast("array<string>"))
        .withColumn("example_metadata", metadata)
        .withColumn("question", F.coalesce("question", F.lit("")))
        .withColumn("dataset_name", F.coalesce("dataset_name", F.lit("")))
        .select("query_id", *RESULT_COLUMNS, *(extra or ["rank"]))
    )


def payload_of(examples: DataFrame, datasets: DataFrame, *more: Column) -> DataFrame:
    """What is stored beside each vector, and ``more`` columns of the examples."""
    names = datasets.select(
        F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "task_type"
    )
    return examples.join(dimension(names), "dataset_id", "left").select(
        "id",
        "dataset_id",
        "dataset_name",
        "task_type",
        F.substring("question", 1, PAYLOAD_CHARS).alias("question"),
        metadata_text(examples, "subject").alias("subject"),
        metadata_text(examples, "split").alias("split"),
        *more,
    )


def with_filters(
    vectors: DataFrame, payload: DataFrame, requests: list[SearchRequest], filters: tuple[str, ...]
) -> tuple[DataFrame, tuple[str, ...]]:
    """The vectors with the filter columns that some request sets, and the names of those."""
    used = tuple(f for f in filters if any(getattr(r, f) is not None for r in requests))
    missing = [f for f in used if f not in vectors.columns]
    if missing:
        stored = payload.select(F.col("id").alias("example_id"), *missing)
        vectors = vectors.join(stored, "example_id", "left")
    return vectors, used


def semantic_search(
    vectors: DataFrame,
    payload: DataFrame,
    requests: list[SearchRequest],
    limit: int = 20,
    score_threshold: float | None = None,
    subject: str | None = None,
    filters: tuple[str, ...] = ("subject",),
) -> DataFrame:
    """Nearest points with their payload. The filters act before the ranking.

    ``subject`` sets one subject for all requests. Filter columns come from the vector table where
    it stores them, else from the payload, and only when a request asks for them.
    """
    if score_threshold is not None:
        schemas.check_unit(score_threshold, "score_threshold")
    if subject is not None:
        requests = [replace(r, subject=subject) for r in requests]
    requests = resolve_vectors(vectors, requests)
    vectors, used = with_filters(vectors, payload, requests, filters)
    found = nearest(vectors, requests, limit, score_threshold, filters=used)
    return with_payload(found, payload)


def collections_present(vectors: DataFrame, names: list[str]) -> set[str]:
    """Which of a bounded list of collections hold at least one vector."""
    rows = vectors.where(F.col("collection").isin(names)).select("collection").distinct()
    return {row["collection"] for row in rows.limit(len(names)).collect()}


def _pair_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine of each row's vector and probe, which are of one width."""

    def numbers(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = numbers(batch.column("vector")), numbers(batch.column("probe"))
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("vector")).to_numpy())[:-1]])
        dots, left, right = (np.add.reduceat(x, starts) for x in (one * two, one * one, two * two))
        norms = np.sqrt(left) * np.sqrt(right)
        scores = np.round(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), SCORE_DIGITS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("collection"), batch.column("example_id"), pa.array(scores)],
            names=["collection", "neighbour_id", "score"],
        )


def audit(vectors: DataFrame, neighbours: int = 3) -> DataFrame:
    """Per collection: size, dimensions, a sample point, and the sample's own neighbours; any number of collections.

    Samples are a table that is joined, one per collection, and its neighbours are ranked by salted top-k: nothing
    reaches the driver. Vectors of another width than the sample are no neighbours of it.
    """
    dims = F.size("vector")
    facts = vectors.groupBy("collection").agg(
        F.count("*").alias("points"),
        F.min(dims).cast("long").alias("min_dims"),
        F.max(dims).cast("long").alias("max_dims"),
        F.min("example_id").alias("sample_id"),
    )
    chosen = facts.select("collection", F.col("sample_id").alias("example_id"))
    samples = vectors.join(chosen, ["collection", "example_id"]).dropDuplicates(["collection"])
    samples = samples.select("collection", F.col("vector").alias("probe"))
    paired = vectors.select("collection", "example_id", "vector").join(samples, "collection")
    paired = paired.where((dims == F.size("probe")) & (dims > 0))
    scored = paired.mapInArrow(_pair_scores, "collection string, neighbour_id long, score double")
    order = [F.desc("score"), F.asc("neighbour_id")]
    found = top_k_per_key(scored, ["collection"], order, neighbours, spread=["neighbour_id"])
    return facts.join(found, "collection", "left")


def upsert(stored: DataFrame, incoming: DataFrame, dims: int) -> DataFrame:
    """Last write per (collection, example_id) wins; vectors of another width are rejected.

    Stored rows are unique already, so only the incoming rows are ranked; the stored side is just
    an anti join.
    """
    key = ["collection", "example_id"]
    newest = top_k_per_key(
        incoming, key, [F.desc("batch")], 1, rank="_latest", spread=["batch"]
    ).drop("_latest")
    checked = newest.withColumn(
        "vector",
        F.when(F.size("vector") == dims, F.col("vector")).otherwise(
            F.raise_error(F.lit(f"vector width differs from {dims}")).cast("array<float>")
        ),
    )
    return stored.join(newest.select(*key), key, "left_anti").unionByName(checked)


class EmbeddingProvider(Protocol):
    """What an embedding model has to offer; built once per Python worker."""

    dimensions: int
    model_name: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Offline provider: signed feature hashing of the words, scaled to unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.model_name = f"hashing-{dimensions}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                code = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
                out[i, (code >> 1) % self.dimensions] += 1.0 if code & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0).tolist()


def embed_texts(
    rows: DataFrame, provider: Callable[[], EmbeddingProvider], batch_size: int = 100, carry: list[str] | None = None
) -> DataFrame:
    """(example_id, vector) of rows with id and text, and the columns in ``carry`` as they were.

    ``provider`` is called once per task. A missing text counts as empty; a model that answers with another number of
    vectors than it was given texts ends the job.
    """
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = model.embed_batch([text or "" for text in part.column("text").to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                columns = [part.column("id"), pa.array(vectors, pa.list_(pa.float32())), *[part.column(c) for c in carry]]
                yield pa.RecordBatch.from_arrays(columns, names=["example_id", "vector", *carry])

    given = rows.select(F.col("id").cast("long").alias("id"), "text", *carry)
    kinds = dict(given.dtypes)
    schema = ", ".join(["example_id long, vector array<float>", *[f"`{c}` {kinds[c]}" for c in carry]])
    return spread(given, "id").mapInArrow(run, schema)


def embed(
    examples: DataFrame,
    provider: Callable[[], EmbeddingProvider],
    batch_size: int = 100,
) -> DataFrame:
    """(example_id, vector) of every example."""
    texts = examples.select("id", embedding_text(F.col("question"), F.col("choices")).alias("text"))
    return embed_texts(texts, provider, batch_size)
