"""The embedding job: texts become vectors, stand with their payload in the vector store, and the job tells its figures."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import embedding_text
from evalspark.operators.tables import written
from evalspark.operators.vector import EmbeddingProvider, embed_texts, payload_of
from evalspark.operators.vector_store import PAYLOAD, VectorStore

STATS_SCHEMA = (
    "collection string, model string, dims int, embedded long, stored long, buckets int, elapsed_seconds double, examples_per_second double"
)


def collection_of(dataset: str) -> str:
    """The collection that holds a dataset's vectors."""
    return f"{dataset.lower()}_embeddings"


def embed_into(
    store: VectorStore,
    collection: str,
    examples: DataFrame,
    datasets: DataFrame,
    provider: Callable[[], EmbeddingProvider],
    batch_size: int = 100,
    metric: str = "COSINE",
) -> DataFrame:
    """Embeds the examples and upserts them with their payload; one row of figures comes back.

    The payload travels through the embedding with its text, so nothing is joined to the vectors. Embedded rows are written before
    the upsert: a lost executor or a failed upsert repeats no call of the model that was answered. Running the job
    again replaces the points by id.
    """
    started = time.monotonic()
    model = provider()
    store.create(collection, model.dimensions, metric)
    text = embedding_text(F.col("question"), F.col("choices")).alias("text")
    rows = payload_of(examples, datasets, text)
    points = written(embed_texts(rows, provider, batch_size, list(PAYLOAD)).withColumn("batch", F.lit(0)), "embedded")
    replaced = store.upsert(collection, points)
    embedded = points.count()
    stored = store.points().where(F.col("collection") == collection).count() if replaced else 0
    took = time.monotonic() - started
    figures = (collection, model.model_name, model.dimensions, embedded, stored, len(replaced), took, embedded / took if took > 0 else 0.0)
    return store.spark.createDataFrame([figures], STATS_SCHEMA)


def embed_dataset(
    store: VectorStore, dataset: str, examples: DataFrame, datasets: DataFrame, provider: Callable[[], EmbeddingProvider], **options
) -> DataFrame:
    """The job over one dataset, into a collection named after it."""
    wanted = datasets.where(F.col("name") == dataset)
    if wanted.isEmpty():
        raise ValueError(f"no dataset {dataset}")
    mine = examples.join(wanted.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    return embed_into(store, collection_of(dataset), mine, datasets, provider, **options)
