"""Quality classifier: Bradley-Terry ranking of documents by text features.

A document's strength is a weighted sum of its features. Weights are learned from preference pairs (a document
labelled 1 over one labelled 0) by logistic loss on the difference of their features. The decision threshold is a
quantile of the strengths of the labelled sample, the one that decides most of it rightly; the score is the logistic
function of strength minus threshold, so 0.5 is the threshold.

The fit reads a bounded sample: the ``LABELS`` labelled training rows with the smallest hash of their doc_id, and
``PAIRS`` drawn pairs. Only the texts decide: labels, language, source and doc_id are never features. Scoring
streams all documents once; nothing is shuffled.

Defined cases: null text counts as empty and is scored by its (zero) features. Labels that are null or neither 0 nor 1
are ignored; of repeated labels the smallest counts, of documents that repeat a doc_id the one with the smallest features. Empty
tables give empty results, and other columns than doc_id and text are not looked at. Without labels of both kinds all weights are 0 and
every score is 0.5 (predicted 1). A null doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.common import documents

LABELS = 20_000
PAIRS = 100_000
FEATURES = ["words", "word_bytes", "upper", "digit", "symbol", "shout", "mark", "line", "wide", "again1", "again2", "again3", "long_words"]
_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": [ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"],
    "shout": [ord(c) for c in "!?"],
    "mark": [ord(c) for c in ".,;:'\"-()"],
    "line": [10],
    "wide": range(192, 256),
}


def features(batch: pa.RecordBatch) -> np.ndarray:
    """One row of ``FEATURES`` per document."""
    data, offsets = ts.buffers(batch.column("text"))
    starts, ends, bounds = ts.words(data, offsets)
    n_words = np.diff(bounds)
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(n_words, 1)

    def per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[edges[1:]] - total[edges[:-1]]

    length = ends - starts
    columns = [np.log1p(n_words), per_row(length, bounds) / words]
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        columns.append(np.log1p(100 * per_row(table[data], offsets) / size))
    hashes = ts.span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    for back in (1, 2, 3):
        again = np.zeros(len(hashes), bool)
        if len(hashes) > back:
            again[back:] = (hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])
        columns.append(np.log1p(100 * per_row(again, bounds) / words))
    columns.append(np.log1p(100 * per_row(length > 20, bounds) / words))
    return np.stack(columns, axis=1).astype(float)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights, feature means and scales, and the threshold."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        width = x.shape[1] if x.ndim == 2 else len(FEATURES)
        return {"mean": np.zeros(width), "scale": np.ones(width), "weight": np.zeros(width), "threshold": 0.0}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    draw = np.random.Generator(np.random.PCG64(seed))
    gap = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    weight = np.zeros(gap.shape[1])
    for _ in range(25):  # Newton steps on the mean logistic loss with a small ridge
        p = 1 / (1 + np.exp(np.clip(gap @ weight, -30, 30)))
        slope = -(gap * p[:, None]).mean(axis=0) + 1e-3 * weight
        curve = (gap * (p * (1 - p))[:, None]).T @ gap / pairs + 1e-3 * np.eye(len(weight))
        step = np.linalg.solve(curve, slope)
        weight = weight - step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ weight
    order = np.argsort(strength, kind="stable")
    # Deciding right at each quantile: zeros below plus ones from there on.
    right = np.concatenate([[0], np.cumsum(y[order] == 0)]) + np.concatenate([np.cumsum((y[order] == 1)[::-1])[::-1], [0]])
    edge = np.concatenate([[strength[order[0]] - 1], (strength[order[1:]] + strength[order[:-1]]) / 2, [strength[order[-1]] + 1]])
    best = np.flatnonzero(right == right.max())
    return {"mean": mean, "scale": scale, "weight": weight, "threshold": float(edge[best[len(best) // 2]])}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ts.slices(batches, "text"):
        x = features(batch)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), lists], names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELS) -> dict[str, np.ndarray]:
    """Fit on the training labels. At most ``rows`` labelled rows reach the join's broadcast side and the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = joined.mapInArrow(feature_rows, "doc_id long, quality int, x array<double>")
    # One row for each doc_id, so that a repeated one brings no more than its share to the driver.
    found = found.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("low")).select("doc_id", "low.*").toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, len(FEATURES))
    return fit(x, found.column("quality").to_numpy())


def scored(docs: DataFrame, model: dict[str, np.ndarray], keep: bool = False) -> DataFrame:
    """doc_id and score of every row, and with ``keep`` the struct ``whole`` of all its columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("whole")] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text"):
            strength = ((features(batch) - model["mean"]) / model["scale"]) @ model["weight"] - model["threshold"]
            score = 1 / (1 + np.exp(-np.clip(strength, -500, 500)))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(score)], names=[*rest, "score"])

    return rows.mapInArrow(run, rows.drop("text").schema.add("score", "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: score and decision for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model accepts."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, keep=True).where("score >= 0.5").select(*[F.col("whole")[c].alias(c) for c in docs.columns])
