"""Line dedup: sharded minimal perfect hashes over repeated line hashes, probed by the documents' lines.

1. Each task hashes its lines (128 bits of the stripped, A-Z lowered key) and emits one small row per
   long enough line.
2. Counts and the largest doc_id per key are pre-aggregated; keys below the bound go.
3. The other keys are dealt to shards of about ``SHARD_KEYS``. A shard becomes one minimal perfect hash with
   a fingerprint array, a count array and a keeper array (one row of a table).
4. Line rows are routed to their shard, salted by row, behind a copy of the shard's arrays. A task
   holds one shard at a time and streams its lines, so a line that a third of all documents hold is
   spread over ``SALTS`` tasks and never gathered.
5. The numbers of the lines to drop, one list per document, meet the texts.

Defined cases: null text counts as one empty line. Rows that repeat a doc_id count as documents of
their own; all rows with the largest doc_id keep the line. A null doc_id is smaller than all others.
Empty tables give empty results. Further columns are never read by :func:`dropped_lines` and pass
through :func:`dedup` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.common import keyed, replaced_text, stored

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 16
SALTS = 16
NO_ID = -(1 << 63)
LINE_SCHEMA = "h1 long, h2 long, doc_id long, row binary, line_no int, first boolean"
SHARD_SCHEMA = "shard long, seed long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary"


def line_table(batch: pa.RecordBatch, min_chars: int) -> dict[str, np.ndarray]:
    """Hashes, source row and number of every line of a batch whose key has ``min_chars`` code points."""
    data, offsets = ts.buffers(batch.column("text"))
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.argsort(doc, kind="stable")
    doc, start = doc[order], np.concatenate([offsets[:-1], breaks + 1])[order]
    end = offsets[1:][doc]
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    end[inner] = start[inner + 1] - 1
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    solid = np.flatnonzero(~ts.SPACE[data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = (high > low) & (end - start >= min_chars)
    low, high, doc, number = low[some], high[some], doc[some], number[some]
    start, end = solid[low], solid[high - 1] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[end] - points[start] >= min_chars
    start, end, doc, number = start[long], end[long], doc[long], number[long]
    return {
        "h1": ts.span_hashes(data, start, end, lower=True).view(np.int64),
        "h2": ts.span_hashes(data, start, end, lower=True, table=1).view(np.int64),
        "doc": doc,
        "line_no": number.astype(np.int32),
    }


def scan_lines(min_chars: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text"):
            t = line_table(batch, min_chars)
            order = np.lexsort((t["line_no"], t["h2"], t["h1"], t["doc"]))
            t = {k: v[order] for k, v in t.items()}
            first = np.ones(len(order), bool)
            first[1:] = (t["doc"][1:] != t["doc"][:-1]) | (t["h1"][1:] != t["h1"][:-1]) | (t["h2"][1:] != t["h2"][:-1])
            take = pa.array(t["doc"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t["h1"]), pa.array(t["h2"]), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(t["line_no"]), pa.array(first)],
                names=["h1", "h2", "doc_id", "row", "line_no", "first"],
            )

    return scan


class PerfectHash:
    """Level-wise minimal perfect hash: a key takes the first level where its place is its own.

    The rank of its bit among all levels is its number. Keys outside the set may get a number too;
    the fingerprint at that number tells them apart.
    """

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (ts.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct 64-bit numbers."""
        sizes, flags, left = [], [], keys
        while len(left):
            size = -(-max(64, cls.GAMMA * len(left)) // 64) * 64
            spot = cls.place(left, len(sizes), size)
            count = np.bincount(spot, minlength=size)
            flags.append(count == 1)
            sizes.append(size)
            left = left[count[spot] != 1]
        flags = np.concatenate(flags) if flags else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little").view(np.uint64))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            spot = self.place(keys[left], level, int(size)) + self.base[level]
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


def folded(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """One number for each key of two hashes."""
    return ts.mix(h1 + np.uint64(0xD1342543DE82EF95 * seed % (1 << 64))) ^ ts.mix(h2 + np.uint64(seed))


def build_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    h1 = frame["h1"].to_numpy(np.int64).view(np.uint64)
    h2 = frame["h2"].to_numpy(np.int64).view(np.uint64)
    # Distinct keys of 128 bits may meet in one number of 64 bits; another seed then separates them.
    seed = 0
    while len(np.unique(keys := folded(h1, h2, seed))) < len(keys):
        seed += 1
    hashed = PerfectHash.build(keys)
    slot = hashed.numbers(keys)
    prints, counts, keepers = np.zeros((len(keys), 2), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    prints[slot, 0], prints[slot, 1] = frame["h1"], frame["h2"]
    counts[slot], keepers[slot] = frame["n"], frame["keeper"]
    return pd.DataFrame({"shard": [key[0]], "seed": [seed], "sizes": [hashed.sizes.tolist()], "bits": [hashed.bits.tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "keepers": [keepers.tobytes()]})


def probe(min_docs: int):
    """Streams (shard, salt) groups: the arrays come first, then the line rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seed, hashed, prints, counts, keepers = None, 0, None, None, None, None
        for batch in batches:
            marks = np.flatnonzero(batch.column("bits").is_valid().to_numpy(zero_copy_only=False))
            shards = batch.column("shard").to_numpy()
            edges = [0, *marks.tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if low in marks:
                    row = batch.slice(low, 1).to_pylist()[0]
                    held, seed = row["shard"], row["seed"]
                    hashed = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64))
                    prints = np.frombuffer(row["prints"], np.int64).reshape(-1, 2)
                    counts, keepers = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["keepers"], np.int64)
                    low += 1
                if low >= high or held is None:
                    continue
                part = batch.slice(low, high - low)
                h1, h2 = part.column("h1").to_numpy(), part.column("h2").to_numpy()
                slot = hashed.numbers(folded(h1.view(np.uint64), h2.view(np.uint64), seed))
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                drop = (slot >= 0) & (shards[low:high] == held)
                at = slot[drop]
                drop[drop] = (prints[at, 0] == h1[drop]) & (prints[at, 1] == h2[drop]) & (counts[at] >= min_docs) & (keepers[at] != ids[drop])
                yield part.filter(pa.array(drop)).select(["row", "line_no"])

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, salts: int = SALTS) -> DataFrame:
    """row and ``drop`` (numbers of the lines to drop, from 0) of each document that loses lines."""
    lines = stored(keyed(docs).mapInArrow(scan_lines(min_chars), LINE_SCHEMA), "lines")
    hot = lines.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("n"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("keeper")).where(F.col("n") >= min_docs)
    hot = stored(hot, "hot-lines")
    shard = F.pmod(F.col("h1"), F.lit(max(1, -(-hot.count() // shard_keys))))
    arrays = hot.withColumn("shard", shard).groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA)
    arrays = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    routed = lines.drop("first").withColumns({"shard": shard, "salt": F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")})
    parts = arrays.unionByName(routed, allowMissingColumns=True)
    parts = parts.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("bits").isNull())
    found = parts.mapInArrow(probe(min_docs), "row binary, line_no int")
    return found.groupBy("row").agg(F.collect_set("line_no").alias("drop"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` and ``n_dropped`` beside the struct ``whole`` of their columns."""
    rows, drops = keyed(docs, keep=True), dropped_lines(docs, **options)
    split = F.split("text", "\n", -1)
    chosen = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))), lambda i: F.get(F.col("lines"), i))
    joined = rows.join(drops, "row", "left").select("doc_id", "whole", "text", "drop", split.alias("lines"))
    return joined.select(
        "doc_id",
        "whole",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(chosen, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: line counts and the digest of the kept text of every document."""
    from evalspark.llm.common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their repeated lines."""
    return replaced_text(dedup(docs), docs.columns, F.col("kept_text"))
