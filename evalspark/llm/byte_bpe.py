"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are split into pieces, and each slice of texts passes its *distinct* pieces as byte arrays to the JVM. There
``aggregate`` folds ranked merges over each array: the lowest rank among neighbouring pairs wins, its first
place is merged, until no pair has a rank. Ranks come from one literal table that constant folding builds once:
the merged token of a pair of tokens, in buckets by a hash of the pair, so that a look-up reads a handful of
numbers whatever the vocabulary's size. The ids then go back to the slice's documents. One stage, no shuffle, memory of one
slice.

The fold takes pieces that occur ``FREQUENT`` times in a slice, which are most of all occurrences. Rarer pieces, each of which would
cost about ten times as much by an interpreted fold, and those above ``LONG`` bytes go through the same ranked
merges in the task that gathers the ids, once per worker. Both give the same ids for any piece.
Decoding concatenates the tokens' bytes, looked up in a literal array.

Defined cases: null text has no ids and decodes to nothing. Null ids and null lists decode to nothing; an id outside the
vocabulary raises. Repeated rows are coded alike, empty tables give empty tables.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.bpe_words import splitter
from evalspark.llm.common import documents, worker_cache

LONG = 96
FREQUENT = 8
CACHED_BYTES = 64 << 20  # of ids and pieces a worker remembers
SLICE = 4 << 20
ENTRY = 66  # bytes of an entry and of an object's head
BUCKETS = 1 << 16
KEY = 1 << 40  # keys lie above, tokens below


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> list[list[int]]:
    """Buckets of (key, token) for every pair of tokens whose bytes together are a token."""
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                key = KEY + (left << 20) + right
                buckets[(left * 40503 + right) % BUCKETS] += [key, rank]
    return buckets


def literal_array(values: list, kind: str) -> Column:
    """A literal array, written as one string so that the plan holds one node; folded before execution."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def token_of(left: Column, right: Column, table: Column) -> Column:
    """The token that a pair merges to, null if there is none."""
    bucket = F.get(table, F.pmod(left * 40503 + right, F.lit(BUCKETS)).cast("int"))
    return bound(bucket, lambda b: bound(F.array_position(b, left * (1 << 20) + right + KEY), lambda at: F.when(at > 0, F.get(b, at.cast("int")))))


def merged(piece: Column, table: Column, single: Column) -> Column:
    """Tokens of one byte array: each fold step merges the first place of the lowest rank."""

    def step(tokens: Column, _: Column) -> Column:
        ranks = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda right, i: token_of(F.get(tokens, i), right, table))
        joined = lambda low, at: F.concat(F.slice(tokens, F.lit(1), at - 1), F.array(low), F.slice(tokens, at + 2, F.size(tokens)))
        chosen = lambda r, low: F.when(low.isNull(), tokens).otherwise(bound(F.array_position(r, low).cast("int"), lambda at: joined(low, at)))
        return bound(ranks, lambda r: bound(F.array_min(r), lambda low: chosen(r, low)))

    start = F.transform(piece, lambda byte: F.get(single, byte))
    return F.aggregate(F.slice(piece, 2, F.greatest(F.size(piece) - 1, F.lit(0))), start, step)


def merge_piece(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one piece of bytes."""
    if len(word) > LONG:
        return merge_long(word, ranks)
    edges = list(range(len(word) + 1))
    pairs = [ranks.get(word[i : i + 2], KEY) for i in range(len(word) - 1)]
    while pairs:
        low = min(pairs)
        if low == KEY:
            break
        at = pairs.index(low)
        del edges[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(word[edges[at] : edges[at + 2]], KEY)
        if at:
            pairs[at - 1] = ranks.get(word[edges[at - 1] : edges[at + 1]], KEY)
    return [ranks[word[a:b]] for a, b in zip(edges, edges[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """For long pieces: a heap of pairs over a linked list."""
    ends = list(range(1, len(word) + 1))
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    alive = [True] * len(word)

    def candidate(i: int):
        j = after[i]
        rank = ranks.get(word[i : ends[j]]) if j < len(word) else None
        return None if rank is None else (rank, i, ends[j])

    heap = [c for c in map(candidate, range(len(word))) if c]
    heapq.heapify(heap)
    while heap:
        rank, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(word) or ends[j] != end or ranks.get(word[i : ends[j]]) != rank:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for c in (candidate(i), candidate(before[i]) if before[i] >= 0 else None):
            if c:
                heapq.heappush(heap, c)
    return [ranks[word[i : ends[i]]] for i in range(len(word)) if alive[i]]


def gather_words(frequent: int):
    """One row per slice: document ids, pieces per document, piece numbers, the frequent pieces' bytes, the rare pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in ts.slices(batches, "text", SLICE):
            number: dict[str, int] = {}
            index, count = [], []
            for text in batch.column("text").fill_null("").to_pylist():
                words = split(text)
                index.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                count.append(len(words))
            index = np.concatenate(index)
            often = np.bincount(index, minlength=len(number)) >= frequent
            coded = [w.encode() for w in number]
            folded = [o and len(w) <= LONG for o, w in zip(often.tolist(), coded)]
            row = {
                "ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "counts": pa.array([count], pa.list_(pa.int32())),
                "index": pa.array([index], pa.list_(pa.int32())),
                "words": pa.array([[list(w) if f else None for w, f in zip(coded, folded)]], pa.list_(pa.list_(pa.int32()))),
                "rare": pa.array([[w for w, f in zip(coded, folded) if not f]], pa.list_(pa.binary())),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    return run


def spread(path: str):
    """Back to one row per document: its pieces' ids in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                coded, counts, index = (row.column(c).flatten() for c in ("coded", "counts", "index"))
                known, ranks, held = (worker_cache(f"{kind} {path}") for kind in ("pieces", "ranks", "held"))
                held.setdefault("bytes", 0)
                if not ranks:
                    ranks.update(read_ranks(path))
                rare = []
                for piece in row.column("rare").flatten().to_pylist():
                    ids = known.get(piece)
                    if ids is None:
                        ids = array("i", merge_piece(piece, ranks)).tobytes()
                        if held["bytes"] > CACHED_BYTES:
                            known.clear()
                            held["bytes"] = 0
                        known[piece] = ids
                        held["bytes"] += 2 * ENTRY + len(piece) + len(ids)
                    rare.append(ids)
                # All pieces' ids one behind the other: the folded ones, then the rare ones.
                size = pc.fill_null(pc.list_value_length(coded), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.cumsum(size) - size
                alone = np.flatnonzero(~coded.is_valid().to_numpy(zero_copy_only=False))
                length = np.fromiter(map(len, rare), np.int64, len(rare)) // 4
                start[alone], size[alone] = size.sum() + np.cumsum(length) - length, length
                ids = np.concatenate([coded.flatten().to_numpy().astype(np.int32), np.frombuffer(b"".join(rare), np.int32)])
                index = index.to_numpy()
                total = np.concatenate([[0], np.cumsum(size[index])])
                flat = ids[np.arange(total[-1]) + np.repeat(start[index] - total[:-1], size[index])]
                bounds = np.concatenate([[0], np.cumsum(counts.to_numpy())])
                lists = pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), lists], names=["doc_id", "ids"])
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id and ids (array of int) of every row, by the ranks in ``path``."""
    ranks = read_ranks(path)
    table, single = literal_array(pair_table(ranks), "array<array<long>>"), literal_array([ranks[bytes([b])] for b in range(256)], "array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(gather_words(frequent), "ids array<long>, counts array<int>, index array<int>, words array<array<int>>, rare array<binary>")
    coded = words.select("ids", "counts", "index", "rare", F.transform("words", lambda w: merged(w, table, single)).alias("coded"))
    return coded.mapInArrow(spread(path), "doc_id long, ids array<int>")


def decoded(ids: Column, path: str) -> Column:
    """The bytes of a column of ids."""
    ranks = read_ranks(path)
    token = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        token[rank] = piece.hex()
    pieces = literal_array(token, "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: number of ids, digest of the ids, digest of the decoded bytes."""
    path = default_ranks()
    return encode(documents(spark, sf_dir), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.coalesce(decoded(F.col("ids"), path), F.lit(b"")), 256).alias("decoded_sha256"),
    )
