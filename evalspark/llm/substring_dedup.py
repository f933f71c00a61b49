"""Substring dedup: prefix-partitioned suffix trees over the corpus's suffixes, cut at the window length.

A suffix matters only down to depth ``window`` (35 words): nodes of that depth with two or more suffixes are the
maximal repeats' windows. Suffixes are dealt to subtrees by a prefix that lies inside the window:

1. Every window is filed under its smallest 8-word gram (hash order), so equal windows always get the same
   prefix, and neighbouring windows share one. A run of such windows is one row of the first shuffle (about one
   row for 14 words), not one per suffix.
2. Prefixes with one run can't branch: their suffixes are leaves and go. Runs equal in every word repeat as a
   whole; no text is needed for them.
3. Only for the prefixes left, one copy of each distinct run is cut from its text and shipped to the prefix's
   subtree. The subtree is built level by level, depth 1, 2, 4 ... ``window``: each suffix's node at twice the
   depth is the pair of its node here and the node further on; suffixes alone in their node are leaves and leave.
4. Prefixes with more than ``subtree_runs`` distinct runs don't fit one task. They are prolonged to the full depth:
   each window is routed by a 128-bit hash of all its words and the nodes are counted with partial aggregation.
5. Bitmaps of repeated windows, one list per document, meet the texts; covered words go.

Every occurrence goes, the first included. Defined cases: null text has no words. Texts shorter than the window lose
nothing. Repeated rows repeat each other's windows and so lose them. Null doc_ids are ordinary values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.common import documents, keyed, replaced_text, stored

WINDOW, PREFIX = 35, 8
RUN = 32  # windows per run at most, so that a run's answer is one 32-bit map
SUBTREE_RUNS = 20_000
CHUNK_WORDS = 1 << 20
RUN_SCHEMA = "prefix long, same long, row binary, start int, windows int"


def runs(batch: pa.RecordBatch, window: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one prefix: source row, first word in the row, count, hash of all words."""
    data, offsets = ts.buffers(batch.column("text"))
    starts, ends, bounds = ts.words(data, offsets)
    hashes = ts.span_hashes(data, starts, ends)
    low, high = bounds[:-1], np.maximum(bounds[1:] - window + 1, bounds[:-1])
    some = high > low
    size = (high - low)[some]
    row = np.repeat(np.flatnonzero(some), size)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(low[some], size)
    depth = min(PREFIX, window)
    small = ts.grams(hashes, depth)
    # Sliding minimum over the window's grams, by doubling.
    reach, need = 1, window - depth + 1
    least = small
    while len(at) and reach * 2 <= need:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if len(at) and reach < need:
        least = np.minimum(least[: len(least) - (need - reach)], least[need - reach :])
    prefix = least[at] if len(at) else np.zeros(0, np.uint64)
    fresh = np.ones(len(at), bool)
    # A window that begins with its own smallest gram ends the run: the next one is filed under another place. So two
    # windows of one run are never equal, also not in texts that repeat themselves.
    fresh[1:] = (prefix[1:] != prefix[:-1]) | (row[1:] != row[:-1]) | (small[at[:-1]] == prefix[:-1])
    head = np.flatnonzero(fresh)
    inside = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(inside % RUN == 0)
    count = np.diff(np.append(head, len(at)))
    begin = at[head]
    # Hash of the words of a run, from a prefix sum over word hashes.
    powers = np.cumprod(np.full(len(hashes), ts.BASE))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers, out=total[1:])
    back = np.cumprod(np.full(len(hashes), ts.BASE_INVERSE))
    stop = begin + count + window - 1
    same = ts.mix((total[stop] - total[begin]) * back[begin] + count.astype(np.uint64)) if len(begin) else prefix[:0]
    return {"prefix": prefix[head].view(np.int64), "same": same.view(np.int64), "source": row[head], "start": (begin - low[row[head]]).astype(np.int32), "windows": count.astype(np.int32)}


def scan_runs(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text"):
            t = runs(batch, window)
            source = pa.array(t["source"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t["prefix"]), pa.array(t["same"]), batch.column("row").take(source), pa.array(t["start"]), pa.array(t["windows"])],
                names=["prefix", "same", "row", "start", "windows"],
            )

    return scan


def cut_runs(window: int):
    """The word hashes of the wanted runs of each document, 8 bytes a word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text"):
            data, offsets = ts.buffers(batch.column("text"))
            starts, ends, bounds = ts.words(data, offsets)
            hashes = ts.span_hashes(data, starts, ends)
            wanted = batch.column("wanted")
            source = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            start, count = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            begin = bounds[source] + start
            pieces = [hashes[b:e].tobytes() for b, e in zip(begin.tolist(), (begin + count + window - 1).tolist())]
            take = pa.array(source)
            yield pa.RecordBatch.from_arrays(
                [flat.field("prefix"), batch.column("row").take(take), flat.field("start"), flat.field("windows"), flat.field("alone"), flat.field("hot"), pa.array(pieces, pa.binary())],
                names=["prefix", "row", "start", "windows", "alone", "hot", "words"],
            )

    return cut


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares its node of this depth with another one of its group.

    ``words``: all runs one behind the other; ``suffixes``: where windows start. Node numbers are dense ranks; level
    2d is ranked from pairs of level d. Suffixes that stand alone are leaves and are not followed further down.
    """

    def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        order = np.lexsort((b, a))
        fresh = np.zeros(len(order), np.int64)
        fresh[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(fresh)
        return out

    levels = {1: np.unique(words, return_inverse=True)[1].astype(np.int64)}
    reach = 1
    while reach * 2 <= depth:
        levels[reach * 2] = ranked(levels[reach][: len(levels[reach]) - reach], levels[reach][reach:])
        reach *= 2
    alive, node, done = np.arange(len(suffixes)), group.astype(np.int64), 0
    while done < depth and len(alive):
        step = next(r for r in sorted(levels, reverse=True) if r <= depth - done)
        node = ranked(node, levels[step][suffixes[alive] + done])
        done += step
        many = np.bincount(node)[node] > 1
        alive, node = alive[many], node[many]
    shared = np.zeros(len(suffixes), bool)
    shared[alive] = True
    return shared


def subtrees(window: int, chunk_words: int):
    """Streams runs sorted by prefix; whole prefixes are gathered up to ``chunk_words`` words and resolved together."""

    def resolve(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = ts.buffers(batch.column("words"))
        words = np.ascontiguousarray(data).view(np.uint64)
        count = batch.column("windows").to_numpy()
        row = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        group = np.unique(batch.column("prefix").to_numpy(), return_inverse=True)[1]
        shared = deep_nodes(words, offsets[row] // 8 + inside, group[row], window)
        bitmap = np.zeros(len(count), np.int64)
        np.bitwise_or.at(bitmap, row[shared], np.int64(1) << inside[shared])
        hit = (bitmap != 0) & batch.column("alone").to_numpy(zero_copy_only=False)
        return batch.append_column("bitmap", pa.array(bitmap)).filter(pa.array(hit)).select(["row", "start", "windows", "bitmap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.column("words").nbytes for b in held) < 8 * chunk_words:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            prefix = whole.column("prefix").to_numpy()
            last = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if (prefix != prefix[-1]).any() else 0
            if last:
                yield resolve(whole.slice(0, last))
            held = [whole.slice(last)]
        if held:
            yield resolve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def full_depth(window: int):
    """One row per window of a run: a 128-bit hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "words"):
            data, offsets = ts.buffers(batch.column("words"))
            words = np.ascontiguousarray(data).view(np.uint64)
            count = batch.column("windows").to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[row] // 8 + inside
            take = pa.array(row)
            columns = [pa.array(ts.grams(words, window, seed)[at].view(np.int64)) for seed in (1, 2)]
            columns += [batch.column(c).take(take) for c in ("row", "start", "windows", "alone")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(inside.astype(np.int32))], names=["w1", "w2", "row", "start", "windows", "alone", "inside"])

    return run


def repeated(rows: DataFrame, window: int = WINDOW, subtree_runs: int = SUBTREE_RUNS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """row and ``found``: (start, bitmap) of each run with repeated windows; ``rows``: row, text.

    Runs are counted by aggregates with map-side sums, never gathered: a passage that a third of all documents hold is one row
    of ``kinds`` for each task, and AQE may split the join back.
    """
    prefixes = stored(rows.select("row", "text").mapInArrow(scan_runs(window), RUN_SCHEMA), "runs")
    twice = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.min("same").alias("low"), F.max("same").alias("high")).where("n > 1")
    branching = prefixes.join(twice.select("prefix", (F.col("low") != F.col("high")).alias("branches")), "prefix")
    branching = stored(branching, "branching")
    kinds = branching.groupBy("prefix", "same").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start")).alias("one"))
    wide = kinds.groupBy("prefix").agg(F.count("*").alias("kinds")).where(F.col("kinds") > subtree_runs).select("prefix", F.lit(True).alias("wide"))
    again = kinds.where("copies > 1").select("prefix", "same", "one")
    sized = branching.join(again, ["prefix", "same"], "left")
    every = F.expr("shiftleft(1L, windows) - 1")
    whole = sized.where("one IS NOT NULL").select("row", "start", every.alias("bitmap"))
    # One copy of each distinct run of a prefix that branches goes to the prefix's subtree.
    own = F.struct("row", "start") == F.col("one")
    item = F.struct("prefix", "start", "windows", F.col("one").isNull().alias("alone"), F.coalesce("wide", F.lit(False)).alias("hot"))
    first = sized.where("branches").where(F.col("one").isNull() | own).join(wide, "prefix", "left")
    wanted = first.groupBy("row").agg(F.collect_list(item).alias("wanted"))
    # Rows that repeat id and text are cut twice; that adds no window, and their own runs are in ``whole``.
    texts = rows.select("row", "text").join(wanted, "row")
    pieces = stored(texts.mapInArrow(cut_runs(window), "prefix long, row binary, start int, windows int, alone boolean, hot boolean, words binary"), "cut-runs")
    cold = pieces.where("NOT hot").repartition("prefix").sortWithinPartitions("prefix")
    cold = cold.mapInArrow(subtrees(window, chunk_words), "row binary, start int, windows int, bitmap long")
    deep = pieces.where("hot").mapInArrow(full_depth(window), "w1 long, w2 long, row binary, start int, windows int, alone boolean, inside int")
    nodes = deep.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = deep.where("alone").join(nodes, ["w1", "w2"]).groupBy("row", "start").agg(F.expr("bit_or(shiftleft(1L, inside))").alias("bitmap"))
    found = whole.unionByName(cold.drop("windows")).unionByName(hot)
    return found.groupBy("row").agg(F.collect_set(F.struct("start", "bitmap")).alias("found"))


def cover(window: int):
    """Kept text, word count and removed words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text"):
            data, offsets = ts.buffers(batch.column("text"))
            starts, ends, bounds = ts.words(data, offsets)
            found = batch.column("found")
            size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            flat = found.flatten()
            begin = bounds[np.repeat(np.arange(batch.num_rows), size)] + flat.field("start").to_numpy()
            bitmap = flat.field("bitmap").to_numpy()
            edge = np.zeros(len(starts) + window + RUN + 1, np.int64)
            for bit in range(RUN):
                at = begin[(bitmap >> bit) & 1 == 1] + bit
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            kept = np.cumsum(edge)[: len(starts)] == 0
            left = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(kept, out=left[1:])
            n = np.diff(bounds)
            text = ts.strings(*ts.kept_words(data, offsets, starts, ends, bounds, kept))
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "found")]
            names = [c for c in batch.schema.names if c not in ("text", "found")]
            removed = n - (left[bounds[1:]] - left[bounds[:-1]])
            yield pa.RecordBatch.from_arrays([*rest, text, pa.array(n), pa.array(removed)], names=[*names, "kept_text", "n_words", "n_removed"])

    return run


def dedup(docs: DataFrame, keep: bool = True, **options) -> DataFrame:
    """kept_text, n_words and n_removed of every row, beside doc_id and, with ``keep``, ``whole``."""
    rows = keyed(docs)
    found = repeated(rows, **options)
    left = keyed(docs, keep=keep)
    joined = left.join(found, "row", "left").select("doc_id", *(["whole"] if keep else []), "text", "found")
    schema = joined.drop("text", "found").schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(cover(options.get("window", WINDOW)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: word counts and the digest of the kept text of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup(docs, keep=False).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated passages."""
    return replaced_text(dedup(docs), docs.columns, F.col("kept_text"))
