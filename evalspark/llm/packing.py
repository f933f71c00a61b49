"""Packing: bounded-space online packing of token sequences.

Each task keeps at most ``OPEN`` open windows. A document goes whole into the open window with the least room
that holds it; if none does, a new window opens. When ``OPEN`` windows are open and none fits, the fullest is
topped up with the head of the document and emitted full. Documents longer than a window fill whole windows
first. At the end of a task the leftovers are merged: pieces are poured into full windows, and the last one (under one
window per task) is cut into lengths that are powers of two. No window is padded.

Nothing is shuffled: memory is ``OPEN`` windows and one slice of texts. A sequence number holds the task's partition
number in its upper bits, so repeated tasks number alike.

Defined cases: null text is empty and gives one id, the end mark. Repeated rows are packed as often as
they come. A null doc_id stays null. Empty tables give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.bpe_words import splitter
from evalspark.llm.common import documents, worker_cache

LENGTH = 2048
OPEN = 32
END = 1
CACHED_WORDS = 1 << 20
SLICE = 1 << 20
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encoder(path: str):
    """texts -> their ids as little-endian 32-bit numbers. A distinct word goes through the tokenizer once per worker.

    Texts that hold one of the tokenizer's added tokens don't split into words alone: they go through it as a whole.
    """
    cache = worker_cache(f"ids {path}")
    if "word" not in cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        cache["tokenizer"], cache["word"] = tokenizer, {}
        cache["added"] = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    tokenizer, known, added, split = cache["tokenizer"], cache["word"], cache["added"], splitter()

    def encode(texts: list[str]) -> Iterator[bytes]:
        if len(known) > CACHED_WORDS:
            known.clear()
        whole = {t for t in texts if any(token in t for token in added)}
        words = [[] if t in whole else split(t) for t in texts]
        new = list(set(chain.from_iterable(words)).difference(known))
        # Words of a space and letters keep their borders when they stand one behind the other: one call codes many.
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            coded = tokenizer.encode("".join(part), add_special_tokens=False)
            ids, word = np.array(coded.ids, "<u4"), np.array(coded.word_ids)
            edges = np.searchsorted(word, np.arange(len(part) + 1)).tolist()
            if word[-1] + 1 == len(part):
                known.update(zip(part, [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]))
        rest = [w for w in new if w not in known]
        for at in range(0, len(rest), 5_000):
            part = rest[at : at + 5_000]
            for word, coded in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = np.array(coded.ids, "<u4").tobytes()

        def coded_whole(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        return (coded_whole(t) if t in whole else b"".join(map(known.__getitem__, w)) for t, w in zip(texts, words))

    return encode


class Packer:
    """Open windows of one task. ``out`` gathers finished pieces: (doc, start, length, sequence, offset)."""

    def __init__(self, length: int, room: int, first: int):
        self.length, self.room, self.next = length, room, first
        self.open: list[list] = []  # [filled, pieces]
        self.out: list[tuple] = []

    def emit(self, window: list) -> None:
        offset = 0
        for doc, start, size in window[1]:
            self.out.append((doc, start, size, self.next, offset))
            offset += size
        self.next += 1

    def add(self, doc: int, size: int) -> None:
        start = 0
        while size - start >= self.length:
            self.emit([self.length, [(doc, start, self.length)]])
            start += self.length
        rest = size - start
        if not rest:
            return
        fitting = [w for w in self.open if w[0] + rest <= self.length]
        if not fitting and len(self.open) >= self.room:
            fullest = max(self.open, key=lambda w: w[0])
            head = self.length - fullest[0]
            fullest[1].append((doc, start, head))
            self.open.remove(fullest)
            self.emit(fullest)
            start, rest = start + head, rest - head
            fitting = [w for w in self.open if w[0] + rest <= self.length]
        if fitting:
            best = max(fitting, key=lambda w: w[0])
        else:
            self.open.append(best := [0, []])
        best[0] += rest
        best[1].append((doc, start, rest))
        if best[0] == self.length:
            self.open.remove(best)
            self.emit(best)

    def finish(self) -> None:
        """Merge what is open: full windows first, then one window per power of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(p[2] for p in pieces)
        self.open, filled, held = [], 0, []
        goal = self.goal(left)
        for doc, start, size in pieces:
            while size:
                take = min(size, goal - filled)
                held.append((doc, start, take))
                filled, start, size = filled + take, start + take, size - take
                if filled == goal:
                    self.emit([filled, held])
                    left -= goal
                    goal, filled, held = self.goal(left), 0, []

    def goal(self, left: int) -> int:
        return self.length if left >= self.length else 1 << max(0, left.bit_length() - 1)


def pack_task(path: str, length: int, room: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        mark = np.array([end], "<u4").tobytes()
        packer = Packer(length, room, TaskContext.get().partitionId() << 40)
        ids: dict[int, tuple[object, bytes]] = {}
        number = 0

        def ready() -> pa.RecordBatch:
            done, packer.out = packer.out, []
            columns = [[] for _ in range(7)]
            for doc, start, size, sequence, offset in done:
                doc_id, coded = ids[doc]
                for column, value in zip(columns, (doc_id, start, size, coded[4 * start : 4 * (start + size)], len(coded) // 4, sequence, offset)):
                    column.append(value)
            # Ids stay only for documents with a piece in an open window.
            waiting = {p[0] for w in packer.open for p in w[1]}
            for doc in [d for d in ids if d not in waiting]:
                del ids[doc]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in ts.slices(batches, "text", SLICE):
            texts = batch.column("text").fill_null("").to_pylist()
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                coded += mark
                ids[number] = (doc_id, coded)
                packer.add(number, len(coded) // 4)
                number += 1
            yield ready()
        packer.finish()
        yield ready()

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, room: int = OPEN, end: int = END) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit numbers, ``start`` counts the document's ids before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack_task(path, length, room, end), PIECE_SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: pieces of all documents with the checksum of their ids."""
    pieces = pack(documents(spark, sf_dir), default_tokenizer())
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: packed pieces with their ids."""
    return pack(docs, default_tokenizer())
