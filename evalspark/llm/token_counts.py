"""Token counts: batch encoding in Arrow functions that return lengths only.

1. Each Arrow batch is cut into slices of a bounded number of bytes.
2. Texts above ``PIECE`` bytes are cut where no token can reach across (see :func:`cuts`), so that their counts add up.
3. The slice's pieces are dealt, in order, to batches of nearly equal bytes; each goes through the tokenizer in one
   call, and only the lengths leave it.

One pass over each text in a task, nothing is shuffled, memory of one batch's encodings. Cuts are made for byte-level
BPE alone. Other tokenizers (other JSON files, ``.model`` files of sentencepiece) see whole texts.

Defined cases: null or empty text has no bytes and no tokens. Texts without a safe place stay whole. Repeated rows are
counted as often as they come. A null doc_id stays null. Empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.common import documents, worker_cache

LIMIT = 1024
SLICE, PIECE, BATCH = 1 << 20, 1 << 16, 1 << 18
# ASCII signs that no pattern class takes for white space; a space after one of them always starts a new match.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True


def cuts(data: np.ndarray, piece: int) -> list[int]:
    """Where to cut one text's bytes into parts of about ``piece`` bytes or more without changing its tokens.

    The pattern that splits texts for byte-level BPE matches either white space alone or signs behind at most one space, and never
    looks back. So a match always ends where white space follows another sign, and what follows is split as if it stood
    alone. Tokens are made inside a match. Added tokens must not hold white space, see :func:`divisible`.
    """
    out, at = [0], piece
    while at < len(data):
        # The next safe place may be far away in texts without white space, so the reach doubles.
        reach, spot = 4096, -1
        while spot < 0 and at < len(data):
            part = data[at - 1 : at + reach]
            safe = np.flatnonzero(SOLID[part[:-1]] & ts.SPACE[part[1:]])
            if len(safe):
                spot = at + int(safe[0])
            at, reach = at + reach, reach * 2
        if spot < 0:
            break
        out.append(spot)
        at = spot + piece
    return [*out, len(data)]


def divisible(spec: dict) -> bool:
    """Whether texts of a tokenizer file may be cut at white space: plain byte-level BPE."""
    first = spec.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(plain and added and not spec.get("normalizer") and not spec.get("truncation") and spec.get("model", {}).get("type") == "BPE")


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Texts -> numbers of tokens, by the library the file is made for; and whether texts may be cut."""
    cache = worker_cache(f"counter {path}")
    if "count" not in cache:
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            cache["cut"] = False
            cache["count"] = lambda texts: list(map(len, processor.encode(texts, num_threads=1)))
        else:
            # A task has one core; the library's own threads would take those of other tasks.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            cache["cut"] = divisible(json.loads(tokenizer.to_str()))
            tokenizer.no_padding()
            tokenizer.no_truncation()
            cache["count"] = lambda texts: list(map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
    return cache["count"], cache["cut"]


def batches_of(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Neighbouring pieces in batches of nearly equal bytes, of at most about ``limit``."""
    total = np.cumsum(sizes)
    if not len(total):
        return []
    share = max(1.0, total[-1] / max(1, -(-int(total[-1]) // limit)))
    # A piece belongs to the batch its middle lies in.
    place = ((total - sizes / 2) / share).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(sizes)]
    return list(zip(edges[:-1], edges[1:]))


def count_tokens(path: str, piece: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(path)
        for batch in ts.slices(batches, "text", SLICE):
            data, offsets = ts.buffers(batch.column("text"))
            owner, starts, ends = [], [], []
            for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                edges = cuts(data[low:high], piece) if cut and high - low > piece else [0, high - low]
                owner += [row] * (len(edges) - 1)
                starts += [low + e for e in edges[:-1]]
                ends += [low + e for e in edges[1:]]
            sizes, owner = np.array(ends) - np.array(starts), np.array(owner)
            raw, total = data.tobytes(), np.zeros(batch.num_rows, np.int64)
            for low, high in batches_of(sizes, limit):
                lengths = count([raw[a:b].decode() for a, b in zip(starts[low:high], ends[low:high])])
                np.add.at(total, owner[low:high], lengths)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, as the library for the file ``path`` counts them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count_tokens(path, piece, batch), "doc_id long, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: bytes and tokens of every document, and whether it is longer than ``LIMIT`` tokens."""
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
