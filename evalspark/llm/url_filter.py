"""URL filters: a sorted array of 64-bit digests, memory-mapped by the tasks and probed by binary search.

Rules (``host/path`` prefixes) and blocked host words are hashed with xxhash; the sorted digests are one file
with the strings behind them. Spark ships the file to each executor once, where all workers share one memory
map, so a list of many millions of rules costs no memory per task. A URL asks for each suffix
of its host with each rule path length; hits are confirmed on the stored strings, so colliding digests can't decide.

The longest fitting rule wins (of equally long ones the longer host, then the smaller string; of equal rules with two
verdicts, block). Without a rule, a URL is blocked if a word of its host (split at characters that are neither
letters nor digits) is on the word list, else allowed.

Defined cases: null URLs or URLs without ``://`` have empty host and path and are allowed. Repeated rows are judged alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import worker_cache
from evalspark.session import configure

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
BLOCKED_WORDS = ["adult", "bet", "betting", "casino", "escort", "gambling", "jackpot", "poker", "porn", "slots", "viagra", "warez", "xxx"]


class Digests:
    """Sorted digests of strings, with the strings themselves and one number each, in one memory-mapped file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, mode="r")
        n = int(whole[:8].view(np.int64)[0])
        self.digests = whole[8 : 8 + 8 * n].view(np.uint64)
        self.numbers = whole[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.bounds = whole[8 + 16 * n : 16 + 24 * n].view(np.int64)
        self.bytes = whole[16 + 24 * n :]

    @staticmethod
    def packed(entries: dict[bytes, int], digest=xxhash.xxh64_intdigest) -> bytes:
        keys = sorted(entries, key=lambda k: (digest(k), k))
        parts = [np.array([len(keys)], np.int64), np.array([digest(k) for k in keys], np.uint64), np.array([entries[k] for k in keys], np.int64)]
        return b"".join([*[p.tobytes() for p in parts], np.cumsum([0, *map(len, keys)], dtype=np.int64).tobytes(), *keys])

    def probe(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The number of each key, -1 where it is not in the list."""
        wanted = np.array([digest(k) for k in keys], np.uint64)
        at, out = np.searchsorted(self.digests, wanted), np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(at < len(self.digests)):
            spot = at[i]
            while spot < len(self.digests) and self.digests[spot] == wanted[i]:
                if self.bytes[self.bounds[spot] : self.bounds[spot + 1]].tobytes() == keys[i]:
                    out[i] = self.numbers[spot]
                    break
                spot += 1
        return out


def judge_batch(hosts: list[str], paths: list[str], rules: Digests, words: Digests, lengths: list[int], verdicts: list[str]) -> tuple[list, list]:
    """Rule string (or None) and verdict of each URL; ``lengths``: path lengths that occur among the rules, in characters."""
    keys, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        labels = host.split(".") if host else []
        for n in range(len(labels)):
            suffix = ".".join(labels[n:])
            for size in lengths:
                if size <= len(path):
                    keys.append((suffix + path[:size]).encode())
                    owner.append((i, len(suffix)))
    # Different (host, path) cuts may spell one string only if the host holds a slash, which it can't.
    best: dict[int, tuple] = {}
    for hit in np.flatnonzero((numbers := rules.probe(keys)) >= 0):
        i, host_size = owner[hit]
        rank = (len(keys[hit].decode()), host_size)
        if i not in best or rank > best[i][0]:
            best[i] = (rank, keys[hit].decode(), verdicts[numbers[hit]])
    tokens, token_owner = [], []
    for i, host in enumerate(hosts):
        if i not in best:
            for token in re.split(r"[\W_]+", host):
                if token:
                    tokens.append(token.encode())
                    token_owner.append(i)
    bad = {token_owner[j] for j in np.flatnonzero(words.probe(tokens) >= 0)}
    rule = [best[i][1] if i in best else None for i in range(len(hosts))]
    return rule, [best[i][2] if i in best else "block" if i in bad else "allow" for i in range(len(hosts))]


def shipped(spark: SparkSession, content: bytes) -> str:
    """Name of a file with this content that Spark sends to every executor, later ones included.

    The original stays in the folder that Spark keeps for such files on the driver, until the session ends.
    """
    name = f"digests-{xxhash.xxh128_hexdigest(content)}"
    root = SparkFiles.getRootDirectory()
    if not os.path.exists(os.path.join(root, name)):
        os.makedirs(os.path.join(root, "originals"), exist_ok=True)
        with open(path := os.path.join(root, "originals", name), "wb") as file:
            file.write(content)
        spark.sparkContext.addFile(path)
    return name


def filtered(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked_words: list[str] = BLOCKED_WORDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    verdicts = ["allow", "block"]
    entries: dict[bytes, int] = {}
    for text, verdict in rules:
        host, _, path = text.partition("/")
        key = f"{host.translate(LOWER)}/{path}".encode()
        entries[key] = max(entries.get(key, 0), verdicts.index(verdict))
    rule_file = shipped(spark, Digests.packed(entries))
    word_file = shipped(spark, Digests.packed({w.encode(): 1 for w in blocked_words}))
    lengths = sorted({len(k.decode()) - k.decode().index("/") for k in entries})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("digests")
        for file in (rule_file, word_file):
            if file not in cache:
                cache[file] = Digests(SparkFiles.get(file))
        for batch in batches:
            rule, verdict = judge_batch(batch.column("host").to_pylist(), batch.column("path").to_pylist(), cache[rule_file], cache[word_file], lengths, verdicts)
            yield batch.append_column("rule", pa.array(rule, pa.string())).append_column("verdict", pa.array(verdict, pa.string()))

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), rest.alias("rest")).withColumn("host", host)
    rows = rows.withColumn("path", F.regexp_extract(F.substring("rest", F.length("host") + 1, F.length("rest")), r"^[^?#]*", 0))
    rows = rows.select("page_id", F.translate("host", UPPER, UPPER.lower()).alias("host"), "path")
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: verdicts on every page's URL."""
    return filtered(spark, configure(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rule_host, rule_path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
    FROM q LEFT JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(list_intersect(regexp_split_to_array(host, '[^\p{L}\p{N}]+'),
    ['adult', 'bet', 'betting', 'casino', 'escort', 'gambling', 'jackpot', 'poker', 'porn', 'slots', 'viagra', 'warez', 'xxx'])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE n = 1
"""
