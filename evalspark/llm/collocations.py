"""Phrase collocation mining with weighted acyclic automata.

1. Each task turns its texts, slice by slice, into count transducers: the slice's distinct words are numbered in byte order, its 1-,
   2- and 3-word phrases are sorted and counted, and the automaton is built from the sorted phrases. A state is a
   two-word prefix with its weight; its arcs carry third words and their weights. States with equal arcs share one tail.
2. A transducer is cut by prefix range: the hash of the prefix, in as many ranges as the corpus has ``RANGE_BYTES``. Only
   such pieces are shuffled, so a phrase costs one row's share per slice, however often it occurs.
3. One task at a time unites the pieces of a range, sums weights, and never holds more than the union and ``UNION_BYTES`` of
   pieces. Phrases below ``MIN_COUNT`` end here: no candidate and no part of one is that rare.
4. Composition for part lookups: every cut of a candidate writes its two parts, which are joined with the weights of the united
   transducers.
5. Absorbed candidates go, the others are ranked per language in two salted steps.

Counts are exact, equality of words and prefixes is that of their bytes; hashes only deal out ranges and find
shared tails (128 bits, within one slice). Scores are integers by decimals of 38 digits, exact for counts below 10^16.

Defined cases: null text is empty and counts nothing; a language without words has no rows. Null lang is ``und``. Repeated
rows count as often as they come. A text longer than a slice is cut between pieces, which no phrase crosses. Empty tables give no
rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.common import documents, stored
from evalspark.operators.ranking import top_k_per_key

MIN_COUNT, TOP, ABSORBED_PERCENT = 10, 2000, 50
NO_LANG = "und"
SLICE, RANGE_BYTES, UNION_BYTES = 2 << 20, 2 << 20, 8 << 20
TASK_BYTES = 256 << 20  # of text behind the ranges of one task, where the session's number of partitions gives more
BREAK, GAP = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP[[9, 32]] = True
NEWLINE = 10  # a break, so that no word holds it: it ends the words of a piece on the way
BLOBS = ("heads", "head_n", "pairs", "pair_n", "tails", "fans", "arcs", "arc_n")
PIECE_SCHEMA = "span long, lang string, " + ", ".join(f"{b} binary" for b in BLOBS)
FREQUENT_SCHEMA = "lang string, words int, phrase string, f long"


def lines(data: np.ndarray) -> pa.Array:
    """The newline-ended words of some bytes."""
    ends = np.flatnonzero(data == NEWLINE)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != NEWLINE])])


def summed(values: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, codes, values)
    return out


class Transducer:
    """Weights of one-, two- and three-word phrases: ``heads``, ``pairs`` (states), and arcs behind shared ``tails``.

    State i has the arcs of tail ``tails[i]``, which are ``fans[tails[i]]`` neighbours in ``arcs``.
    """

    def __init__(self, heads, head_n, pairs, pair_n, tails, fans, arcs, arc_n):
        self.heads, self.head_n, self.pairs, self.pair_n = heads, head_n, pairs, pair_n
        self.tails, self.fans, self.arcs, self.arc_n = tails, fans, arcs, arc_n

    @classmethod
    def read(cls, rows: pa.RecordBatch) -> Transducer:
        """Neighbouring pieces of one range and language, read at once; their phrases may repeat until they are united."""
        parts = {}
        for name in BLOBS:
            data, offsets = ts.buffers(rows.column(name))
            count = np.diff(offsets) // 4
            if name in ("heads", "pairs", "arcs"):
                parts[name] = lines(data)
            else:
                parts[name] = np.frombuffer(data.tobytes(), "<i4").astype(np.int64)
            if name == "tails":
                states = count
            elif name == "fans":
                parts["tails"] += np.repeat(np.cumsum(count) - count, states)
        return cls(*[parts[name] for name in BLOBS])

    def unshared(self) -> tuple[np.ndarray, np.ndarray]:
        """State and arc number of every arc of every state."""
        fan = self.fans[self.tails]
        first = (np.cumsum(self.fans) - self.fans)[self.tails]
        return np.repeat(np.arange(len(fan)), fan), np.arange(int(fan.sum())) + np.repeat(first - (np.cumsum(fan) - fan), fan)

    @classmethod
    def united(cls, parts: list[Transducer]) -> Transducer:
        """The union; weights of equal phrases are summed."""
        coded = [pa.concat_arrays([getattr(p, name) for p in parts]).dictionary_encode() for name in ("heads", "pairs", "arcs")]
        heads, pairs, arcs = (c.dictionary for c in coded)
        head, pair, arc = (c.indices.to_numpy().astype(np.int64) for c in coded)
        keys, weights, pairs_before, arcs_before = [], [], 0, 0
        for p in parts:
            state, number = p.unshared()
            keys.append(pair[pairs_before + state] * max(1, len(arcs)) + arc[arcs_before + number])
            weights.append(p.arc_n[number])
            pairs_before, arcs_before = pairs_before + len(p.pairs), arcs_before + len(p.arcs)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        state, word = key // max(1, len(arcs)), key % max(1, len(arcs))
        return cls(
            heads,
            summed(np.concatenate([p.head_n for p in parts]), head, len(heads)),
            pairs,
            summed(np.concatenate([p.pair_n for p in parts]), pair, len(pairs)),
            np.arange(len(pairs)),
            np.bincount(state, minlength=len(pairs)),
            arcs.take(pa.array(word)),
            summed(np.concatenate(weights), place, len(key)),
        )

    def frequent(self, least: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """(words, phrases, weights) of all phrases with at least this weight."""
        for words, phrases, n in ((1, self.heads, self.head_n), (2, self.pairs, self.pair_n)):
            often = np.flatnonzero(n >= least)
            yield words, phrases.take(pa.array(often)), n[often]
        state, number = self.unshared()
        often = np.flatnonzero(self.arc_n[number] >= least)
        phrases = pc.binary_join_element_wise(self.pairs.take(pa.array(state[often])), self.arcs.take(pa.array(number[often])), pa.scalar(b" ", pa.large_binary()))
        yield 3, phrases, self.arc_n[number[often]]


def text_parts(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Bytes, row offsets and lang of a slice; a single long row in parts that end at a break."""
    data, offsets = ts.buffers(batch.column("text"))
    lang = batch.column("lang")
    if batch.num_rows > 1 or len(data) <= limit:
        yield data, offsets, lang
        return
    breaks = np.flatnonzero(BREAK[data])
    at = 0
    while at < len(data):
        spot = int(np.searchsorted(breaks, at + limit))
        end = int(breaks[spot]) + 1 if spot < len(breaks) else len(data)
        yield data[at:end], np.array([0, end - at]), lang
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the row of each, and whether the next word belongs to the same piece."""
    broken = BREAK[data]
    solid = ~(broken | GAP[data])
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(broken), starts)
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(ts.LOWER[data[solid]])])
    return words, row, follows


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column of the bytes between the edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def shard(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, spans: int) -> pa.RecordBatch | None:
    """The transducer of one slice, one row for each (lang, prefix range); None without words."""
    words, row, follows = words_of(data, offsets)
    if not len(words):
        return None
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    known = coded.dictionary.take(pa.array(order))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    word, n = number[coded.indices.to_numpy()], len(order)
    coded = lang.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)[row]
    # Sorted phrases of 1, 2 and 3 words: each key holds the number of its prefix among the sorted ones.
    head, head_of, head_n = np.unique(code * n + word, return_inverse=True, return_counts=True)
    two = np.flatnonzero(follows)
    pair, pair_of, pair_n = np.unique(head_of[two] * n + word[two + 1], return_inverse=True, return_counts=True)
    three = np.flatnonzero(follows[two] & follows[np.minimum(two + 1, len(word) - 1)])
    arc, arc_n = np.unique(pair_of[three] * n + word[two[three] + 2], return_counts=True)
    first, second, third = head[pair // n], pair % n, arc % n
    fan = np.bincount(arc // n, minlength=len(pair))
    # Prefix ranges: by the hash of language and words.
    raw, begin = ts.buffers(known)
    hashes = ts.span_hashes(raw, begin[:-1], begin[1:])
    raw, begin = ts.buffers(coded.dictionary)
    seeds = ts.span_hashes(raw, begin[:-1], begin[1:], table=1)

    def span(value: np.ndarray) -> np.ndarray:
        return ((ts.mix(value) >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int64)

    head_lang, pair_lang = head // n, first // n
    head_group = head_lang * spans + span(hashes[head % n] ^ seeds[head_lang])
    pair_group = pair_lang * spans + span(hashes[first % n] * ts.BASE + hashes[second] ^ seeds[pair_lang])
    # Equal sets of arcs share one tail within their piece.
    item = third.astype(np.uint64) * ts.BASE + arc_n.astype(np.uint64)
    stop = np.cumsum(fan)
    digest = []
    for seed in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(item ^ np.uint64(seed)))])
        digest.append(total[stop] - total[stop - fan])
    by_tail = np.lexsort((digest[1], digest[0], pair_group))
    fresh = np.ones(len(by_tail), bool)
    fresh[1:] = False
    for key in (pair_group, *digest):
        fresh[1:] |= key[by_tail[1:]] != key[by_tail[:-1]]
    tail = np.empty(len(by_tail), np.int64)
    tail[by_tail] = np.cumsum(fresh) - 1
    owner = by_tail[fresh]  # one state for each tail, in the order of the pieces
    own_fan = fan[owner]
    own_arc = np.arange(int(own_fan.sum())) + np.repeat((stop - fan)[owner] - (np.cumsum(own_fan) - own_fan), own_fan)
    by_head, by_pair = np.argsort(head_group, kind="stable"), np.argsort(pair_group, kind="stable")
    ended = pc.binary_join_element_wise(known, pa.scalar(b"", pa.large_binary()), pa.scalar(bytes([NEWLINE]), pa.large_binary()))
    joined = pc.binary_join_element_wise(known.take(pa.array(first[by_pair] % n)), ended.take(pa.array(second[by_pair])), pa.scalar(b" ", pa.large_binary()))
    strings = (ended.take(pa.array(head[by_head] % n)), joined, ended.take(pa.array(third[own_arc])))
    (heads, head_at), (pairs, pair_at), (arcs, arc_at) = map(ts.buffers, strings)
    # Pieces stand side by side in every column, so each is cut at one list of edges.
    groups = np.unique(np.concatenate([head_group, pair_group]))
    h, p, t = (np.append(np.searchsorted(g, groups), len(g)) for g in (head_group[by_head], pair_group[by_pair], pair_group[owner]))
    a = np.concatenate([[0], np.cumsum(own_fan)])[t]
    small = lambda x: x.astype("<i4").view(np.uint8)
    columns = {
        "span": pa.array(groups % spans),
        "lang": coded.dictionary.take(pa.array(groups // spans)).cast(pa.string()),
        "heads": binaries(heads, head_at[h]),
        "head_n": binaries(small(head_n[by_head]), 4 * h),
        "pairs": binaries(pairs, pair_at[p]),
        "pair_n": binaries(small(pair_n[by_pair]), 4 * p),
        "tails": binaries(small(tail[by_pair] - np.repeat(t[:-1], np.diff(p))), 4 * p),
        "fans": binaries(small(own_fan), 4 * t),
        "arcs": binaries(arcs, arc_at[a]),
        "arc_n": binaries(small(arc_n[own_arc]), 4 * a),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def build(spans: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text", limit):
            for data, offsets, lang in text_parts(batch, limit):
                pieces = shard(data, offsets, lang, spans)
                if pieces is not None:
                    yield pieces

    return run


def unite(least: int, limit: int):
    """Streams pieces sorted by range and language; yields the frequent phrases of each, and its words under words = 0."""

    def finished(lang: str, whole: Transducer) -> Iterator[pa.RecordBatch]:
        found = [(0, pa.array([b""], pa.large_binary()), np.array([int(whole.head_n.sum())])), *whole.frequent(least)]
        for words, phrases, n in found:
            columns = [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), words, np.int32)), phrases.cast(pa.large_string()).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, langs = batch.column("span").to_numpy(), batch.column("lang")
            codes = langs.dictionary_encode().indices.to_numpy()
            fresh = np.flatnonzero((np.diff(spans) != 0) | (np.diff(codes) != 0)) + 1
            for low, high in zip([0, *fresh.tolist()], [*fresh.tolist(), batch.num_rows]):
                own = (int(spans[low]), langs[low].as_py())
                if own != key and held:
                    yield from finished(key[1], Transducer.united(held))
                    held, size = [], 0
                key = own
                pieces = batch.slice(low, high - low)
                size += sum(len(ts.buffers(pieces.column(b))[0]) for b in BLOBS)
                held.append(Transducer.read(pieces))
                if size > limit:
                    held, size = [Transducer.united(held)], 0
        if held:
            yield from finished(key[1], Transducer.united(held))
        pa.default_memory_pool().release_unused()

    return run


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, range_bytes: int = RANGE_BYTES, slice_bytes: int = SLICE, union_bytes: int = UNION_BYTES) -> DataFrame:
    """lang, words, phrase, f of all phrases of one to three words found ``least`` times; words = 0: all words of a range."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = rows.mapInArrow(build(max(1, -(-size // range_bytes)), slice_bytes), PIECE_SCHEMA)
    tasks = -(-size // TASK_BYTES)
    few = tasks <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition("span") if few else pieces.repartition(tasks, "span")
    return dealt.sortWithinPartitions("span", "lang").mapInArrow(unite(least, union_bytes), FREQUENT_SCHEMA)


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, absorbed: int = ABSORBED_PERCENT, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of two or three words of each language."""
    weights = stored(frequent_phrases(docs, least, **options), "phrases")
    totals = weights.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    found = weights.where("words >= 2")
    # Every cut writes a pair of parts; composing it with the united weights gives l and r.
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), cut)
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    parts = weights.where("words IN (1, 2)")
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    composed = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    composed = composed.withColumns({"above": big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"), "below": big("l") * big("r")})
    scored = composed.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # Two-word candidates inside a longer one with enough of their occurrences go.
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase")
    longer = found.where("words = 3").select("lang", inner, F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left_over = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    rows = left_over.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    ranked = top_k_per_key(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, spread=["phrase"])
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the best phrases of every language."""
    return collocations(documents(spark, sf_dir).select("lang", "text"))


ORACLE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
h AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT h.lang, h.k, h.phrase, a, cut, l.f AS l, r.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM h JOIN f l ON l.lang = h.lang AND l.phrase = h.first JOIN f r ON r.lang = h.lang AND r.phrase = h.rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM s),
o AS (SELECT DISTINCT short.lang, short.phrase FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) long
    JOIN c short USING (lang, phrase) WHERE 100 * long.a >= {ABSORBED_PERCENT} * short.a),
k AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase) WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= {TOP}
"""
