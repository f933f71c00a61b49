"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

1. One scan turns each text into its set of distinct word shingles (64-bit hashes), the set's size, a 128-bit
   digest of the set, and a sketch of ``BINS`` coordinates. Sketch rounds 1 to BINS throw every shingle into a
   hashed bin, rounds BINS+1 to 2*BINS throw all of them into one bin each, so that every coordinate
   fills; each coordinate keeps its smallest (round, hash). A set ends after the round that fills its last bin.
2. Equal sets are one class with its smallest (doc_id, text digest) as representative; only classes go on.
3. ``BANDS`` bands of ``BINS / BANDS`` coordinates. At Jaccard 0.8 a pair misses all 32 bands of 4 with probability
   5e-8. One member of each bucket, its centre, is compared with all others (a star: rows grow with the bucket, not
   its square), on whole sets rebuilt from the texts. Buckets pick centres by ``ORDERS`` different hash orders, so that the
   members of a large group, which meet in many buckets, meet several centres.
4. Links give components. Buckets that still hold several components get the exact rest: every member
   outside the bucket's largest component is compared with all members of other components, where the
   set sizes allow the similarity. Nothing is capped.

Texts are shipped once per pair, sorted behind their centre's text and streamed; a centre with many partners
is salted. Rows are named by doc_id and text digest, classes by a number of their own, so unlike texts under one id stay
apart. Defined cases: null or empty text has an empty set and links with nothing. A text with fewer words than a
shingle has its whole word sequence as its one shingle. Repeated rows form one class. Rows with a null doc_id take
part like any other under the id -2^63 and come back with null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textscan as ts
from evalspark.llm.common import documents, stored
from evalspark.llm.graph import components

BINS, BANDS = 128, 32
NO_ID = -(1 << 63)
PARTNERS_PER_TASK = 500
ORDERS = 8
PARITY_BITS = 2048
SKETCH_SCHEMA = "id long, row long, n long, d1 long, d2 long, bands array<long>, code array<long>"


def shingle_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and the row bounds."""
    data, offsets = ts.buffers(batch.column("text"))
    starts, ends, bounds = ts.words(data, offsets)
    hashes = ts.span_hashes(data, starts, ends, lower=True)
    all_grams = ts.grams(hashes, words)
    sets, out = [], np.zeros(len(bounds), np.int64)
    for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if high - low >= words:
            one = np.sort(all_grams[low : high - words + 1])
            fresh = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=fresh[1:])
            one = one[fresh]
        elif high > low:
            one = ts.grams(hashes[low:high], high - low, seed=1 + high - low)
        else:
            one = hashes[:0]
        sets.append(one)
        out[i + 1] = out[i] + len(one)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), out


def sketches(items: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates per set; rows of empty sets stay at the largest value."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(n), size)
    missing = np.where(size > 0, bins, 0)
    for turn in range(2 * bins):
        active = missing[row] > 0
        if not active.all():
            items, row = items[active], row[active]
        if not len(items):
            break
        hashed = ts.mix(items + np.uint64(0xA0761D6478BD642F * (turn + 1) % (1 << 64)))
        spot = row * bins + ((hashed >> np.uint64(57)).astype(np.int64) % bins if turn < bins else turn - bins)
        # The round stands above the hash, so that earlier rounds always win.
        value = (np.uint64(turn) << np.uint64(56)) | (hashed & np.uint64((1 << 56) - 1))
        free = out[spot] >= np.uint64(turn) << np.uint64(56)
        spot, value, at = spot[free], value[free], row[free]
        fresh = out[spot] == np.iinfo(np.uint64).max
        new = np.unique(spot[fresh])
        np.minimum.at(out, spot, value)
        missing -= np.bincount(new // bins, minlength=n)
    return out.reshape(n, bins)


def scan(words: int, bins: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, "text"):
            items, bounds = shingle_sets(batch, words)
            size = np.diff(bounds)
            digest = []
            for seed in (0x1B873593CC9E2D51, 0x52DCE729DA3ED8A5):
                total = np.zeros(len(items) + 1, np.uint64)
                np.cumsum(ts.mix(items ^ np.uint64(seed)), out=total[1:])
                digest.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            sketch = sketches(items, bounds, bins).reshape(len(size), bands, bins // bands)
            # Parity of the shingles in each of PARITY_BITS hashed places.
            spot = (ts.mix(items ^ np.uint64(0x2D358DCCAA6C78A5)) % np.uint64(PARITY_BITS)).astype(np.int64)
            parity = np.zeros((len(size), PARITY_BITS // 64), np.uint64)
            np.bitwise_xor.at(parity, (np.repeat(np.arange(len(size)), size), spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * parity.shape[1]), pa.array(parity.view(np.int64).reshape(-1)))
            key = np.full((len(size), bands), 0x51ED270B, np.uint64) + np.arange(bands, dtype=np.uint64)
            for j in range(bins // bands):
                key = ts.mix(key * ts.BASE + sketch[:, :, j])
            flat = pa.array(key.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(size.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), lists, codes],
                names=["id", "row", "n", "d1", "d2", "bands", "code"],
            )

    return run


def verify(words: int, percent: int):
    """Streams rows sorted by (centre, salt), the centre's own text first; yields the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in ts.slices(batches, "text"):
            items, bounds = shingle_sets(batch, words)
            a, b, own = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                one = items[bounds[i] : bounds[i + 1]]
                if own[i]:
                    centre, held = a[i], one.copy()
                elif centre == a[i] and 100 * min(len(one), len(held)) >= percent * max(len(one), len(held)):
                    spot = np.searchsorted(held, one)
                    spot[spot == len(held)] = 0
                    common = int(np.count_nonzero(held[spot] == one))
                    good[i] = 100 * common >= percent * (len(one) + len(held) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; ``texts``: id, text."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    degree = degree.select("a", F.ceil(F.col("partners") / PARTNERS_PER_TASK).cast("int").alias("salts"))
    salted = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("own"))
    centres = degree.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"))
    rows = salted.union(centres).join(texts, F.col("b") == texts["id"]).select("a", "b", "salt", "own", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("own")).mapInArrow(verify(words, percent), "a long, b long")


def least_difference(a: Column, b: Column) -> Column:
    """How many shingles are in one of two sets only, at least: each changes the parity of one place."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))


def rest_pairs(buckets: DataFrame, component: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket but different components that may still link.

    Both sides of the join carry the bucket; the left one holds only members outside the bucket's largest component. Pairs
    whose parities prove that the sets differ too much are not tried; this loses none.
    """
    member = buckets.join(component, "id", "left").join(sizes, "id").select("bucket", "id", "n", "code", F.coalesce("component", "id").alias("component"))
    share = member.groupBy("bucket", "component").agg(F.count("*").alias("members"))
    main = share.groupBy("bucket").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = member.join(main, "bucket")
    left = mixed.where("component <> main").select("bucket", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("code").alias("codex"), F.col("component").alias("cx"))
    near = (F.col("cx") != F.col("component")) & (100 * F.least("nx", "n") >= percent * F.greatest("nx", "n"))
    near &= (100 + percent) * least_difference(F.col("codex"), F.col("code")) <= (100 - percent) * (F.col("nx") + F.col("n"))
    return left.join(mixed, "bucket").where(near).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def named(docs: DataFrame) -> DataFrame:
    """id, row (digest of the text) and text: unlike texts that repeat an id, or have none, have names of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """id, row, n_shingles, component (smallest id linked directly or through others) and kept (id and row are the
    smallest) of every row."""
    rows = named(docs)
    scanned = stored(rows.mapInArrow(scan(words, bins, bands), SKETCH_SCHEMA), "sketches")
    filled = scanned.where("n > 0")
    classes = filled.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "row")).alias("rep"))
    # Numbers are fixed by writing them. They only name classes; which row is the smallest is asked by id and row.
    classes = stored(classes.select("n", "d1", "d2", "rep", F.monotonically_increasing_id().alias("class")), "classes")
    whole = scanned.drop("bands", "code").join(classes, ["n", "d1", "d2"], "left")
    first = F.struct("id", "row") == F.col("rep")
    reps = stored(filled.join(classes, ["n", "d1", "d2"]).where(first).dropDuplicates(["class"]).select(F.col("class").alias("id"), "rep", "n", "bands", "code"), "reps")
    keys = reps.select("id", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.pmod("bucket", F.lit(ORDERS)))).alias("centre"), F.count("*").alias("members")).where("members > 1").drop("members")
    buckets = stored(keys.join(shared, "bucket"), "buckets")
    wanted = reps.join(buckets.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("class"), F.col("rep.id").alias("id"), F.col("rep.row").alias("row"))
    texts = stored(rows.join(wanted, ["id", "row"]).select(F.col("class").alias("id"), "text").dropDuplicates(["id"]), "candidates")
    star = buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(linked(star, texts, words, percent), "links")
    component = components(links)
    more = stored(rest_pairs(buckets.select("bucket", "id"), component, reps.select("id", "n", "code"), percent), "rest")
    if not more.isEmpty():
        links = links.union(stored(linked(more, texts, words, percent), "links"))
        component = components(links)
    component = component.select(F.col("id").alias("class"), "component")
    low = component.join(classes.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("low"))
    joined = whole.join(component.join(low, "component").select("class", "low"), "class", "left")
    own = F.struct("id", "row")
    low = F.coalesce("low", "rep", own)
    return joined.select("id", "row", F.col("n").alias("n_shingles"), low["id"].alias("component"), (low == own).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked directly or through others) and kept (doc_id = component_id) of every row."""
    rows = grouped(docs, **options)
    whole = F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(NO_ID)).alias("component_id")
    return rows.select(*whole, (F.col("id") == F.col("component")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: four-word shingles, similarity 0.8."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=4)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays."""
    kept = grouped(docs).where("kept").select("id", "row").distinct()
    # Rows that repeat an id and a text are copies of each other: one stays, chosen before and after the shuffle.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    other = F.xxhash64(*[c for c, kind in docs.dtypes if c != "text" and "map<" not in kind])
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), F.struct("*").alias("whole"), other.alias("other"))
    best = whole.groupBy("id", "row").agg(F.min_by("whole", "other").alias("whole"))
    return best.join(kept, ["id", "row"], "left_semi").select(*[F.col("whole")[c].alias(c) for c in docs.columns])
