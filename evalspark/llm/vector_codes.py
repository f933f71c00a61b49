"""Vector code compression: product quantisation by Lloyd rounds over partition-local cover trees.

1. Vectors become integers, floor(``SCALE`` x), in chunks of ``CHUNK`` rows. For every part position a chunk holds one cover tree
   of its parts: the points in depth-first order, and nodes (a range of that order, a centre which is the range's
   first point, a radius). Children of a node lie within half its reach and further than that from each other. Chunks are
   written to the shared folder once and read by all rounds.
2. A round sends the codebooks (``ENTRIES`` entries a part, a few kB) to all tasks. A node goes to an entry as a whole if the
   triangle inequality says so: the nearest entry's distance to the centre plus the radius stays below the second's
   minus the radius. Its sum is a difference of cumulative sums. Other nodes descend, and the points of leaves that stay
   ambiguous are compared exactly, ties to the lower index.
3. Tasks emit one sum per (part, entry, position); Spark adds them up with map-side aggregation, so that at most parts x entries x
   positions numbers reach the driver, which makes the next codebooks.
4. The last pass writes each vector's code and its exact error.

All sums and distances that decide are integers; floating point numbers only rule out, with a margin. Vectors with a scaled component
beyond 2^26 take a slower path over unbounded integers, so that any finite double is exact there too.

Defined cases: vectors that are null or hold null or non-finite components go. A vector shorter than the widest, or of a width that is
no multiple of the number of parts, counts as if continued with zeros. Fewer kept rows than entries give that many entries. Null vec_ids
come after all others, rows that repeat a vec_id are ordered by their components; each is a row of its own. Null labels are equal
to each other. Errors beyond the range of a long are given as its largest value. Empty tables give empty tables;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored
from evalspark.session import configure

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CHUNK, LEAF = 2048, 24
WIDE = 1 << 26  # components from here on take the path of unbounded integers
LIMB = 30
LARGEST = (1 << 63) - 1
LABEL_SALTS = 64
CHUNK_SCHEMA = "ids array<long>, labels array<string>, points binary, sorted binary, nodes binary, radii binary, wide array<array<string>>"
SUM_SCHEMA = "part int, entry int, place int, limb int, total long, n long"
CODE_SCHEMA = "vec_id long, label string, codes binary, error long"


def scaled(value: float, scale: int) -> int:
    """floor(scale * value), exactly for every finite double."""
    return int(value) * scale if abs(value) >= 1 << 53 else math.floor(value * scale)


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, nodes (first, end, first child, children), radii. Children of a node stand side by side.

    A node's centre is the first point of its range and the centre of its own first child.
    """
    order, nodes, radii = np.arange(len(points)), [[0, len(points), 0, 0]], [0.0]
    todo = [(0, np.arange(len(points)), None)]
    while todo:
        number, members, distance = todo.pop()
        if distance is None:
            distance = np.sqrt(((points[members] - points[members[0]]).astype(np.float64) ** 2).sum(axis=1))
        low, end = nodes[number][:2]
        radii[number] = reach = float(distance.max(initial=0.0))
        order[low:end] = members
        if len(members) <= leaf or reach == 0:
            continue
        parts, left = [], np.arange(len(members))
        from_centre = distance
        while len(left):
            near = from_centre <= reach / 2
            near[0] = True
            parts.append((members[left[near]], from_centre[near]))
            left = left[~near]
            if len(left):
                from_centre = np.sqrt(((points[members[left]] - points[members[left[0]]]).astype(np.float64) ** 2).sum(axis=1))
        nodes[number][2:] = [len(nodes), len(parts)]
        for part, own in parts:
            todo.append((len(nodes), part, own))
            nodes.append([low, low + len(part), 0, 0])
            radii.append(0.0)
            low += len(part)
    return order, np.array(nodes, np.int32), np.array(radii)


def exact(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point (ties: the lower index) and the squared distance; integers of any kind."""
    distance = np.stack([((points - entry) ** 2).sum(axis=1) for entry in entries], axis=1)
    best = np.argmin(distance, axis=1) if len(points) else np.zeros(0, np.int64)
    return best.astype(np.int64), distance[np.arange(len(points)), best]


def assign(points: np.ndarray, nodes: np.ndarray, radii: np.ndarray, entries: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Whole subtrees as (first, end, entry), then the numbers and entries of the points that were compared exactly.

    ``points``: one part of a chunk in tree order, as integers below ``WIDE``.
    """
    codes = entries.astype(np.float64)
    norms = (codes**2).sum(axis=1)
    ranges, single, front = [], [], np.zeros(1, np.int64)
    while len(front):
        centre = points[nodes[front, 0]].astype(np.float64)
        square = (centre**2).sum(axis=1)[:, None] + norms - 2 * centre @ codes.T
        # Rounding: far above what 53 bits lose in the terms of a square.
        slack = 1e-12 * ((centre**2).sum(axis=1) + norms.max()) + 1e-9
        best = np.argmin(square, axis=1)
        nearest = np.sqrt(np.maximum(square[np.arange(len(front)), best] + slack, 0))
        if len(entries) > 1:
            square[np.arange(len(front)), best] = np.inf
            second = np.sqrt(np.maximum(square.min(axis=1) - slack, 0))
        else:
            second = np.full(len(front), np.inf)
        sure = nearest + 2 * radii[front] * (1 + 1e-9) < second * (1 - 1e-9)
        ranges += [np.column_stack([nodes[front[sure], :2], best[sure]])]
        open_nodes = nodes[front[~sure]]
        leaf = open_nodes[:, 3] == 0
        for low, end in open_nodes[leaf, :2].tolist():
            single.append(np.arange(low, end))
        first, count = open_nodes[~leaf, 2].astype(np.int64), open_nodes[~leaf, 3].astype(np.int64)
        front = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    single = np.concatenate(single) if single else np.zeros(0, np.int64)
    return np.concatenate(ranges), single, exact(points[single], entries)[0]


def build_chunks(parts: int, width: int, scale: int, chunk: int, leaf: int):
    """One row per chunk: ids, labels, integer parts in row order, then per part the tree. Wide vectors as decimal text."""
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                size = np.diff(part.column("vector").offsets.to_numpy()).astype(np.int64)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                real = np.zeros((len(size), width))
                real[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
                wide = (np.abs(real) >= WIDE / scale - 1).any(axis=1)
                whole = np.floor(real[~wide] * scale).astype(np.int32).reshape(-1, parts, step)
                keep = pa.array(np.concatenate([np.flatnonzero(~wide), np.flatnonzero(wide)]))
                trees = [cover_tree(whole[:, p].astype(np.int64), leaf) if len(whole) else (np.zeros(0, np.int64), np.zeros((0, 4), np.int32), np.zeros(0)) for p in range(parts)]
                nodes = np.concatenate([np.column_stack([np.full(len(n), p, np.int32), n]) for p, (_, n, _) in enumerate(trees)])
                columns = {
                    "ids": pa.array([part.column("vec_id").take(keep).to_pylist()], pa.list_(pa.int64())),
                    "labels": pa.array([part.column("label").take(keep).to_pylist()], pa.list_(pa.string())),
                    "points": pa.array([whole.astype("<i4").tobytes()], pa.binary()),
                    "sorted": pa.array([np.stack([o for o, _, _ in trees]).astype("<i4").tobytes()], pa.binary()),
                    "nodes": pa.array([nodes.astype("<i4").tobytes()], pa.binary()),
                    "radii": pa.array([np.concatenate([r for _, _, r in trees]).astype("<f8").tobytes()], pa.binary()),
                    "wide": pa.array([[[str(scaled(x, scale)) for x in v] for v in real[wide].tolist()]], pa.list_(pa.list_(pa.string()))),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


class Chunk:
    """One stored chunk: ``narrow`` points (rows, parts, step) with a tree per part, then ``wide`` ones as Python integers."""

    def __init__(self, row: dict, parts: int, step: int):
        self.ids, self.labels = row["ids"], row["labels"]
        self.narrow = np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(-1, parts, step)
        self.order = np.frombuffer(row["sorted"], "<i4").reshape(parts, len(self.narrow))
        nodes = np.frombuffer(row["nodes"], "<i4").reshape(-1, 5)
        self.nodes = [nodes[nodes[:, 0] == p, 1:] for p in range(parts)]
        radii = np.frombuffer(row["radii"], "<f8")
        self.radii = [radii[nodes[:, 0] == p] for p in range(parts)]
        wide = [[int(x) for x in v] for v in row["wide"]]
        self.wide = np.array(wide, object).reshape(len(wide), parts, step)

    def sums(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Componentwise sums and counts of the points assigned to each entry."""
        total, count = np.zeros(entries.shape, object), np.zeros(len(entries), np.int64)
        narrow = self.narrow[:, part]
        if entries.dtype != object and len(narrow):
            points = narrow[self.order[part]]
            ranges, single, own = assign(points, self.nodes[part], self.radii[part], entries)
            before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
            low, end, best = ranges.T
            add = np.zeros(entries.shape, np.int64)
            np.add.at(add, best, before[end] - before[low])
            np.add.at(add, own, points[single])
            total += add
            count += np.bincount(best, end - low, len(entries)).astype(np.int64) + np.bincount(own, minlength=len(entries))
            narrow = narrow[:0]
        for points in (narrow, self.wide[:, part]):
            if len(points):
                best, _ = exact(points.astype(object), entries.astype(object))
                for entry in np.unique(best):
                    total[entry] += points[best == entry].astype(object).sum(axis=0)
                count += np.bincount(best, minlength=len(entries))
        return total, count

    def codes(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Entry and exact squared distance of every point, in the order of ``ids``."""
        best, error = np.zeros(len(self.ids), np.int64), []
        narrow = self.narrow[:, part]
        if entries.dtype != object:
            if len(narrow):
                order = self.order[part]
                points = narrow[order]
                ranges, single, own = assign(points, self.nodes[part], self.radii[part], entries)
                low, end, entry = ranges.T
                inside = np.repeat(low - (np.cumsum(end - low) - (end - low)), end - low) + np.arange(int((end - low).sum()))
                best[order[inside]] = np.repeat(entry, end - low)
                best[order[single]] = own
                error = ((narrow - entries[best[: len(narrow)]]) ** 2).sum(axis=1).tolist()
            rest = self.wide[:, part]
        else:
            rest = np.concatenate([narrow.astype(object), self.wide[:, part]])
        if len(rest):
            own, far = exact(rest, entries.astype(object))
            best[len(self.ids) - len(rest) :] = own
            error += far.tolist()
        return best, error


def held(codebooks: list[list[list[int]]]) -> list[np.ndarray]:
    """Codebooks as integer arrays; those with a wide component as Python integers."""
    return [np.array(book, object if any(abs(x) >= WIDE for entry in book for x in entry) else np.int64).reshape(len(book), -1) for book in codebooks]


def limbs(value: int) -> list[int]:
    """``value`` in signed digits to the base 2^30; Spark can add up each digit as a long."""
    if abs(value) < 1 << 50:
        return [value]
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def sum_parts(codebooks: list, step: int):
    """One task's sums over all of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held(codebooks)
        totals, counts = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = Chunk(batch.slice(at, 1).to_pylist()[0], len(books), step)
                for p, book in enumerate(books):
                    total, count = chunk.sums(p, book)
                    totals[p] += total
                    counts[p] += count
        rows = [
            (p, e, place, limb, digit, int(count) if limb == 0 else 0)
            for p, (total, counted) in enumerate(zip(totals, counts))
            for e, (entry, count) in enumerate(zip(total, counted))
            if count
            for place, value in enumerate(entry)
            for limb, digit in enumerate(limbs(int(value)))
        ]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "entry", "place", "limb", "total", "n"])

    return run


def code_rows(codebooks: list, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held(codebooks)
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = Chunk(batch.slice(at, 1).to_pylist()[0], len(books), step)
                coded = [chunk.codes(p, book) for p, book in enumerate(books)]
                codes = np.stack([best for best, _ in coded], axis=1).astype("<u1" if max(map(len, books)) <= 256 else "<u2")
                error = [min(LARGEST, sum(values)) for values in zip(*(far for _, far in coded))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.ids, pa.int64()), pa.array(chunk.labels, pa.string()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "codes", "error"],
                )

    return run


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def lloyd(chunks: DataFrame, codebooks: list, step: int, rounds: int) -> list:
    """Codebooks after ``rounds`` rounds: each entry becomes the floored mean of its parts, unused ones stay."""
    for _ in range(rounds):
        sums = chunks.mapInArrow(sum_parts(codebooks, step), SUM_SCHEMA)
        sums = sums.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        total: dict[tuple, int] = {}
        count: dict[tuple, int] = {}
        # At most parts * entries * positions rows, a few digits each: the size of the codebooks.
        for p, e, place, limb, digits, n in sums.collect():
            total[p, e, place] = total.get((p, e, place), 0) + (digits << LIMB * limb if digits >= 0 else -(-digits << LIMB * limb))
            count[p, e, place] = count.get((p, e, place), 0) + n
        codebooks = [[[total[p, e, i] // count[p, e, i] if (p, e, i) in count else x for i, x in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(codebooks)]
    return codebooks


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK, leaf: int = LEAF) -> tuple[DataFrame, list]:
    """(vec_id, label, codes: one byte per part, error) of every usable row of ``vectors`` (vec_id, embedding, label), and the codebooks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")))
    widest = rows.agg(F.max(F.size("vector"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], CODE_SCHEMA), [[] for _ in range(parts)]
    width = -(-max(1, widest) // parts) * parts
    step = width // parts
    first = [r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()]
    whole = [[scaled(x, scale) for x in v] + [0] * (width - len(v)) for v in first]
    codebooks = [[v[p * step : (p + 1) * step] for v in whole] for p in range(parts)]
    chunks = stored(rows.mapInArrow(build_chunks(parts, width, scale, chunk, leaf), CHUNK_SCHEMA), "cover-trees")
    codebooks = lloyd(chunks, codebooks, step, rounds)
    return chunks.mapInArrow(code_rows(codebooks, step), CODE_SCHEMA), codebooks


def digest(codebooks: list) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def with_label_errors(coded: DataFrame, salts: int = LABEL_SALTS) -> DataFrame:
    """``label_error`` beside every row: sums per label, added up before the shuffle, meet rows salted within their label."""
    label = F.struct(F.coalesce("label", F.lit("")).alias("text"), F.col("label").isNull().alias("none"))
    keyed = coded.withColumn("key", label)
    sums = keyed.groupBy("key").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST).cast("decimal(30,0)")).cast("long").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes", "error"), F.lit(salts)).cast("int"))
    return salted.join(sums, ["key", "salt"]).drop("key", "salt")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: codes, errors and label errors of all usable vectors, with the digest of the codebooks."""
    coded, codebooks = compress(configure(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = with_label_errors(stored(coded, "codes"))
    hexes = F.lower(F.hex("codes"))
    return rows.select("vec_id", hexes.alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rounds as a chain of joins and aggregates over single components."""
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT id, len(v) // {parts} AS step, unnest(v) AS val, generate_subscripts(v, 1) - 1 AS i FROM kept),
x AS MATERIALIZED (SELECT id, i // step AS part, i % step AS place, val FROM u),
c0 AS MATERIALIZED (SELECT part, CAST(id - 1 AS BIGINT) AS entry, place, CAST(val AS HUGEINT) AS val FROM x WHERE id <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT id, part, entry, sum((x.val - c.val) * (x.val - c.val)) AS far FROM x JOIN c{r} c USING (part, place) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT id, part, min(far * {entries} + entry) AS best FROM d{r} GROUP BY ALL)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT part, best % {entries} AS entry, place, CAST(sum(x.val) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS n FROM x JOIN a{r} USING (id, part) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce((total - ((total % n) + n) % n) // n, val) AS val FROM c{r} LEFT JOIN s{r} USING (part, entry, place))"""
            )
    return (
        ",\n".join(steps)
        + f""",
coded AS (SELECT id, string_agg(printf('%02x', CAST(best % {entries} AS INT)), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""
    )


ORACLE_SQL = oracle_sql()
