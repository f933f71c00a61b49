"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors become one class. Centroids come from a bounded sample of classes; every class goes to the shards of
   its ``OVERLAP`` nearest centroids. Shards above ``BLOCK`` vectors are cut into blocks, and each pair of blocks meets
   in a task of its own, so that a crowd of near copies never gathers in one task.
2. Each task builds a graph of its vectors: candidate neighbours, thinned by the robust rule (a neighbour goes if a kept one is
   nearer to it by the factor ``ALPHA``). The adjacency lists of a vector from all its tasks are united.
3. Each task searches the united graph for all of its vectors at once: greedily from the medoid, then expanding from
   every node inside the range (plus a margin) until nothing new is in range. Edges that lead to a vector which shares no shard
   with the query are handed on: rounds of joins compare these pairs and expand from those in range (plus the margin) along
   the united lists, until a round finds nothing new.
4. Links are the pairs whose cosine, in double precision, reaches the bound. Components follow from the links.

``audit`` looks up the true partners of a sample of classes among all others in the links, ``recall`` compares counts of links.
Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different
lengths never link. Equal rows count as vectors of their own; rows that repeat a vec_id with other vectors share its links. Null
vec_ids take part under -2^63 and come back as null. Components of any size count, single ones stay as they are, all others are
doubles. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored
from evalspark.llm.graph import components
from evalspark.session import configure

COSINE = 0.95
MARGIN = 0.1
BLOCK = 1024
OVERLAP = 3
MAX_CENTROIDS = 16_384
SAMPLE_PER_CENTROID = 8
CANDIDATES, DEGREE, ALPHA = 64, 24, 1.2
NO_ID = -(1 << 63)


def unit(rows: np.ndarray) -> np.ndarray:
    # A power of two takes out the size first, so that squares of very large or small components stay finite.
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy().astype(float).reshape(len(column), -1)


def cosines(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 16):
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", v[a[at : at + (1 << 16)]], v[b[at : at + (1 << 16)]])
    return out


def centroids(classes: DataFrame, block: int) -> np.ndarray:
    """Unit vectors of a bounded sample, moved twice towards the mean of what is nearest to them."""
    wanted = min(MAX_CENTROIDS, max(1, -(-classes.count() * OVERLAP // block)))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(wanted * SAMPLE_PER_CENTROID).select("embedding").toArrow()
    lists = [x for x in sample.column("embedding").to_pylist()]
    if not lists:
        return np.zeros((0, 0))
    width = np.bincount([len(x) for x in lists]).argmax()
    points = unit(np.array([x for x in lists if len(x) == width], float))
    middle = points[:wanted]
    for _ in range(2):
        near = np.concatenate([(points[at : at + 4096] @ middle.T).argmax(axis=1) for at in range(0, len(points), 4096)])
        total = np.zeros_like(middle)
        np.add.at(total, near, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        middle = np.where(size > 0, total / np.maximum(size, 1e-12), middle)
    return middle


def assign(middle: np.ndarray, overlap: int):
    """One row per class and shard, with all its shards as ``home``; other lengths than the centroids' get a shard of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                length = np.array(pc.list_value_length(batch.column("embedding")))
                source, shard, home = [], [], []
                fit = np.flatnonzero(length == middle.shape[1]) if middle.size else np.zeros(0, int)
                if len(fit):
                    near = unit(matrix(batch.column("embedding").take(pa.array(fit)))) @ middle.T
                    count = min(overlap, near.shape[1])
                    top = np.argpartition(-near, count - 1, axis=1)[:, :count]
                    source.append(np.repeat(fit, count))
                    shard.append(top.reshape(-1))
                    home += np.repeat(top, count, axis=0).tolist()
                other = np.setdiff1d(np.arange(len(length)), fit)
                source.append(other)
                shard.append(-length[other].astype(np.int64))
                home += [[x] for x in shard[-1].tolist()]
                take = pa.array(np.concatenate(source))
                columns = [pa.array(np.concatenate(shard).astype(np.int64)), pa.array(home, pa.list_(pa.int64())), batch.column("id").take(take), batch.column("embedding").take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "home", "id", "embedding"])

    return run


def robust_lists(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, neighbour) of the pruned graph: among the nearest candidates, each kept one removes those it covers."""
    n = len(v)
    count = min(CANDIDATES, n - 1)
    if count <= 0:
        return np.zeros(0, int), np.zeros(0, int)
    near = v @ v.T
    np.fill_diagonal(near, -2)
    pool = np.argpartition(-near, count - 1, axis=1)[:, :count]
    pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(near, pool, 1), axis=1, kind="stable"), 1)
    np.fill_diagonal(near, 1)
    gap = 2 - 2 * np.take_along_axis(near, pool, 1)
    open_, nodes, others, every = np.ones(pool.shape, bool), [], [], np.arange(n)
    for _ in range(DEGREE):
        some = open_.any(axis=1)
        if not some.any():
            break
        rows, pick = every[some], open_[some].argmax(axis=1)
        chosen = pool[rows, pick]
        nodes.append(rows)
        others.append(chosen)
        covered = (2 - 2 * near[chosen[:, None], pool[rows]]) * ALPHA**2 <= gap[rows]
        open_[rows] &= ~covered
        open_[rows, pick] = False
    return np.concatenate(nodes), np.concatenate(others)


def range_search(v: np.ndarray, heads: np.ndarray, tails: np.ndarray, cosine: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) in range plus margin, and which of them are in range, for all nodes as queries, over the graph's edges."""
    n = len(v)
    order = np.argsort(heads, kind="stable")
    tails, start = tails[order], np.searchsorted(heads[order], np.arange(n + 1))

    def neighbours(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = start[node + 1] - start[node]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[node], size)
        return np.repeat(query, size), tails[place]

    medoid = int((v @ v.mean(axis=0)).argmax())
    now, best = np.full(n, medoid), v @ v[medoid]
    moving = np.arange(n)
    while len(moving):
        query, node = neighbours(moving, now[moving])
        if not len(query):
            break
        near = cosines(v, query, node)
        rank = np.lexsort((-near, query))
        head = rank[np.r_[True, query[rank][1:] != query[rank][:-1]]]
        better = near[head] > best[query[head]]
        moving = query[head][better]
        now[moving], best[moving] = node[head][better], near[head][better]
    # Each query is a node itself, so its own list is a second place to start from.
    seen = np.zeros(n * n, bool)
    frontier = np.unique(np.concatenate([np.arange(n) * n + now, np.arange(n) * (n + 1)]))
    seen[frontier] = True
    value = cosines(v, frontier // n, frontier % n)
    found, close = [frontier[value >= cosine - margin]], [value[value >= cosine - margin]]
    while len(frontier):
        pieces = []
        for at in range(0, len(frontier), 1 << 15):
            query, node = neighbours(frontier[at : at + (1 << 15)] // n, frontier[at : at + (1 << 15)] % n)
            flat = query * n + node
            flat = np.unique(flat[~seen[flat]])
            seen[flat] = True
            near = cosines(v, flat // n, flat % n)
            pieces.append(flat[near >= cosine - margin])
            close.append(near[near >= cosine - margin])
        frontier = np.concatenate(pieces)
        found.append(frontier)
    flat, close = np.concatenate(found), np.concatenate(close)
    query, node = flat // n, flat % n
    other = query != node
    return query[other], node[other], close[other] >= cosine


def runs(size: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Bounds of runs whose sizes sum up to about ``limit`` at most."""
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), limit))).tolist() if len(size) else []
    return list(zip(cuts, [*cuts[1:], len(size)]))


def spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each of the ranges, one behind the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def leaving(query: np.ndarray, node: np.ndarray, heads: np.ndarray, others: np.ndarray, homes: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, id): ids in the lists of the nodes a query came to that share no shard with the query.

    ``others`` are the ids of all lists and ``homes`` their shards, sorted by ``heads``; ``home`` are the shards of the nodes.
    Queries with the same shards ask a list once, so that a crowd costs no more than its members.
    """
    n, none = len(home), np.zeros(0, np.int64)
    start = np.searchsorted(heads, np.arange(n + 1))
    names, name = np.unique(others, return_inverse=True)
    kinds, kind = np.unique(home, axis=0, return_inverse=True)
    asked, ask = np.unique(kind[query] * n + node, return_inverse=True)
    order = np.argsort(ask, kind="stable")
    query, ask = query[order], ask[order]
    low = start[asked % n]
    size = start[asked % n + 1] - low
    found = [none]
    for a, z in runs(size, 1 << 18):
        place, by = spread(low[a:z], size[a:z]), np.repeat(np.arange(a, z), size[a:z])
        apart = ~(homes[place][:, :, None] == kinds[asked[by] // n][:, None, :]).any(axis=(1, 2))
        place, by = place[apart], by[apart]
        mine = slice(np.searchsorted(ask, a), np.searchsorted(ask, z))
        first, last = np.searchsorted(by, ask[mine]), np.searchsorted(by, ask[mine], "right")
        for i, j in runs(last - first, 1 << 20):
            count = (last - first)[i:j]
            found.append(np.unique(np.repeat(query[mine][i:j], count) * len(names) + name[place[spread(first[i:j], count)]]))
    flat = np.unique(np.concatenate(found))
    return (flat // len(names), names[flat % len(names)]) if len(flat) else (none, none)


def build(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    heads, tails = robust_lists(unit(matrix(table.column("embedding"))))
    others = np.r_[tails, heads]
    return pa.table({"id": ids[np.r_[heads, tails]], "other": ids[others], "home": table.column("home").combine_chunks().take(pa.array(others))})


def search(cosine: float, margin: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        lists = table.column("others").combine_chunks()
        heads = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        wanted, homes = lists.flatten().flatten()
        wanted = wanted.to_numpy()
        tails = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        here = ids[tails] == wanted
        query, node, link = range_search(unit(matrix(table.column("embedding"))), heads[here], tails[here], cosine, margin)
        home = matrix(table.column("home")).astype(np.int64)
        homes = matrix(homes).astype(np.int64) if len(wanted) else np.zeros((0, 1), np.int64)
        outside = leaving(query, node, heads[~here], wanted[~here], homes[~here], home)
        query, node = query[link], node[link]
        # Blocks of one shard meet pairwise; pairs inside a block belong to the block's meeting with itself.
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        good = same | (block[query] != block[node])
        a, b = np.r_[ids[query[good]], ids[outside[0]]], np.r_[ids[node[good]], outside[1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "link": np.arange(len(a)) < good.sum()})

    return run


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cosine to rows (a, b, x, y) of two vectors."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            near = np.einsum("ij,ij->i", unit(matrix(batch.column("x"))), unit(matrix(batch.column("y"))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], names=["a", "b", "near"])


def walk(found: DataFrame, tries: DataFrame, classes: DataFrame, lists: DataFrame, homes: DataFrame, cosine: float, margin: float) -> DataFrame:
    """``found`` and the pairs in range that rounds of joins reach from the pairs ``tries``, which share no shard."""
    seen = tries
    x, y = classes.select(F.col("id").alias("a"), F.col("embedding").alias("x")), classes.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
    own = homes.select(F.col("id").alias("q"), F.col("home").alias("from"))
    while not tries.isEmpty():
        # Lists join vectors of one length only, because shards do.
        near = stored(tries.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, near double"), "walked")
        found = found.union(near.where(F.col("near") >= cosine).select("a", "b"))
        near = near.where(F.col("near") >= cosine - margin)
        ends = near.select(F.col("a").alias("q"), F.col("b").alias("id")).union(near.select(F.col("b").alias("q"), F.col("a").alias("id")))
        steps = ends.join(lists, "id").select("q", F.explode("others").alias("to")).join(own, "q")
        steps = steps.where((F.col("q") != F.col("to.other")) & ~F.arrays_overlap("from", "to.home"))
        steps = steps.select(F.least("q", "to.other").alias("a"), F.greatest("q", "to.other").alias("b")).distinct()
        tries = stored(steps.join(seen, ["a", "b"], "left_anti"), "walk")
        seen = seen.union(tries)
    return found


def links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK, overlap: int = OVERLAP, margin: float = MARGIN) -> DataFrame:
    """Pairs (a < b) of classes (id, embedding) in range."""
    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.mapInArrow(assign(centroids(classes, block), overlap), f"shard long, home array<long>, id long, embedding {kind}")
    shards = stored(placed, "shards")
    # At most MAX_CENTROIDS rows and one for each other length.
    blocks = shards.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = shards.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meeting = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = stored(meeting.select("shard", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "home", "id", "embedding"), "tasks")
    edges = tasks.groupBy("shard", "lo", "hi").applyInArrow(build, "id long, other long, home array<long>")
    lists = stored(edges.groupBy("id").agg(F.collect_set(F.struct("other", "home")).alias("others")), "lists")
    found = tasks.join(lists, "id", "left").groupBy("shard", "lo", "hi").applyInArrow(search(cosine, margin), "a long, b long, link boolean")
    found = stored(found.distinct(), "found")
    homes = shards.select("id", "home").dropDuplicates(["id"])
    reached = walk(found.where("link").select("a", "b"), found.where("not link").select("a", "b"), classes, lists, homes, cosine, margin)
    return stored(reached, "links")


def usable(embedding: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def classed(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (id, embedding), the usable ones, and their classes (embedding, rep, size)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("embedding").cast(kind).alias("embedding"))
    good = rows.where(usable(F.col("embedding")))
    return rows, good, stored(good.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    rows, good, groups = classed(vectors)
    groups = groups.withColumn("id", F.col("rep"))
    found = links(groups.select("id", "embedding"), **options)
    size = groups.select("id", "size")
    both = found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("size").alias("linked"))
    component = components(found)
    named = groups.join(degree, "id", "left").join(component, "id", "left")
    named = named.select("embedding", "rep", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    alone = rows.where(~usable(F.col("embedding"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    joined = good.join(named, "embedding").select("id", "n_links", "component").union(alone)
    return joined.select(F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "n_links", F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def partners(rows: DataFrame, queries: int, cosine: float) -> DataFrame:
    """All pairs (q, id) in range of ``queries`` hashed-picked rows (id, embedding), by comparing each with every row."""
    asked = rows.orderBy(F.xxhash64("id"), "id").limit(queries).toArrow()
    ids, length = asked.column("id").to_numpy(), np.array(pc.list_value_length(asked.column("embedding")))
    by_length = {int(n): (ids[length == n], unit(matrix(asked.column("embedding").filter(pa.array(length == n))))) for n in set(length.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(pc.list_value_length(batch.column("embedding")))
            for n, (names, q) in by_length.items():
                some = batch.filter(pa.array(size == n))
                hit = np.argwhere(unit(matrix(some.column("embedding"))) @ q.T >= cosine) if some.num_rows else np.zeros((0, 2), int)
                yield pa.RecordBatch.from_arrays([pa.array(names[hit[:, 1]]), some.column("id").take(pa.array(hit[:, 0]))], names=["q", "id"])

    return rows.mapInArrow(run, "q long, id long").where("q <> id")


def audit(vectors: DataFrame, queries: int = 64, cosine: float = COSINE, **options) -> float:
    """Share of the true partners of ``queries`` hashed-picked classes of equal vectors that the links name."""
    classes = classed(vectors)[2].select(F.col("rep").alias("id"), "embedding")
    found = links(classes, cosine, **options)
    both = found.select(F.col("a").alias("q"), F.col("b").alias("id")).union(found.select(F.col("b").alias("q"), F.col("a").alias("id")))
    true = partners(classes, queries, cosine)
    row = true.join(both.withColumn("hit", F.lit(1)), ["q", "id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0


def recall(vectors: DataFrame, result: DataFrame, queries: int = 64, cosine: float = COSINE) -> float:
    """Share of the true links of ``queries`` hashed-picked vectors that ``result`` counts."""
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), "embedding")
    true = partners(rows, queries, cosine).groupBy("q").agg(F.count("*").alias("n"))
    row = true.join(result, F.col("q") == F.col("vec_id")).agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0


def query(spark, sf_dir: str) -> DataFrame:
    """op9: links and components of all embeddings."""
    return near_duplicates(configure(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
