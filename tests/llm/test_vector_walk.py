"""The united graph across shards, double precision, odd lengths and sizes."""

import numpy as np
import pytest

from evalspark.llm import vector_graph


def brute(points, cosine=0.95):
    unit = vector_graph.unit(np.array(points, float))
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    return near


def test_leaving_edges_against_brute_force():
    draw = np.random.Generator(np.random.PCG64(11))
    n, home = 40, draw.integers(0, 12, (40, 3))
    heads = np.sort(draw.integers(0, n, 400))
    others, homes = draw.integers(100, 160, 400), draw.integers(0, 12, (400, 3))
    query, node = draw.integers(0, n, 300), draw.integers(0, n, 300)
    got = set(zip(*[x.tolist() for x in vector_graph.leaving(query, node, heads, others, homes, home)]))
    want = {(int(q), int(others[e])) for q, b in zip(query, node) for e in np.flatnonzero(heads == b) if not set(home[q]) & set(homes[e])}
    assert got == want
    none = np.zeros(0, int)
    assert [len(x) for x in vector_graph.leaving(none, none, none, none, np.zeros((0, 1), int), home)] == [0, 0]


def test_walk_crosses_shards(spark):
    # A chain on an arc: with one shard for each vector, neighbours over a border meet by the walk alone.
    angle = np.arange(240) * 0.05
    points = np.stack([np.cos(angle), np.sin(angle), np.full(240, 0.2)], axis=1)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    near = brute(points)
    for overlap, least in ((2, 0.97), (3, 0.99)):
        got = {r.vec_id: r.n_links for r in vector_graph.near_duplicates(frame, block=24, overlap=overlap).collect()}
        assert all(got[i] <= near[i].sum() for i in got)
        assert sum(got.values()) >= least * near.sum()
    assert vector_graph.audit(frame, block=24) >= 0.97


def test_walk_adds_links_and_ends(spark):
    angle = np.arange(60) * 0.1
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    classes = spark.createDataFrame(rows, "id long, embedding array<double>")
    homes = spark.createDataFrame([(i, [i // 10]) for i in range(60)], "id long, home array<long>")
    step = [(i, [(j, [j // 10]) for j in (i - 1, i + 1) if 0 <= j < 60]) for i in range(60)]
    lists = spark.createDataFrame(step, "id long, others array<struct<other: long, home: array<long>>>")
    pairs = spark.createDataFrame([(9, 10)], "a long, b long")
    got = {tuple(r) for r in vector_graph.walk(pairs.where("a < 0"), pairs, classes, lists, homes, 0.95, 0.1).collect()}
    # From 9 and 10 on, along edges over this border only: nothing out of range, nothing twice.
    near = brute([p for _, p in rows])
    assert (9, 10) in got and {(8, 10), (9, 11), (8, 11)} & got
    assert all(near[a, b] and a // 10 != b // 10 for a, b in got)


@pytest.mark.parametrize("size", [1e39, 1e300, 1e-200])
def test_doubles_of_any_size(spark, size):
    rows = [(1, [size, size]), (2, [size, 0.9 * size]), (3, [size, -size]), (4, None), (5, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", vector_graph.F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.near_duplicates(frame).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}


def test_recall_of_mixed_lengths(spark):
    draw = np.random.Generator(np.random.PCG64(5))
    rows = [(i, draw.normal(size=3 + i % 2).tolist()) for i in range(30)]
    rows += [(100 + i, [x * 1.01 for x in p]) for i, p in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    result = vector_graph.near_duplicates(frame)
    assert vector_graph.recall(frame, result) == 1.0
    assert vector_graph.audit(frame) == 1.0
    assert vector_graph.audit(frame.where("vec_id < 0")) == 1.0
