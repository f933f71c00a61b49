"""Splits, limits, re-ingest, statistics, validation and referential actions."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import catalog, row_functions
from evalspark.session import work_dir
from evalspark.sources import splits
from evalspark.sources.adapters import REGISTRY


def test_scan_skips_absent_splits(spark, tmp_path, rows):
    rows("a int", (1,), (2,)).write.parquet(str(tmp_path / "train"))
    rows("a int, b string", (3, "x")).write.parquet(str(tmp_path / "test"))
    paths = {name: str(tmp_path / name) for name in ("train", "test", "dev")}
    out = splits.scan_splits(spark, paths, ["train", "dev", "test"]).collect()
    assert sorted((r["split"], r["a"], r["b"]) for r in out) == [
        ("test", 3, "x"), ("train", 1, None), ("train", 2, None),
    ]


def raw_rows(rows, *parts):
    data = [(s, p, f"q{s}{p}", ["a", "b"], 0, "s") for s, n in parts for p in range(n)]
    return rows("split string, pos long, question string, choices array<string>, answer int, subject string", *data)


def test_limit_spends_splits_in_order(rows):
    raw = raw_rows(rows, ("dev", 4), ("validation", 3), ("test", 2))
    out = catalog.take_in_split_order(raw, REGISTRY["mmlu"].splits, 4).collect()
    assert sorted((r["split"], r["pos"]) for r in out) == [
        ("test", 0), ("test", 1), ("validation", 0), ("validation", 1),
    ]


def test_limit_with_sparse_positions(rows):
    data = [("train", p * p * 1000 + 5) for p in range(120)]
    raw = rows("split string, pos long", *data)
    for limit in (1, 7, 119, 120, 500):
        out = catalog.take_in_split_order(raw, ("test", "train"), limit).collect()
        assert sorted(r["pos"] for r in out) == [p for _, p in data][:limit]


def test_reingest_twice_is_once(spark, rows):
    path = work_dir(spark, "test-reingest")
    raw = raw_rows(rows, ("test", 5), ("dev", 2))
    first = REGISTRY["mmlu"].normalise(raw)
    other = REGISTRY["mmlu"].normalise(raw, dataset_id=99)
    catalog.write_examples(first.unionByName(other), path)
    catalog.write_examples(first.where("split = 'test'"), path)
    catalog.write_examples(first.where("split = 'test'"), path)
    stored = spark.read.parquet(path)
    assert {r["dataset_id"]: r["count"] for r in stored.groupBy("dataset_id").count().collect()} == {1: 5, 99: 7}


def test_stats_record(rows):
    examples = REGISTRY["mmlu"].normalise(raw_rows(rows, ("test", 3), ("dev", 1)))
    stats = json.loads(catalog.stats_record(examples, REGISTRY["mmlu"]).first()["stats"])
    assert stats == {"total_examples": 4, "splits": {"dev": 1, "test": 3}, "subjects": {"s": 4}}


def test_register_keeps_known_names(rows):
    known = rows("id long, name string, task_type string", (1, "a", "t"))
    offered = rows("name string, task_type string", ("a", "t"), ("b", "u"), ("b", "u"))
    out = {r["name"]: r for r in catalog.register(known, offered).collect()}
    assert len(out) == 2 and out["a"]["id"] == 1 and not out["a"]["is_new"]
    assert out["b"]["is_new"] and out["b"]["id"] > 1


def test_validation_lists_every_error(rows):
    parsed = rows("dataset_id long, question string", (1, "q"), (None, ""), (2, None))
    got = {r["error"]: r["n"] for r in catalog.error_summary(parsed).collect()}
    assert got == {"missing dataset_id": 1, "question is empty or None": 2, "missing split": 3}


def test_custom_ingest_puts_the_split_into_metadata(rows):
    raw = rows("pos long, split string, body string", (1, "train", "x"), (2, "test", "y"))
    out = catalog.ingest_custom(raw, lambda r, d, s: {"dataset_id": d, "question": r["body"], "choices": ["c"]}, 5)
    got = sorted((r["pos"], r["question"], r["choices"], r["example_metadata"]) for r in out.collect())
    assert got == [(1, "x", ["c"], '{"split":"train"}'), (2, "y", ["c"], '{"split":"test"}')]


def test_row_functions_are_tried_and_failing_rows_set_aside(rows):
    raw = rows("pos long, split string, body string, n long", (3, "train", "c", 1), (1, "train", None, None), (2, "test", "b", 5))
    seen_null = lambda r, d, s: {"dataset_id": d, "question": r["body"] or f"none {r['n']}", "split": s}
    good, bad = row_functions.ingest_checked(raw, seen_null, 4)
    assert sorted((r["pos"], r["question"], r["split"]) for r in good.collect()) == [(1, "none None", "train"), (2, "b", "test"), (3, "c", "train")]
    assert bad.count() == 0 and row_functions.trial(raw, seen_null, 4) == []

    def breaks(r, d, s):
        if r["pos"] == 1:
            return {"dataset_id": "x", "question": "q", "split": s}
        return {"dataset_id": d, "question": r["body"], "split": s, "choices": 7 if r["pos"] == 2 else ["a"]}

    good, bad = row_functions.ingest_checked(raw, breaks, 4)
    assert [r["pos"] for r in good.collect()] == [3]
    found = {r["pos"]: (r["errors"][0].split(":")[:2], r["source"]) for r in bad.collect()}
    assert found[1][0] == ["TypeError", " dataset_id"] and found[2][0] == ["TypeError", " choices"]
    assert '"body": "b"' in found[2][1]
    assert [e.split(":")[0] for e in row_functions.trial(raw, breaks, 4, rows=2)] == ["Row 1", "Row 2"]
    with pytest.raises(Exception, match="row [12]: TypeError"):
        catalog.ingest_custom(raw, breaks, 4).collect()
    empty = row_functions.ingest_checked(raw.limit(0), breaks, 4)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_counts_keep_empty_datasets(rows):
    datasets = rows("id long, name string", (1, "a"), (2, "b"))
    examples = rows("id long, dataset_id long", (1, 1), (2, 1))
    got = {r["name"]: r["example_count"] for r in catalog.dataset_counts(datasets, examples).collect()}
    assert got == {"a": 2, "b": 0}


def test_cascade(rows):
    examples = rows("id long, dataset string", (1, "x"), (2, "y"))
    links = rows("collection_id long, example_id long", (9, 1), (9, 2))
    events = rows("id long, example_id long, dataset_id long", (1, 1, 7), (2, 2, 8), (3, None, 7), (4, None, None))
    gone = rows("dataset string, dataset_id long", ("x", 7))
    kept, links, events = catalog.cascade_delete(examples, links, events, gone, "dataset")
    assert [r["id"] for r in kept.collect()] == [2] and [r["example_id"] for r in links.collect()] == [2]
    found = {r["id"]: (r["example_id"], r["dataset_id"]) for r in events.collect()}
    assert found == {1: (None, None), 2: (2, 8), 3: (None, None), 4: (None, None)}


def test_dimension_hint_follows_the_row_count(spark, monkeypatch):
    from evalspark.operators import joins

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    small = spark.range(3)
    assert not hinted(joins.dimension(small))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        assert hinted(joins.dimension(small))
        monkeypatch.setattr(joins, "MAX_DIMENSION_ROWS", 2)
        assert not hinted(joins.dimension(small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_by_key_read_their_row_groups(spark, tmp_path):
    """Deep pages over sorted files: the whole rows come from the few row groups that hold the page."""
    import glob

    import pyarrow.parquet as pq

    ids = F.col("id")
    # One dataset holds two thirds of all rows.
    table = spark.range(20_000).repartition(7).select(
        (ids * 3).alias("id"), F.when(ids % 3 == 0, ids % 5).otherwise(9).alias("dataset_id"), F.repeat(F.md5(ids.cast("string")), 20).alias("question"),
        F.when(ids % 2 == 0, "even").alias("subject"),
    )
    path = str(tmp_path / "examples")
    spark.conf.set("parquet.block.size", 256 << 10)
    try:
        catalog.write_examples(table, path)
    finally:
        spark.conf.unset("parquet.block.size")
    stored = spark.read.parquet(path)
    assert stored.count() == 20_000
    mine = sorted(r["id"] for r in table.where("dataset_id = 9").collect())
    after = mine[10_000]
    rows = catalog.list_examples_after(stored, after, dataset_id=9, limit=20)
    got = [r["id"] for r in rows.collect()]
    assert got == mine[10_001:10_021]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan and "LessThanOrEqual(id," in plan and "dataset_id" in plan.split("PartitionFilters")[1]
    bounds = []
    for file in glob.glob(path + "/dataset_id=9/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("id")
        bounds += [(g.min, g.max) for g in (meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups))]
    assert len(bounds) > 8 and sum(low <= got[-1] and high >= got[0] for low, high in bounds) <= 2

    pages, after = [], None
    while rows := catalog.list_examples_after(stored.where("id < 900"), after, subject="even", limit=37).collect():
        pages += [r["id"] for r in rows]
        after = pages[-1]
    assert pages == list(range(0, 900, 6))
