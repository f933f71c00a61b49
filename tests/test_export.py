"""Sinks: files written, read back, compared by value."""

import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import exporting

SCHEMA = "id long, dataset_id long, question string, answer string, choices array<string>, example_metadata string"


@pytest.fixture(scope="module")
def export(spark):
    data = [
        (1, 10, 'quote " and, comma', "A", ["A: x", "B: y"], '{"subject":"art","split":"test"}'),
        (2, 20, "two\nlines — é", None, None, None),
        (3, 30, "plain", "x", [], "{}"),
    ]
    datasets = spark.createDataFrame([(10, "Ten"), (20, "Twenty")], "id long, name string")
    return spark.createDataFrame(data, SCHEMA), datasets


def lines(export, shape):
    rows = exporting.item_lines(*export, shape).orderBy("id").collect()
    return [json.loads(r["line"]) for r in rows]


WANT = [
    {
        "id": 1, "dataset_id": 10, "question": 'quote " and, comma', "answer": "A",
        "choices": ["A: x", "B: y"], "dataset_name": "Ten", "metadata": {"subject": "art", "split": "test"},
    },
    {"id": 2, "dataset_id": 20, "question": "two\nlines — é", "answer": None, "choices": None, "dataset_name": "Twenty"},
    {"id": 3, "dataset_id": 30, "question": "plain", "answer": "x", "choices": []},
]


def test_jsonl(export, tmp_path):
    assert lines(export, "jsonl") == WANT
    path = str(tmp_path / "out")
    exporting.write_lines(exporting.item_lines(*export, "jsonl"), path)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(path + "/part-*"))
    assert text.endswith("\n") and "é" in text
    assert sorted((json.loads(x) for x in text.splitlines()), key=lambda d: d["id"]) == WANT


def joined_parts(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(path + "/part-*")))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_json_array(export, tmp_path, parts):
    path = str(tmp_path / "out")
    exporting.write_array(exporting.item_lines(*export, "jsonl").repartition(parts), path)
    text = joined_parts(path)
    assert json.loads(text) == WANT and "é" in text
    assert text.startswith('[\n  {"id":1') and text.endswith("}\n]\n")


def test_json_array_of_many_parts(spark, tmp_path):
    """Parts put together are one array in the wanted order, with empty parts, one id that holds a third, and null ids."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 100 != 1, F.pmod(F.col("id") * 37, F.lit(500)))
    items = spark.range(3000).select(key.alias("id"), F.to_json(F.struct(F.col("id").alias("n"))).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exporting.write_array(items.where("id is null or id < 400").repartition(11), str(tmp_path / "many"))
        exporting.write_array(items.limit(1), str(tmp_path / "one"))
        exporting.write_array(items.where("id < 0"), str(tmp_path / "none"))
        exporting.write_array(items.coalesce(1), str(tmp_path / "own"), order=())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    keys = {r["line"]: r["id"] for r in items.collect()}
    got = json.loads(joined_parts(str(tmp_path / "many")))
    ids = [keys[json.dumps(item, separators=(",", ":"))] for item in got]
    assert len(glob.glob(str(tmp_path / "many") + "/part-*")) > 1
    assert ids == sorted((i for i in keys.values() if i is None or i < 400), key=lambda i: -1 if i is None else i)
    assert len({item["n"] for item in got}) == len(got)
    assert json.loads(joined_parts(str(tmp_path / "one"))) == [{"n": 0}]
    assert json.loads(joined_parts(str(tmp_path / "none"))) == []
    assert [item["n"] for item in json.loads(joined_parts(str(tmp_path / "own")))] == list(range(3000))


def test_csv(export, tmp_path):
    path = str(tmp_path / "out")
    exporting.write_csv(exporting.csv_rows(*export).coalesce(1), path)
    text = open(glob.glob(path + "/part-*")[0], encoding="utf-8", newline="").read()
    rows = sorted(csv.DictReader(io.StringIO(text)), key=lambda r: r["id"])
    assert list(rows[0]) == exporting.CSV_COLUMNS
    assert rows[0]["question"] == 'quote " and, comma' and json.loads(rows[0]["choices"]) == ["A: x", "B: y"]
    assert rows[1]["question"] == "two\nlines — é" and rows[1]["answer"] == ""
    assert rows[2]["choices"] == "" and rows[2]["metadata"] == "" and rows[2]["dataset_name"] == ""


def test_empty_exports(export, tmp_path):
    none = (export[0].where("id < 0"), export[1])
    exporting.write_lines(exporting.item_lines(*none, "jsonl"), str(tmp_path / "a"))
    assert "".join(open(f).read() for f in glob.glob(str(tmp_path / "a") + "/part-*")) == ""
    exporting.write_csv(exporting.csv_rows(*none).coalesce(1), str(tmp_path / "b"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "b") + "/part-*"))
    assert text.strip() == ",".join(exporting.CSV_COLUMNS)


def test_framework_shapes(export):
    trace = lines(export, "trace")
    assert trace[0] == {
        "input": {"question": 'quote " and, comma', "choices": ["A: x", "B: y"]},
        "expected_output": {"answer": "A"},
        "metadata": {"subject": "art", "split": "test", "source_id": 1, "dataset_id": 10, "dataset_name": "Ten"},
    }
    assert trace[1]["expected_output"] is None and trace[2]["metadata"] == {"source_id": 3, "dataset_id": 30}
    inspect = lines(export, "inspect")
    assert inspect[0]["id"] == "1" and inspect[0]["target"] == "A" and inspect[2]["metadata"] is None
    langsmith = lines(export, "langsmith")
    assert langsmith[0]["inputs"]["choices"] == ["A: x", "B: y"] and langsmith[1]["outputs"] == {"answer": None}
    harness = lines(export, "harness")
    assert [h["gold"] for h in harness] == [0, None, None]


def test_gold_index(rows):
    data = [("B", ["A: x", "B: y"]), ("E", ["A: x"]), ("x", ["w", "x"]), ("no", ["w"]), (None, ["w"])]
    out = rows("answer string, choices array<string>", *data).select(exporting.gold_index().alias("g"))
    assert [r["g"] for r in out.collect()] == [1, None, 1, None, None]


def test_custom_converter(rows, export):
    out = exporting.convert(export[0].select("id"), lambda items: "|".join(str(i["id"]) for i in items))
    ids = sorted(int(x) for r in out.collect() for x in r["value"].split("|"))
    assert ids == [1, 2, 3]
    with pytest.raises(ValueError):
        exporting.convert(export[0].select("id"), lambda items: "")
    assert exporting.convert(export[0].where(F.lit(False)), lambda items: "").count() == 0


def test_converter_pieces_and_ends(spark):
    many = spark.range(25_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even")).coalesce(1)
    seen = lambda items: "\n".join(f"{i['id']},{i['even']}" for i in items)
    want = ["id,even", *(f"{i},{i if i % 2 == 0 else None}" for i in range(25_000)), "end"]
    for batch in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            out = [r["value"] for r in exporting.convert(many, seen, "id,even", "end", piece=4_000).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(out) == 9 and "\n".join(out).split("\n") == want
