"""Raw rows in, exact example fields out."""

import json

from pyspark.sql import functions as F

from evalspark.sources.adapters import REGISTRY, ingest_all


def one(spark, name, schema, row, split):
    raw = spark.createDataFrame([row], schema).withColumn("split", F.lit(split))
    out = REGISTRY[name].normalise(raw.withColumn("pos", F.lit(0)), dataset_id=7).collect()
    if not out:
        return None
    first = out[0].asDict()
    first["meta"] = json.loads(first["example_metadata"])
    return first


MMLU = "question string, choices array<string>, answer int, subject string"


def test_mmlu(spark):
    got = one(spark, "mmlu", MMLU, ("Q?", ["w", "x", "y", "z"], 2, "anatomy"), "test")
    assert (got["question"], got["answer"], got["dataset_id"]) == ("Q?", "C", 7)
    assert got["choices"] == ["A: w", "B: x", "C: y", "D: z"]
    assert got["meta"] == {
        "subject": "anatomy", "split": "test", "answer_index": 2, "num_choices": 4,
    }
    assert one(spark, "mmlu", MMLU, ("Q", ["a", "b"], 4, "s"), "dev")["answer"] is None
    assert one(spark, "mmlu", MMLU, ("Q", ["a", "b"], -1, "s"), "dev")["answer"] is None
    assert one(spark, "mmlu", MMLU, ("Q", ["a"], 0, "s"), "train") is None


def test_missing_columns_get_defaults(spark):
    got = one(spark, "mmlu", "question string", ("only",), "test")
    assert got["subject"] == "unknown" and got["choices"] == [] and got["answer"] is None
    got = one(spark, "humaneval", "prompt string", ("def f():",), "test")
    assert got["answer"] is None and got["meta"]["has_test"] is True and got["meta"]["task_id"] == ""


def test_gsm8k(spark):
    def final(text):
        return one(spark, "gsm8k", "question string, answer string", ("q", text), "train")["meta"][
            "final_answer"
        ]

    assert final("steps\n#### 1,234") == "1234"
    assert final("#### -7.5") == "-7.5"
    assert final("no marker") is None
    assert final("####42 then #### 43") == "42"


def test_hellaswag(spark):
    schema = "ctx string, endings array<string>, label string, activity_label string"

    def got(label):
        return one(spark, "hellaswag", schema, ("c", ["p", "q", "r", "s"], label, "act"), "train")

    assert (got("2")["answer"], got("2")["meta"]["answer_index"]) == ("C", 2)
    assert (got("x")["answer"], got("x")["meta"]["answer_index"]) == ("A", 0)
    assert (got("-1")["answer"], got("-1")["meta"]["answer_index"]) == ("A", -1)
    assert (got("7")["answer"], got("7")["meta"]["answer_index"]) == ("A", 7)
    long = one(spark, "hellaswag", schema, ("c", [f"e{i}" for i in range(28)], "2", "act"), "train")["choices"]
    assert long[25:] == ["Z: e25", "e26", "e27"]


def test_truthfulqa(spark):
    schema = "question string, mc1_targets struct<choices: array<string>, labels: array<int>>"
    got = one(spark, "truthfulqa", schema, ("q", (["a", "b", "c"], [0, 1, 1])), "validation")
    assert got["answer"] == "B" and got["choices"] == ["A: a", "B: b", "C: c"]
    none = one(spark, "truthfulqa", schema, ("q", (["a"], [0])), "validation")
    assert none["answer"] is None
    many = [str(i) for i in range(30)]
    late = one(
        spark, "truthfulqa", schema, ("q", (many, [int(i == 28) for i in range(30)])), "validation"
    )
    assert late["answer"] is None and len(late["choices"]) == 26


def test_arc_zips_to_the_shorter_list(spark):
    schema = (
        "id string, question string, choices struct<text: array<string>, label: array<string>>, "
        "answerKey string"
    )
    got = one(spark, "arc", schema, ("q1", "why", (["t", "u", "v"], ["A", "B"]), "B"), "test")
    assert got["choices"] == ["A: t", "B: u"] and got["answer"] == "B"
    assert got["meta"] == {"question_id": "q1", "split": "test", "difficulty": "challenge"}


def test_two_option_sources(spark):
    schema = "sentence string, option1 string, option2 string, answer string"
    for given, want in (("1", "A"), ("2", "B"), ("", None)):
        got = one(spark, "winogrande", schema, ("s _", "x", "y", given), "train")
        assert got["answer"] == want and got["choices"] == ["A: x", "B: y"]
    schema = "goal string, sol1 string, sol2 string, label int"
    for given, want in ((0, "A"), (1, "B"), (-1, None), (None, None)):
        assert one(spark, "piqa", schema, ("g", "x", "y", given), "train")["answer"] == want


def test_mbpp_and_boolq(spark):
    schema = "task_id int, text string, code string, test_list array<string>, challenge_test_list array<string>"
    got = one(spark, "mbpp", schema, (5, "t", "", ["a", "b"], []), "test")
    assert got["answer"] is None
    assert got["meta"] == {
        "task_id": 5, "num_tests": 2, "has_challenge_tests": False, "split": "test",
    }
    got = one(spark, "mbpp", schema, (5, "t", "x=1", None, ["c"]), "test")
    assert (got["answer"], got["meta"]["num_tests"]) == ("x=1", 0)
    assert got["meta"]["has_challenge_tests"] is True
    schema = "question string, answer boolean, passage string"
    for given, want in ((True, "Yes"), (False, "No"), (None, None)):
        got = one(spark, "boolq", schema, ("q", given, "p" * 700), "train")
        assert got["answer"] == want and len(got["meta"]["passage"]) == 500
        assert got["choices"] == ["A: Yes", "B: No"]


def test_ids_never_collide_across_sources_and_splits(spark):
    raw = spark.range(50).selectExpr(
        "id AS pos", "element_at(array('train', 'validation', 'test'), int(id % 3) + 1) AS split"
    )
    rows = ingest_all({name: raw for name in REGISTRY})
    assert rows.count() == rows.select("id").distinct().count() > 0
