"""Answers of language models: fences, defaults, broken JSON."""

from pyspark.sql import functions as F

from evalspark.functions import model_json as mj


def parse(spark, function, *values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = frame.select("i", function(F.col("t"), F.lit("asked")).alias("o")).orderBy("i").collect()
    return [r["o"].asDict() if hasattr(r["o"], "asDict") else r["o"] for r in out]


GOOD = '{"search_query": "q", "dataset": "D", "subject": null, "task_type": "t", "explanation": "e"}'


def test_search_params(spark):
    plain, fenced, no_line, broken, missing, extra, listed, empty, nothing = parse(
        spark, mj.search_params,
        GOOD, f"```json\n{GOOD}\n```\nbye", f"```{GOOD}```", '{"search_query": ', '{"dataset": "D"}',
        GOOD + " and more", "[1]", '{"search_query": ""}', None,
    )
    assert plain == {
        "search_query": "q", "dataset": "D", "subject": None, "task_type": "t", "explanation": "e",
    }
    assert fenced == plain and no_line == plain
    for failed in (broken, missing, extra, listed, nothing):
        assert failed["search_query"] == "asked" and failed["explanation"] == mj.PARSE_FALLBACK
        assert failed["dataset"] is None
    assert empty["search_query"] == "asked" and empty["explanation"] == ""


def test_ranked_ids(spark):
    def ids(*values):
        return [r["ranked_ids"] for r in parse(spark, lambda t, _: mj.ranked_ids(t), *values)]

    assert ids(
        '{"ranked_ids": [3, "4", 1.7, 3]}', '{"ranked_ids": [1, "x"]}', '{"ranked_ids": []}',
        '{"other": 1}', "none", '{"ranked_ids": [1, null]}', '{"ranked_ids": 5}',
    ) == [[3, 4, 1, 3], [], [], [], [], [], []]


def test_plan_and_label(spark):
    plan, fallback = parse(spark, mj.search_plan, '{"tool": "keyword_search"}', "x")
    assert plan == {
        "tool": "keyword_search", "search_query": "asked", "dataset": None, "subject": None, "rationale": "",
    }
    assert fallback["tool"] == "hybrid_search" and fallback["rationale"] == mj.PLAN_FALLBACK
    labels = parse(
        spark, lambda t, _: mj.evaluation_label(t, F.lit(2)),
        '{"relevance_score": 8, "assessment": "good"}', None, '{"relevance_score": 3}',
    )
    assert labels == [
        "score=8/10 — good", "score=5/10 — LLM evaluation unavailable.", "score=3/10 — ",
    ]
    assert parse(spark, lambda t, _: mj.evaluation_label(t, F.lit(0)), None) == [
        "score=0/10 — LLM evaluation unavailable."
    ]
