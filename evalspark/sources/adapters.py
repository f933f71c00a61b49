"""Benchmark adapters: how a raw row of each known source becomes an example.

An adapter is metadata plus one projection of built-in column functions. A column the source lacks
is replaced by its default before the projection, a NULL stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import letter, lettered

# An example id packs dataset, split and source position: 19 + 4 + 40 bits. It never collides and
# needs neither a shuffle nor a counter.
SPLIT_BITS = 4
POSITION_BITS = 40
PASSAGE_CHARS = 500
MAX_LETTERS = 26
# Fixed value: the number after the answer marker of a worked solution.
FINAL_ANSWER = r"(?U)####\s*([\d,\.\-]+)"

EXAMPLE_COLUMNS = [
    "id",
    "dataset_id",
    "question",
    "answer",
    "choices",
    "example_metadata",
    "subject",
    "split",
]


@dataclass(frozen=True)
class Adapter:
    """Describes one source. ``fields`` maps each expected raw column to its default SQL literal."""

    number: int
    name: str
    source: str
    task_type: str
    splits: tuple[str, ...]
    fields: dict[str, str]
    to_example: Callable[[], dict[str, Column]]
    license: str = "MIT"
    description: str = ""
    config: str | None = None
    revision: str | None = None
    stats_by: str | None = None

    def normalise(self, raw: DataFrame, dataset_id: int | None = None) -> DataFrame:
        """Rows of the declared splits as examples. ``raw`` carries ``split`` and ``pos``."""
        dataset_id = self.number if dataset_id is None else dataset_id
        for field, default in self.fields.items():
            if field not in raw.columns:
                raw = raw.withColumn(field, F.expr(default))
        parts = self.to_example()
        metadata = parts["metadata"]
        split_no = F.array_position(F.array(*map(F.lit, self.splits)), F.col("split")) - 1
        packed = (
            F.shiftleft(F.lit(dataset_id).cast("long"), SPLIT_BITS + POSITION_BITS)
            + F.shiftleft(split_no.cast("long"), POSITION_BITS)
            + F.col("pos")
        )
        return raw.where(F.col("split").isin(*self.splits)).select(
            packed.alias("id"),
            F.lit(dataset_id).cast("long").alias("dataset_id"),
            parts["question"].alias("question"),
            parts["answer"].cast("string").alias("answer"),
            parts["choices"].cast("array<string>").alias("choices"),
            F.to_json(metadata, {"ignoreNullFields": "false"}).alias("example_metadata"),
            parts.get("subject", F.lit(None)).cast("string").alias("subject"),
            F.col("split"),
        )


def _meta(**members: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in members.items()])


def _in_range(index: Column, size: Column | int) -> Column:
    return (index >= 0) & (index < size)


def _mmlu() -> dict[str, Column]:
    count = F.size("choices")
    index = F.col("answer")
    return {
        "question": F.col("question"),
        "answer": F.when(_in_range(index, count), letter(index)),
        "choices": lettered(F.col("choices")),
        "subject": F.col("subject"),
        "metadata": _meta(
            subject=F.col("subject"), split=F.col("split"), answer_index=index, num_choices=count
        ),
    }


def _humaneval() -> dict[str, Column]:
    return {
        "question": F.col("prompt"),
        "answer": F.col("canonical_solution"),
        "choices": F.lit(None),
        "metadata": _meta(
            task_id=F.col("task_id"),
            entry_point=F.col("entry_point"),
            has_test=F.lit(True),
            split=F.col("split"),
        ),
    }


def final_answer(text: Column) -> Column:
    """The number behind the answer marker without thousands commas; NULL without a marker."""
    found = F.nullif(F.regexp_extract(text, FINAL_ANSWER, 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(""))


def _gsm8k() -> dict[str, Column]:
    return {
        "question": F.col("question"),
        "answer": F.col("answer"),
        "choices": F.lit(None),
        "metadata": _meta(split=F.col("split"), final_answer=final_answer(F.col("answer"))),
    }


def _hellaswag() -> dict[str, Column]:
    index = F.coalesce(F.col("label").cast("string").try_cast("int"), F.lit(0))
    return {
        "question": F.col("ctx"),
        "answer": F.when(_in_range(index, 4), letter(index)).otherwise(F.lit("A")),
        "choices": lettered(F.col("endings")),
        "metadata": _meta(
            activity_label=F.col("activity_label"), split=F.col("split"), answer_index=index
        ),
    }


def _truthfulqa() -> dict[str, Column]:
    # First correct label; positions are 1-based and 0 stands for "none".
    first = F.array_position("mc1_targets.labels", 1)
    return {
        "question": F.col("question"),
        "answer": F.when(first.between(1, MAX_LETTERS), letter(first - 1)),
        "choices": lettered(F.slice("mc1_targets.choices", 1, MAX_LETTERS)),
        "metadata": _meta(split=F.col("split")),
    }


def _arc() -> dict[str, Column]:
    shared = F.least(F.size("choices.text"), F.size("choices.label"))
    labelled = F.zip_with(
        F.slice("choices.label", F.lit(1), shared),
        F.slice("choices.text", F.lit(1), shared),
        lambda label, text: F.concat(
            F.coalesce(label, F.lit("")), F.lit(": "), F.coalesce(text, F.lit(""))
        ),
    )
    return {
        "question": F.col("question"),
        "answer": F.col("answerKey"),
        "choices": labelled,
        "metadata": _meta(
            question_id=F.col("id"), split=F.col("split"), difficulty=F.lit("challenge")
        ),
    }


def _two_options(question: str, first: str, second: str, answer: Column) -> dict[str, Column]:
    return {
        "question": F.col(question),
        "answer": answer,
        "choices": lettered(F.array(F.col(first), F.col(second))),
        "metadata": _meta(split=F.col("split")),
    }


def _winogrande() -> dict[str, Column]:
    given = F.col("answer").cast("string")
    answer = F.when(given == "1", F.lit("A")).when(given == "2", F.lit("B"))
    return _two_options("sentence", "option1", "option2", answer)


def _piqa() -> dict[str, Column]:
    answer = F.when(F.col("label") == 0, F.lit("A")).when(F.col("label") == 1, F.lit("B"))
    return _two_options("goal", "sol1", "sol2", answer)


def _mbpp() -> dict[str, Column]:
    def length(name: str) -> Column:
        return F.coalesce(F.size(F.col(name)), F.lit(0))

    return {
        "question": F.col("text"),
        "answer": F.nullif(F.col("code"), F.lit("")),
        "choices": F.lit(None),
        "metadata": _meta(
            task_id=F.col("task_id"),
            num_tests=F.when(F.col("test_list").isNull(), 0).otherwise(length("test_list")),
            has_challenge_tests=F.col("challenge_test_list").isNotNull()
            & (length("challenge_test_list") > 0),
            split=F.col("split"),
        ),
    }


def _boolq() -> dict[str, Column]:
    return {
        "question": F.col("question"),
        "answer": F.when(F.col("answer"), F.lit("Yes")).when(~F.col("answer"), F.lit("No")),
        "choices": F.array(F.lit("A: Yes"), F.lit("B: No")),
        "metadata": _meta(
            passage=F.substring("passage", 1, PASSAGE_CHARS), split=F.col("split")
        ),
    }


NO_TEXT = "''"
NO_TEXTS = "cast(array() as array<string>)"
NO_VALUE = "cast(null as string)"

_ADAPTERS = (
    Adapter(
        1, "MMLU", "HuggingFace:cais/mmlu", "multiple_choice", ("test", "validation", "dev"),
        {"question": NO_TEXT, "choices": NO_TEXTS, "answer": "0", "subject": "'unknown'"},
        _mmlu, config="all", stats_by="subject",
        description="Questions with four choices over many school and college subjects",
    ),
    Adapter(
        2, "HumanEval", "HuggingFace:openai/openai_humaneval", "code_generation", ("test",),
        {"task_id": NO_TEXT, "prompt": NO_TEXT, "canonical_solution": NO_VALUE, "entry_point": NO_TEXT},
        _humaneval, description="Hand-written programming problems with unit tests",
    ),
    Adapter(
        3, "GSM8K", "HuggingFace:openai/gsm8k", "math_reasoning", ("train", "test"),
        {"question": NO_TEXT, "answer": NO_TEXT},
        _gsm8k, config="main", description="Grade-school math with worked solutions",
    ),
    Adapter(
        4, "HellaSwag", "HuggingFace:Rowan/hellaswag", "commonsense_reasoning", ("train", "validation"),
        {"ctx": NO_TEXT, "endings": NO_TEXTS, "label": "'0'", "activity_label": NO_TEXT},
        _hellaswag, description="Choosing the ending of a sentence",
    ),
    Adapter(
        5, "TruthfulQA", "HuggingFace:truthfulqa/truthful_qa", "truthfulness", ("validation",),
        {
            "question": NO_TEXT,
            "mc1_targets": "named_struct('choices', cast(array() as array<string>), "
            "'labels', cast(array() as array<int>))",
        },
        _truthfulqa, license="Apache-2.0", config="multiple_choice",
        description="Questions that tempt a model into false beliefs",
    ),
    Adapter(
        6, "ARC", "HuggingFace:allenai/ai2_arc", "science_qa", ("train", "validation", "test"),
        {
            "id": NO_TEXT,
            "question": NO_TEXT,
            "choices": "named_struct('text', cast(array() as array<string>), "
            "'label', cast(array() as array<string>))",
            "answerKey": NO_VALUE,
        },
        _arc, license="CC-BY-SA-4.0", config="ARC-Challenge",
        description="Harder grade-school science questions",
    ),
    Adapter(
        7, "WinoGrande", "HuggingFace:allenai/winogrande", "commonsense_reasoning", ("train", "validation"),
        {"sentence": NO_TEXT, "option1": NO_TEXT, "option2": NO_TEXT, "answer": NO_TEXT},
        _winogrande, license="Apache-2.0", config="winogrande_xl",
        description="Resolving a blank to one of two candidates",
    ),
    Adapter(
        8, "PIQA", "HuggingFace:ybisk/piqa", "physical_intuition", ("train", "validation"),
        {"goal": NO_TEXT, "sol1": NO_TEXT, "sol2": NO_TEXT, "label": "cast(null as int)"},
        _piqa, license="AFL-3.0", revision="refs/convert/parquet",
        description="Everyday physical tasks with two candidate solutions",
    ),
    Adapter(
        9, "MBPP", "HuggingFace:google-research-datasets/mbpp", "code_generation",
        ("train", "validation", "test"),
        {
            "task_id": NO_TEXT, "text": NO_TEXT, "code": NO_VALUE,
            "test_list": NO_TEXTS, "challenge_test_list": NO_TEXTS,
        },
        _mbpp, license="CC-BY-4.0", config="full", description="Short Python problems with tests",
    ),
    Adapter(
        10, "BoolQ", "HuggingFace:google/boolq", "reading_comprehension", ("train", "validation"),
        {"question": NO_TEXT, "answer": "cast(null as boolean)", "passage": NO_TEXT},
        _boolq, license="CC-BY-SA-3.0", description="Yes/no questions about a passage",
    ),
)

REGISTRY: dict[str, Adapter] = {a.name.lower(): a for a in _ADAPTERS}


def ingest_all(raws: dict[str, DataFrame]) -> DataFrame:
    """Examples of every source given, by adapter name; one narrow plan without a shuffle."""
    parts = [REGISTRY[name].normalise(raw) for name, raw in raws.items()]
    return reduce(DataFrame.unionByName, parts)
