"""Export shapes of examples and the file sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.joins import dimension
from evalspark.operators.tables import written

KEEP_NULLS = {"ignoreNullFields": "false"}
CSV_COLUMNS = ["id", "dataset_id", "dataset_name", "question", "answer", "choices", "metadata"]
CONVERT_SAMPLE = 3
CONVERT_PIECE = 1000


def with_names(examples: DataFrame, datasets: DataFrame) -> DataFrame:
    """Adds the dataset name; an example of an unknown dataset keeps a NULL name."""
    names = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return examples.join(dimension(names), "dataset_id", "left")


def _filled_metadata() -> Column:
    """Metadata text, NULL when empty: such a member is left out, not written as null."""
    text = F.col("example_metadata")
    return F.when(~F.coalesce(text, F.lit("{}")).isin("{}", "null", ""), text)


def _filled_choices() -> Column:
    return F.when(F.size("choices") > 0, F.col("choices"))


def _spliced(base: Column, **optional: Column) -> Column:
    """Object text with raw JSON members added before the closing brace where they are not NULL."""
    extra = [
        F.when(value.isNotNull(), F.concat(F.lit(f',"{name}":'), value)) for name, value in optional.items()
    ]
    return F.concat(
        F.substring(base, F.lit(1), F.length(base) - 1),
        *[F.coalesce(e, F.lit("")) for e in extra],
        F.lit("}"),
    )


def _quoted(value: Column) -> Column:
    """A text as JSON string, NULL stays NULL."""
    boxed = F.to_json(F.array(value))
    return F.when(
        value.isNotNull() & (value != ""), F.substring(boxed, F.lit(2), F.length(boxed) - 2)
    )


def json_line() -> Column:
    """id, dataset_id, question, answer, choices always; dataset_name and metadata when filled."""
    base = F.to_json(F.struct("id", "dataset_id", "question", "answer", "choices"), KEEP_NULLS)
    return _spliced(base, dataset_name=_quoted(F.col("dataset_name")), metadata=_filled_metadata())


def trace_item() -> Column:
    """input / expected_output / metadata with the source ids added to the metadata."""
    question = F.struct(F.col("question").alias("question"), _filled_choices().alias("choices"))
    answered = F.when(
        F.coalesce(F.col("answer"), F.lit("")) != "", F.to_json(F.struct(F.col("answer")))
    )
    ids = F.to_json(F.struct(F.col("id").alias("source_id"), "dataset_id"))
    ids = _spliced(ids, dataset_name=_quoted(F.col("dataset_name")))
    given = _filled_metadata()
    merged = F.when(
        given.isNotNull(),
        F.concat(
            F.substring(given, F.lit(1), F.length(given) - 1),
            F.lit(","),
            F.substring(ids, F.lit(2), F.length(ids)),
        ),
    ).otherwise(ids)
    return F.concat(
        F.lit('{"input":'),
        F.to_json(question),
        F.lit(',"expected_output":'),
        F.coalesce(answered, F.lit("null")),
        F.lit(',"metadata":'),
        merged,
        F.lit("}"),
    )


def inspect_item() -> Column:
    """input, target, choices, id (text), then metadata when filled."""
    base = F.to_json(
        F.struct(
            F.col("question").alias("input"),
            F.col("answer").alias("target"),
            F.col("choices"),
            F.col("id").cast("string").alias("id"),
        ),
        KEEP_NULLS,
    )
    return _spliced(base, metadata=F.coalesce(_filled_metadata(), F.lit("null")))


def langsmith_item() -> Column:
    """inputs{}, outputs{}, metadata."""
    base = F.to_json(
        F.struct(
            F.struct(F.col("question"), F.col("choices")).alias("inputs"),
            F.struct(F.col("answer")).alias("outputs"),
        ),
        KEEP_NULLS,
    )
    return _spliced(base, metadata=F.coalesce(_filled_metadata(), F.lit("null")))


def gold_index() -> Column:
    """Position of the right answer: from its letter when that is in range, else from its text."""
    answer = F.col("answer")
    by_letter = F.ascii(answer) - 65
    by_text = F.array_position("choices", answer) - 1
    return (
        F.when(answer.rlike("^[A-Z]$") & (by_letter < F.size("choices")), by_letter)
        .when(by_text >= 0, by_text)
        .cast("int")
    )


def harness_item() -> Column:
    """doc_id, query, choices, gold."""
    return F.to_json(
        F.struct(
            F.col("id").alias("doc_id"),
            F.col("question").alias("query"),
            F.col("choices"),
            gold_index().alias("gold"),
        ),
        KEEP_NULLS,
    )


SHAPES: dict[str, Callable[[], Column]] = {
    "jsonl": json_line,
    "trace": trace_item,
    "inspect": inspect_item,
    "langsmith": langsmith_item,
    "harness": harness_item,
}


def item_lines(examples: DataFrame, datasets: DataFrame, shape: str) -> DataFrame:
    """One JSON line per example, with the id kept for ordering and joining."""
    return with_names(examples, datasets).select("id", SHAPES[shape]().alias("line"))


def csv_rows(examples: DataFrame, datasets: DataFrame) -> DataFrame:
    """The fixed seven columns; choices and metadata as JSON text when filled."""
    named = with_names(examples, datasets)
    return named.select(
        "id",
        "dataset_id",
        F.col("dataset_name"),
        "question",
        "answer",
        F.to_json(_filled_choices()).alias("choices"),
        _filled_metadata().alias("metadata"),
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """JSONL part files, one line per example."""
    lines.select("line").write.mode("overwrite").text(path)


def write_array(lines: DataFrame, path: str, order: tuple[str, ...] = ("id",)) -> None:
    """One JSON array over all part files: put together by their numbers, they are one valid array in ``order``.

    The lines are written once with a number each, which breaks ties in ``order`` and names the first and the last line; these
    two numbers are all that reaches the driver. A range sort deals the lines to the parts, so the array opens
    in the first part and closes in the last whatever parts are empty. An empty export is an empty array.
    """
    numbered = written(lines.select(*order, "line", F.monotonically_increasing_id().alias("_at")), "export-lines")
    place = F.struct(*order, "_at")
    ends = numbered.agg(F.min_by("_at", place).alias("first"), F.max_by("_at", place).alias("last")).first()
    if ends["first"] is None:
        framed = lines.sparkSession.range(1, numPartitions=1).select(F.lit("[]").alias("value"))
    else:
        opening = F.when(F.col("_at") == ends["first"], "[\n").otherwise("")
        closing = F.when(F.col("_at") == ends["last"], "\n]").otherwise(",")
        framed = numbered.orderBy(*order, "_at").select(F.concat(opening, F.lit("  "), "line", closing).alias("value"))
    framed.write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV part files with a header each, quotes doubled."""
    (
        rows.select(*CSV_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .csv(path)
    )


def convert(
    examples: DataFrame,
    function: Callable[[list[dict]], str],
    header: str | None = None,
    footer: str | None = None,
    piece: int = CONVERT_PIECE,
) -> DataFrame:
    """A caller's converter over the examples: one text per ``piece`` rows of a part, in the part's order.

    The last piece of a part may be shorter. Pieces don't depend on the size of Arrow batches. ``header`` and
    ``footer`` stand once at the ends of every part that has rows, so a format that has them needs no single
    part. The converter is tried on a few rows first and must return a non-empty text. Missing values are None.
    """
    sample = examples.limit(CONVERT_SAMPLE).toArrow().to_pylist()
    if sample:
        trial = function(sample)
        if not isinstance(trial, str) or not trial:
            raise ValueError("the converter must return a non-empty text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
        held, opened = [], False
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if not opened:
                    opened = True
                    yield header
                part = batch.slice(at, piece - len(held))
                held += part.to_pylist()
                at += part.num_rows
                if len(held) == piece:
                    yield function(held)
                    held = []
        if held:
            yield function(held)
        if opened:
            yield footer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in texts(batches):
            if text is not None:
                yield pa.RecordBatch.from_pydict({"value": pa.array([text], pa.string())})

    return examples.mapInArrow(run, "value string")
