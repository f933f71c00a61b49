"""Callers' row functions: a trial before an ingest, and an ingest that sets failing rows aside with the reason."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.tables import written

REQUIRED = ("dataset_id", "question", "split")
TRIAL_ROWS = 5
PARSED = {
    "pos": pa.int64(),
    "dataset_id": pa.int64(),
    "question": pa.string(),
    "answer": pa.string(),
    "choices": pa.list_(pa.string()),
    "example_metadata": pa.string(),
    "split": pa.string(),
}
SCHEMA = (
    "pos long, dataset_id long, question string, answer string, choices array<string>, "
    "example_metadata string, split string, errors array<string>, source string"
)

RowFunction = Callable[[dict, int, str], dict]


def problems(parsed: object, lenient: bool = False) -> list[str]:
    """What is wrong with one result of a row function. Lenient: the split may be missing, the question empty."""
    if not isinstance(parsed, dict):
        return [f"parse_row returned {type(parsed).__name__}, expected dict"]
    found = []
    missing = [name for name in REQUIRED if name not in parsed and not (lenient and name == "split")]
    if missing:
        found.append(f"missing keys {', '.join(missing)}")
    if not lenient and not parsed.get("question"):
        found.append("question is empty or None")
    return found


def stored_form(row: dict, parsed: dict) -> dict:
    """The columns of an example, each of its own type; a value of another type raises."""
    split = parsed.get("split", row.get("split"))
    metadata = {**(parsed.get("example_metadata") or {}), "split": split}
    values = {**parsed, "pos": row["pos"], "split": split}
    values["example_metadata"] = json.dumps(metadata, ensure_ascii=False, separators=(",", ":"))
    for name, kind in PARSED.items():
        try:
            pa.array([values.get(name)], kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError) as error:
            raise TypeError(f"{name}: {error}") from error
    return {name: values.get(name) for name in PARSED}


def parse_one(row: dict, parse_row: RowFunction, dataset_id: int, lenient: bool = False) -> tuple[dict, list[str]]:
    """The example of a row, or its position alone and the reasons why there is none."""
    alone = dict.fromkeys(PARSED) | {"pos": row["pos"]}
    try:
        parsed = parse_row(dict(row), dataset_id, row.get("split"))
        found = problems(parsed, lenient)
        return (alone, found) if found else (stored_form(row, parsed), [])
    except Exception as error:  # a caller's code may raise anything; the reason is kept with the row
        return alone, [f"{type(error).__name__}: {error}"]


def tried(raw: DataFrame, parse_row: RowFunction, dataset_id: int, lenient: bool = False) -> DataFrame:
    """Every row of ``raw`` (with ``pos`` and ``split``) parsed on the executors: the example's columns, ``errors`` and, for
    failing rows, ``source``, the row itself as JSON. Nulls reach the function as None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            results = [parse_one(row, parse_row, dataset_id, lenient) for row in rows]
            columns = [pa.array([values[name] for values, _ in results], kind) for name, kind in PARSED.items()]
            columns.append(pa.array([errors for _, errors in results], pa.list_(pa.string())))
            sources = [json.dumps(row, ensure_ascii=False, default=str) if errors else None for row, (_, errors) in zip(rows, results)]
            columns.append(pa.array(sources, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*PARSED, "errors", "source"])

    return raw.mapInArrow(run, SCHEMA)


def trial(raw: DataFrame, parse_row: RowFunction, dataset_id: int, rows: int = TRIAL_ROWS) -> list[str]:
    """Errors of the first rows by position, before anything is ingested. Empty: the function works on them."""
    sample = tried(raw.orderBy("pos").limit(rows), parse_row, dataset_id).select("pos", "errors").collect()
    return [f"Row {row['pos']}: {error}" for row in sorted(sample, key=lambda r: r["pos"]) for error in row["errors"]]


def ingest_checked(raw: DataFrame, parse_row: RowFunction, dataset_id: int) -> tuple[DataFrame, DataFrame]:
    """The examples, and the quarantine: (pos, errors, source) of the rows that gave none.

    The function runs once over each row: its results are written before the two tables are cut from them. No
    row is lost, and none ends the job.
    """
    results = written(tried(raw, parse_row, dataset_id), "parsed-rows")
    good = results.where(F.size("errors") == 0).drop("errors", "source")
    return good, results.where(F.size("errors") > 0).select("pos", "errors", "source")
