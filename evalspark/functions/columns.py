"""Small column helpers shared by the ingest, search and curation jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letter(index: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(index.cast("int") + 65)


def lettered(choices: Column) -> Column:
    """['x', 'y'] -> ['A: x', 'B: y']; a missing text becomes empty, texts behind Z stay bare."""

    def one(text: Column, i: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.when(i < 26, F.concat(letter(i), F.lit(": "), text)).otherwise(text)

    return F.transform(choices, one)


def stable_id(*parts: Column) -> Column:
    """A repeatable 60-bit id from text parts, for small registries such as dataset names."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def metadata_text(df: DataFrame, name: str) -> Column:
    """A metadata member as text: the column kept at ingest when there is one, else the JSON."""
    if name in df.columns:
        return F.col(name)
    return F.get_json_object("example_metadata", f"$.{name}")


def instant(column: Column) -> Column:
    """Second-precision text of a point in time, the same in every session time zone."""
    return F.date_format(column.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def embedding_text(question: Column, choices: Column) -> Column:
    """Question, followed by the choices when there are any."""
    has_choices = F.coalesce(F.size(choices) > 0, F.lit(False))
    return F.when(
        has_choices, F.concat(question, F.lit(" "), F.array_join(choices, " "))
    ).otherwise(question)
