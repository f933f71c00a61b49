"""Reading JSON that a language model returned: fences, required keys, defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.columns import let

# What a failed parse falls back to.
PARSE_FALLBACK = "Fallback: LLM call failed or returned invalid response."
PLAN_FALLBACK = "Fallback: LLM call failed."
NO_EVALUATION = "LLM evaluation unavailable."
DEFAULT_TOOL = "hybrid_search"
DEFAULT_RELEVANCE = 5
FENCE = "```"
# Fixed value: every character that counts as white space around an answer.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_fences(text: Column) -> Column:
    """Drop an opening code fence with its line and everything from the last closing fence on."""

    def inside(text: Column) -> Column:
        newline = F.instr(text, "\n")
        opened = F.when(newline > 0, F.substr(text, newline + 1)).otherwise(
            F.substr(text, F.lit(4))
        )
        return let(
            opened,
            lambda rest: F.when(
                F.contains(rest, F.lit(FENCE)), F.regexp_extract(rest, r"(?s)^(.*)```", 1)
            ).otherwise(rest),
        )

    return let(
        _trim(text),
        lambda body: F.when(F.startswith(body, F.lit(FENCE)), _trim(inside(body))).otherwise(body),
    )


def json_object(text: Column) -> Column:
    """The parsed object as a variant; NULL for invalid text, other JSON kinds and extra data."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    is_object = F.startswith(text, F.lit("{"))
    return F.when(is_object & alone, F.try_variant_get(boxed, "$[0]", "variant"))


def _read(response: Column, build: Callable[[Column, Callable[[str], Column]], Column]) -> Column:
    """``build(parsed, has)`` over the answer, which is unwrapped and parsed once."""

    def parts(body: Column) -> Column:
        return F.struct(
            json_object(body).alias("parsed"), F.json_object_keys(body).alias("names")
        )

    def run(read: Column) -> Column:
        def has(name: str) -> Column:
            return F.coalesce(F.array_contains(read["names"], name), F.lit(False))

        return build(read["parsed"], has)

    return let(strip_fences(response), lambda body: let(parts(body), run))


def _text(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "string")


def _filled(value: Column, default: Column) -> Column:
    """Empty and NULL both count as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def _or_empty(parsed: Column, has: Callable[[str], Column], name: str) -> Column:
    """An absent member is empty text, a null one stays NULL."""
    return F.when(has(name), _text(parsed, name)).otherwise(F.lit(""))


def search_params(response: Column, original: Column) -> Column:
    """struct<search_query, dataset, subject, task_type, explanation>."""

    def build(parsed: Column, has: Callable[[str], Column]) -> Column:
        ok = parsed.isNotNull() & has("search_query")
        query = F.when(ok, _filled(_text(parsed, "search_query"), original)).otherwise(original)
        note = F.when(ok, _or_empty(parsed, has, "explanation")).otherwise(F.lit(PARSE_FALLBACK))
        return F.struct(
            query.alias("search_query"),
            *[F.when(ok, _text(parsed, n)).alias(n) for n in ("dataset", "subject", "task_type")],
            note.alias("explanation"),
        )

    return _read(response, build)


def ranked_ids(response: Column) -> Column:
    """struct<ranked_ids array<bigint>, explanation>; one non-integer entry empties the list."""

    def number(item: Column) -> Column:
        text = F.trim(F.try_variant_get(item, "$", "string")).try_cast("bigint")
        return F.when(F.schema_of_variant(item) == "STRING", text).otherwise(
            F.try_variant_get(item, "$", "bigint")
        )

    def build(parsed: Column, has: Callable[[str], Column]) -> Column:
        raw = F.try_variant_get(parsed, "$.ranked_ids", "array<variant>")
        ids = F.transform(raw, number)
        whole = ~F.coalesce(F.exists(ids, lambda value: value.isNull()), F.lit(False))
        ok = parsed.isNotNull() & raw.isNotNull() & whole
        return F.struct(
            F.when(ok, ids).otherwise(F.array().cast("array<bigint>")).alias("ranked_ids"),
            F.when(ok, _or_empty(parsed, has, "explanation"))
            .otherwise(F.lit(""))
            .alias("explanation"),
        )

    return _read(response, build)


def search_plan(response: Column, original: Column) -> Column:
    """struct<tool, search_query, dataset, subject, rationale>."""

    def build(parsed: Column, has: Callable[[str], Column]) -> Column:
        ok = parsed.isNotNull() & has("tool")
        query = F.when(ok, _filled(_text(parsed, "search_query"), original)).otherwise(original)
        note = F.when(ok, _or_empty(parsed, has, "rationale")).otherwise(F.lit(PLAN_FALLBACK))
        return F.struct(
            F.when(ok, _text(parsed, "tool")).otherwise(F.lit(DEFAULT_TOOL)).alias("tool"),
            query.alias("search_query"),
            *[F.when(ok, _text(parsed, n)).alias(n) for n in ("dataset", "subject")],
            note.alias("rationale"),
        )

    return _read(response, build)


def evaluation_label(response: Column, result_count: Column) -> Column:
    """``score=n/10 — text`` of one search pass; without an answer, 5 with results and 0 without."""

    def build(parsed: Column, has: Callable[[str], Column]) -> Column:
        ok = parsed.isNotNull() & has("relevance_score")
        fallback = F.when(result_count > 0, F.lit(str(DEFAULT_RELEVANCE))).otherwise(F.lit("0"))
        score = F.when(ok, _text(parsed, "relevance_score")).otherwise(fallback)
        note = F.when(ok, _or_empty(parsed, has, "assessment")).otherwise(F.lit(NO_EVALUATION))
        absent = F.lit("None")
        return F.concat(
            F.lit("score="), F.coalesce(score, absent), F.lit("/10 — "), F.coalesce(note, absent)
        )

    return _read(response, build)
