"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule.
Policies are versioned masks over these bits: applying another policy, or asking what one rule alone removes, never
touches a text again. DataFrame functions only; each document is one row, nothing is shuffled but the ablation's
counts per bit pattern (at most 2^rules rows per task).

Repeats inside a text are found by sorting one number per 3-word window, hash and position packed by the
text's own length (hash space 2^62 / words, so texts of any length fit).

Defined cases: null text has no words. Repeated rows are judged alike. Empty tables give empty ledgers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import documents

BLANK = " \t\n\u000b\u000c\r"
SYMBOLS = r"[#*$%&|<>]"
# Rule -> condition over the ledger's measurements that marks a failure. The position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "short_words": "10 * word_chars < 20 * n_words",
    "long_words": "10 * word_chars > 200 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines"],
}


def mask(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def repeated_words() -> Column:
    """Words inside 3-word windows that a text holds twice or more; over columns ``words`` and ``n_words``."""
    packed = F.expr(
        "array_sort(transform(sequence(0, cast(n_words - 3 as int)), i -> "
        "pmod(xxhash64(words[i], words[i + 1], words[i + 2]), 4611686018427387904 div n_words) * n_words + i))"
    )
    positions = F.expr(
        "array_sort(transform(filter(packed, (v, i) -> v div n_words = get(packed, i - 1) div n_words OR v div n_words = get(packed, i + 1) div n_words), v -> v % n_words))"
    )
    return packed, positions


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``bits`` of the failed rules."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_list(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    packed, positions = repeated_words()
    rows = rows.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.col("n_words") >= 3, packed).alias("packed"),
    )
    rows = rows.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= 3, positions).alias("positions"),
    )
    # Each window covers its three words less those that the next window begins before.
    covered = F.expr("aggregate(transform(positions, (p, i) -> least(3L, coalesce(get(positions, i + 1) - p, 3L))), 0L, (a, x) -> a + x)")
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(F.when(F.size("positions") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))
    bits = sum((F.expr(condition).cast("long") * (1 << bit) for bit, condition in enumerate(RULES.values())), F.lit(0).cast("long"))
    return rows.withColumn("bits", bits)


def passes(version: str) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col("bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """rule, failed (documents that fail it), only (documents that fail no other rule of the policy)."""
    patterns = rows.groupBy(F.col("bits").bitwiseAND(F.lit(mask(POLICIES[version]))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[version]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("failed"), F.sum(F.when(F.bit_count("bits") == 1, F.col("n")).otherwise(0)).alias("only"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: measurements and verdicts of every document."""
    rows = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (
  SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words >= 3),
k AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM k),
p AS (SELECT DISTINCT doc_id, i + j AS word FROM r, (VALUES (0), (1), (2)) AS s(j) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
x AS (SELECT m.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 5 * n_words OR 10 * word_chars < 20 * n_words
    OR 10 * word_chars > 200 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM x
"""
