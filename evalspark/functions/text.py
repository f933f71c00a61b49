"""Text guards as Column functions: injection stripping, boundary wrapping, leak scan, redaction.

All of them stay inside the JVM; a column of any length is processed whole.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.columns import let

# Phrases and tags taken out of untrusted text, applied in this order.
INJECTION_PATTERNS = (
    r"</?system>",
    r"\[/?SYSTEM\]",
    r"\[/?INST\]",
    r"ignore (?:all )?previous instructions",
    r"you are now (?:a|an|my|the) ",
    r"(?:enable|activate|enter) developer mode",
    r"disregard (?:all )?(?:prior|above) (?:instructions|rules)",
    r"new (?:system )?instructions?:",
    r"override (?:safety|security|instructions)",
    r"act as (?:if|though) you (?:are|were)",
)
# Fixed value: zero-width, bidirectional and byte-order code points.
CONTROL_CHARS = r"[\u200b-\u200f\u2028-\u202f\u2060-\u206f\ufeff]"
# Credential patterns, applied in this order.
CREDENTIAL_PATTERNS = (
    ("api_key", r"(?:sk|pk|rk|ak)[-_][a-zA-Z0-9]{20,}"),
    ("bearer_token", r"Bearer\s+[a-zA-Z0-9\-_.]{20,}"),
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("generic_secret", r"""(?iuU)(?:password|secret|token|key)\s*[:=]\s*['"][^'"]{8,}['"]"""),
    ("connection_string", r"(?iuU)(?:postgres|mysql|redis|mongodb)://[^\s]{10,}"),
)
# Infrastructure patterns, applied in this order.
INFRA_PATTERNS = (
    (
        "internal_host",
        r"(?:localhost|127\.0\.0\.1|0\.0\.0\.0|10\.\d+\.\d+\.\d+"
        r"|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+):\d+",
    ),
    ("stack_trace", r"Traceback \(most recent call last\)"),
    ("file_path", r"""(?:File|at) ["']/(?:app|home|usr|var|etc)/[^\s"']+\.py["']"""),
)
# Lengths and markers of the wrapped form.
MAX_WRAPPED_CHARS = 50_000
STRIPPED = "[STRIPPED]"
BOUNDARY_OPEN = "<<<UNTRUSTED_DATA"
BOUNDARY_CLOSE = "<<<END_UNTRUSTED_DATA>>>"
BOUNDARY_STRIPPED = "[BOUNDARY-STRIPPED]"
TRUNCATED = "\n[TRUNCATED]"
CREDENTIAL_SHOWN = 20
INFRA_SHOWN = 40
ERROR_CHARS = 500
GENERIC_ERROR = "An internal error occurred."


# Text every match of a pattern has to contain, in lower case for the patterns that
# ignore case. A plain substring test is far cheaper than the pattern itself, so the patterns only
# run on texts that can match at all.
INJECTION_CLUES = (
    "system>", "system]", "inst]", "previous instructions", "you are now ", "developer mode",
    "disregard ", "instruction", "override ", "act as ",
)
CREDENTIAL_CLUES = {
    "api_key": ("sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "ak-", "ak_"),
    "bearer_token": ("Bearer",),
    "aws_key": ("AKIA",),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "generic_secret": ("password", "secret", "token", "key"),
    "connection_string": ("://",),
}
INFRA_CLUES = {
    "internal_host": ("localhost:", "127.0.0.1:", "0.0.0.0:", "10.", "172.", "192.168."),
    "stack_trace": ("Traceback (most recent call last)",),
    "file_path": (".py",),
}
IGNORES_CASE = ("generic_secret", "connection_string")
# The one letter whose lower case is two characters long; texts with it are never ruled out.
DOTTED_CAPITAL_I = chr(0x130)


def _folded(text: Column) -> Column:
    """Letters that are equal when case is ignored become the same letter."""
    return F.lower(F.upper(text))


def _any_clue(text: Column, clues: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(clue)) for clue in clues])


def _may_inject(text: Column) -> Column:
    return F.contains(text, F.lit(DOTTED_CAPITAL_I)) | let(
        _folded(text), lambda folded: _any_clue(folded, INJECTION_CLUES)
    )


def _may_hold(text: Column, name: str, clues: tuple[str, ...]) -> Column:
    if name not in IGNORES_CASE:
        return _any_clue(text, clues)
    return F.contains(text, F.lit(DOTTED_CAPITAL_I)) | let(
        _folded(text), lambda folded: _any_clue(folded, clues)
    )


def strip_injections(text: Column) -> Column:
    stripped = text
    for pattern in INJECTION_PATTERNS:
        stripped = F.regexp_replace(stripped, f"(?iu){pattern}", STRIPPED)
    return F.when(_may_inject(text), stripped).otherwise(text)


def strip_unicode_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def wrap_untrusted(text: Column, label: str = "user_input") -> Column:
    """Neutralise markers, strip phrases, then control characters, then cut, then frame."""
    body = F.replace(text, F.lit(BOUNDARY_CLOSE), F.lit(BOUNDARY_STRIPPED))
    body = F.replace(body, F.lit(BOUNDARY_OPEN), F.lit(BOUNDARY_STRIPPED))
    body = strip_unicode_control(strip_injections(body))
    body = F.when(
        F.length(body) > MAX_WRAPPED_CHARS,
        F.concat(F.substring(body, 1, MAX_WRAPPED_CHARS), F.lit(TRUNCATED)),
    ).otherwise(body)
    safe_label = re.sub(r"[^a-zA-Z0-9_\-]", "_", label)
    return F.concat(
        F.lit(f"{BOUNDARY_OPEN} source={safe_label}>>>\n"), body, F.lit(f"\n{BOUNDARY_CLOSE}")
    )


def sanitize_literal(text: Column) -> Column:
    """Control characters first, so a phrase split by a zero-width character is caught too."""
    return strip_injections(strip_unicode_control(text))


def leak_findings(text: Column) -> Column:
    """array<struct<type, match>> of every credential and infrastructure match."""

    def found(kind: str, name: str, pattern: str, clues: tuple[str, ...], shown: int) -> Column:
        hits = F.when(
            _may_hold(text, name, clues), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        return F.transform(
            hits,
            lambda hit: F.struct(
                F.lit(f"{kind}:{name}").alias("type"),
                F.concat(F.substring(hit, 1, shown), F.lit("...")).alias("match"),
            ),
        )

    parts = [
        found("credential", n, p, CREDENTIAL_CLUES[n], CREDENTIAL_SHOWN)
        for n, p in CREDENTIAL_PATTERNS
    ]
    parts += [found("infra", n, p, INFRA_CLUES[n], INFRA_SHOWN) for n, p in INFRA_PATTERNS]
    return F.concat(*parts)


def _replaced(
    text: Column,
    patterns: tuple[tuple[str, str], ...],
    clues: dict[str, tuple[str, ...]],
    shape: str,
) -> Column:
    """Patterns applied in order. All of them run as soon as one clue of any is present."""
    out = text
    for name, pattern in patterns:
        out = F.regexp_replace(out, pattern, shape.format(name=name))
    may = reduce(Column.__or__, [_may_hold(text, n, clues[n]) for n, _ in patterns])
    return F.when(may, out).otherwise(text)


def redact_secrets(text: Column) -> Column:
    return _replaced(text, CREDENTIAL_PATTERNS, CREDENTIAL_CLUES, "[REDACTED:{name}]")


def has_credential(text: Column) -> Column:
    checks = [
        _may_hold(text, name, CREDENTIAL_CLUES[name]) & F.regexp_like(text, F.lit(pattern))
        for name, pattern in CREDENTIAL_PATTERNS
    ]
    return reduce(Column.__or__, checks)


def sanitize_error(text: Column) -> Column:
    body = _replaced(text, INFRA_PATTERNS, INFRA_CLUES, "[{name}]")
    body = F.when(
        F.length(body) > ERROR_CHARS, F.concat(F.substring(body, 1, ERROR_CHARS), F.lit("..."))
    ).otherwise(body)
    return F.when(has_credential(text), F.lit(GENERIC_ERROR)).otherwise(body)
