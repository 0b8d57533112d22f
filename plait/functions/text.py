"""Names, globs and masking of sensitive text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name rules and replacement text.
NAME_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9._\-/]*$"
RESERVED_NAME = "main"
REDACTED = "[REDACTED]"


def storage_name(name: Column, prefix: str = "") -> Column:
    """Branch name to storage-safe name: ``/`` to ``--``, ``.`` to ``-dot-``."""
    safe = F.replace(F.replace(name, F.lit("/"), F.lit("--")), F.lit("."), F.lit("-dot-"))
    return F.concat(F.lit(prefix), safe)


def name_problem(name: Column) -> Column:
    """NULL for a usable branch name, else ``empty``, ``reserved`` or ``invalid``."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "empty")
        .when(name == RESERVED_NAME, "reserved")
        .when(~name.rlike(NAME_PATTERN), "invalid")
    )


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a glob; only ``*`` is special."""
    parts = F.transform(
        F.split(pattern, r"\*", -1),
        lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")),
    )
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.lit("$"))


def glob_match(name: Column, pattern: Column) -> Column:
    """Exact match, or glob match when the pattern contains ``*``."""
    return (name == pattern) | (F.contains(pattern, F.lit("*")) & F.rlike(name, glob_regex(pattern)))


def hash16(value: Column) -> Column:
    """First 16 hex characters of the SHA-256 of the value's text."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def _ends_only(text: Column, least_stars: int) -> Column:
    stars = F.greatest(F.length(text) - 2, F.lit(least_stars))
    return F.concat(F.left(text, F.lit(1)), F.repeat(F.lit("*"), stars), F.right(text, F.lit(1)))


def mask(value: Column) -> Column:
    """Keep the first and last character; e-mail addresses keep their domain."""
    text = value.cast("string")
    parts = F.split(text, "@")
    return (
        F.when(
            F.contains(text, F.lit("@")),
            F.concat(_ends_only(F.get(parts, 0), 1), F.lit("@"), F.get(parts, 1)),
        )
        .when(F.length(text) <= 2, F.repeat(F.lit("*"), F.length(text)))
        .otherwise(_ends_only(text, 0))
    )
