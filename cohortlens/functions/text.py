"""Scalar expressions over identifiers, labels and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_issue(symbol: Column) -> Column:
    """'' for a usable identifier, else why it is not."""
    return (
        F.when(symbol.isNull() | (F.length(symbol) == 0), "empty")
        .when(symbol.rlike(r"^\s|\s$"), "surrounding_whitespace")
        .when(symbol.rlike(r"[\x00-\x1F]"), "control_character")
        .otherwise("")
    )


def first_token(label: Column) -> Column:
    """Coarse category: the first whitespace-separated token."""
    return F.split(F.trim(label), r"\s+").getItem(0)


def fold_case(label: Column) -> Column:
    return F.lower(F.trim(label))


def safe_name(label: Column) -> Column:
    return F.regexp_replace(label, "[^A-Za-z0-9]+", "_")


def numbered(prefix: str, number: Column, width: int = 4) -> Column:
    """Zero-padded to width; a wider number stays whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"))


def set_signature(items: Column) -> Column:
    """SHA-256 of the sorted members joined by newlines; equal sets give equal text."""
    return F.sha2(F.concat_ws("\n", F.array_sort(items)), 256)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """';'-joined reasons whose condition holds, in the given order."""
    return F.concat_ws(";", *[F.when(condition, F.lit(text)) for condition, text in pairs])


def last_rule(*pairs: tuple[Column, str]) -> Column:
    """One reason per row: the last rule that holds wins, '' when none does."""
    chain = None
    for condition, text in reversed(pairs):
        chain = F.when(condition, text) if chain is None else chain.when(condition, text)
    return chain.otherwise("")


def three_valued_equal(a: Column, b: Column) -> Column:
    """a = b where b is known, NULL where b is missing; a missing a disagrees."""
    return F.when(b.isNotNull(), F.coalesce(a == b, F.lit(False)))
