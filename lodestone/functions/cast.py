"""Casts that turn what does not fit into null, and disguised missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lists of tokens that stand for a missing value.
STRICT_TOKENS = (r"\N", r"\\N")
WIDE_TOKENS = (r"\N", r"\\N", "", "na", "n/a", "nan", "null", "none", "unknown")


def blank_tokens(c: Column, tokens: Sequence[str] = STRICT_TOKENS) -> Column:
    """Null where the trimmed, lower-cased value is one of the tokens."""
    return F.when(F.lower(F.trim(c)).isin([t.lower() for t in tokens]), None).otherwise(c)


def safe_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def safe_int(c: Column) -> Column:
    """Integers from text with fractions and exponents, rounded half away from zero; null if it fits no integer."""
    x = F.round(safe_double(c))
    return F.when(x.between(-(2**31), 2**31 - 1), x).cast("int")


def safe_boolean(c: Column) -> Column:
    return F.trim(c).try_cast("boolean")


def money(c: Column) -> Column:
    """The number in a text with currency signs and thousands separators."""
    return F.nullif(F.regexp_replace(c, r"[$,]", ""), F.lit("")).try_cast("double")


def leading_number(c: Column) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("double")


def tokens_of(c: Column, renames: dict[str, str] | None = None, sep: str = ",") -> Column:
    """Trimmed lower-case parts of a delimited text, renamed, distinct and sorted."""
    parts = F.filter(F.transform(F.split(c, sep), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    if renames:
        table = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
        parts = F.transform(parts, lambda t: F.coalesce(table[t], t))
    return F.array_sort(F.array_distinct(parts))
