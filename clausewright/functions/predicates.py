"""The null model: what counts as blank, zero, true or answered, each with its own rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for nothing, and the sets of spellings that count as true.
NOTHING = ("", "nan", "none")
TRUE_ONLY = ("true",)
TRUE_ONE = ("true", "1")
TRUE_YES = ("true", "1", "yes")
TRUE_WIDE = ("true", "1", "1.0", "yes")
TRUE_HUMAN = ("1", "1.0", "true", "yes", "y")
TRUE_SHORT = ("1", "true", "yes", "y", "t")


def _folded(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def blank(c: Column) -> Column:
    return c.isNull() | _folded(c).isin(*NOTHING)


def number(c: Column) -> Column:
    """Double, or null for what is no number (NaN included)."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def zero_or_blank(c: Column) -> Column:
    return blank(c) | F.coalesce(number(c) == 0, F.lit(False))


def truthy(c: Column, accepted: tuple[str, ...]) -> Column:
    return F.coalesce(_folded(c).isin(*accepted), F.lit(False))


def answered(c: Column) -> Column:
    """A usable answer: neither blank nor the word for an error."""
    return ~blank(c) & (F.upper(F.trim(c)) != "ERROR")


def filled(first: Column, second: Column) -> Column:
    return F.when(blank(first), second).otherwise(first)
