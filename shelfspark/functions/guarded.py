"""Scalar functions of rules and derivations whose handling of nulls differs from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(cols: tuple[Column, ...]) -> Column:
    out = cols[0].isNull()
    for c in cols[1:]:
        out = out | c.isNull()
    return out


def greatest(*cols: Column) -> Column:
    """The largest value; null if any is null."""
    return F.when(~_any_null(cols), F.greatest(*cols))


def least(*cols: Column) -> Column:
    """The smallest value; null if any is null."""
    return F.when(~_any_null(cols), F.least(*cols))


def to_number(c: Column) -> Column:
    """Text to double without thousands marks; null for anything else."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("double")


def divide(a: Column, b: Column) -> Column:
    """Quotient; null instead of infinity."""
    return F.try_divide(a, b)


def startswith(text: Column, part: Column) -> Column:
    """Without regard to case; null is false."""
    return F.coalesce(F.startswith(F.lower(text), F.lower(part)), F.lit(False))


def contains(text: Column, part: Column) -> Column:
    """Without regard to case; null is false."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def true(condition: Column) -> Column:
    """A comparison that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))
