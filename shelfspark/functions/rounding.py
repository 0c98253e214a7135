"""Rounding whose ties don't hang on the order of arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int) -> Column:
    """Half to even, after what products and quotients leave beyond nine digits is rounded away: 126.05 is a tie, as is 126.05000000000001."""
    return F.bround(F.round(c, 9), digits)
