"""Vector columns: which rows take part, and their values as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(column: str) -> Column:
    """True where the vector is not null and all its components are finite numbers."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as doubles."""
    return np.array([np.asarray(v, np.float64) for v in column], np.float64).reshape(len(column), -1)
