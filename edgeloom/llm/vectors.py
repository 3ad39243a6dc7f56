"""Vectors as whole numbers: which rows count, and their components scaled and floored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components stay under this, so that squared distances of vectors up to 2,048 long fit a long.
MOST_WHOLE = 1 << 24


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector is there and its components are neither null nor non-finite, nor beyond MOST_WHOLE when scaled."""
    within = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < MOST_WHOLE / scale))
    return F.coalesce(within, F.lit(False))  # a NaN is greater than any number


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))
