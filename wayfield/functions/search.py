"""Places of values in sorted arrays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_upto(values: Column, n: int, at: Column) -> Column:
    """How many of the ``n`` rising ``values`` are at most ``at``, by halving steps; null for null."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda have, step: F.when((have + step <= n) & (F.get(values, have + step - 1) <= at), have + step).otherwise(have))
    return F.when(at.isNotNull(), found)
