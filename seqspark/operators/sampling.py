"""Random numbers that are the same at each run, on any partitioning and after a lost executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the seed and the keys."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(2**53)


def geometric(u: Column, p: float) -> Column:
    """Number of trials up to the first success of chance ``p``."""
    from math import log

    return F.ceil(F.ln(1 - u) / log(1 - p))


def shuffled(seed: int, *keys: Column) -> Column:
    """A sort key for a random order."""
    return F.xxhash64(F.lit(seed), *keys)
