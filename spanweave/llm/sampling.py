"""Bounded samples of large tables, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONE = 1 << 40


def hash_sample(df: DataFrame, key: Column, n: int, rows: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows of ``df``: those whose key's hash lies below the share; all of them if there are no more.

    A filter in the scan, without a sort, so that no task sends more than its share. ``key`` must be all but unique: then the size is within a few
    square roots of ``rows``.
    """
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_ONE)) < F.lit(int(_ONE * rows / n)))
