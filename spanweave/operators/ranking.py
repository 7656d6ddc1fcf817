"""Global row numbers without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize


def with_global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add ``name``: 0-based position by ``order`` (which must be total). Range-sorted partitions get offsets; one row per partition is collected."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialize(ordered.withColumn("__m", F.monotonically_increasing_id()))
    part, row = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if not counts:
        return at.withColumn(name, F.lit(0).cast("long")).drop("__m")
    return at.withColumn(name, row + F.element_at(F.create_map(*offsets), part)).drop("__m")
