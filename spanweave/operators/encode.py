"""Target-mean encoding of categorical columns, fitted on training rows and applied to any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, id_col: str, columns: list[str], *keep: str) -> DataFrame:
    """``(id_col, *keep, feature, value)``: one row per categorical cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(id_col, *keep, cells.alias("c")).select(id_col, *keep, "c.feature", "c.value")


def fit_target_means(train: DataFrame, columns: list[str], y: str) -> DataFrame:
    """``(feature, value, n, n_pos, encoded)``: the share of class 1 among the training rows with the value; nulls are no value."""
    rows = unpivot(train, y, columns).where("value is not null")
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == 1).cast("long")).alias("n_pos")).withColumn("encoded", F.col("n_pos") / F.col("n"))


def apply_target_means(df: DataFrame, id_col: str, columns: list[str], means: DataFrame) -> DataFrame:
    """``(id_col, feature, encoded)``: 0 for values unseen in training. The encoding table has a row per category, so AQE broadcasts it if it is small."""
    rows = unpivot(df, id_col, columns)
    return rows.join(means.select("feature", "value", "encoded"), ["feature", "value"], "left").select(id_col, "feature", F.coalesce("encoded", F.lit(0.0)).alias("encoded"))


def encoded_vectors(df: DataFrame, id_col: str, columns: list[str], means: DataFrame) -> DataFrame:
    """``(id_col, features)``: the encoded columns in the order of ``columns``."""
    long = apply_target_means(df, id_col, columns, means)
    wide = long.groupBy(id_col).agg(*[F.max(F.when(F.col("feature") == c, F.col("encoded"))).alias(f"__{i}") for i, c in enumerate(columns)])
    return wide.select(id_col, F.array(*[F.col(f"__{i}") for i in range(len(columns))]).alias("features"))
