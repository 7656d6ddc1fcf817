"""Deterministic stratified splits: within a class rows are ranked by an md5 of seed, fold and id, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that cut a class into ranges: 4096 of them.
PREFIX = 3


def hash_rank_key(seed: int, fold: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), fold.cast("string"), id_col.cast("string")))


def stratified_splits(df: DataFrame, id_col: str, label: str, test_share: float, folds: int = 1, seed: int = 0) -> DataFrame:
    """``(fold, id_col, label, is_test)``: in every fold, ``round(test_share * size)`` rows of each class are test rows.

    The class's rank is found without one task per class: ids are ranked inside hash ranges, whose sizes (4096 per class and fold) give the offsets.
    """
    rows = df.select(F.col(id_col), F.col(label)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = rows.withColumn("h", hash_rank_key(seed, F.col("fold"), F.col(id_col))).withColumn("part", F.substring("h", 1, PREFIX))
    sizes = rows.groupBy("fold", label, "part").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("fold", label)
    before = sizes.withColumn("start", F.sum("n").over(by_class.orderBy("part")) - F.col("n")).withColumn("size", F.sum("n").over(by_class)).drop("n")  # 4096 rows a class
    placed = rows.alias("r").join(before.alias("s"), [F.col("r.fold") == F.col("s.fold"), F.col(f"r.{label}").eqNullSafe(F.col(f"s.{label}")), F.col("r.part") == F.col("s.part")])
    rank = F.row_number().over(Window.partitionBy("r.fold", f"r.{label}", "r.part").orderBy("r.h", f"r.{id_col}")) + F.col("start")
    return placed.select(F.col("r.fold").alias("fold"), F.col(f"r.{id_col}").alias(id_col), F.col(f"r.{label}").alias(label), (rank <= F.round(F.lit(test_share) * F.col("size"))).alias("is_test"))


def nested_splits(df: DataFrame, id_col: str, label: str, test_share: float = 0.3, unlabelled_share: float = 0.7, folds: int = 5, seed: int = 0) -> DataFrame:
    """``(fold, inner, id_col, label, role)``: outer test rows are ``test``; the rest is split again, inner fold by inner fold, into ``unlabelled`` and ``labelled``."""
    outer = stratified_splits(df, id_col, label, test_share, folds, seed)
    inner = stratified_splits_within(outer.where(~F.col("is_test")).select("fold", id_col, label), ["fold"], id_col, label, unlabelled_share, folds, seed + 1)
    train = inner.select("fold", "inner", id_col, label, F.when(F.col("is_test"), "unlabelled").otherwise("labelled").alias("role"))
    test = outer.where("is_test").select("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("inner"), id_col, label, F.lit("test").alias("role"))
    return train.unionByName(test)


def stratified_splits_within(df: DataFrame, by: list[str], id_col: str, label: str, test_share: float, folds: int, seed: int) -> DataFrame:
    """Splits inside groups ``by`` (an outer fold): ranks per (group, inner fold, class) in hash ranges as in :func:`stratified_splits`."""
    rows = df.withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = rows.withColumn("h", hash_rank_key(seed, F.concat_ws(".", *by, "inner"), F.col(id_col)))
    return _ranked(rows, [*by, "inner"], id_col, label, test_share)


def stratified_runs(df: DataFrame, run: str, id_col: str, label: str, test_share: float, seed: int = 0) -> DataFrame:
    """``(run, id_col, label, is_test)``: inside each run the split that :func:`stratified_splits` makes of it as fold 0."""
    rows = df.select(run, id_col, label).withColumn("h", hash_rank_key(seed, F.lit(0), F.col(id_col)))
    return _ranked(rows, [run], id_col, label, test_share)


def _ranked(rows: DataFrame, by: list[str], id_col: str, label: str, test_share: float) -> DataFrame:
    rows = rows.withColumn("part", F.substring("h", 1, PREFIX))
    group = [*by, label]
    sizes = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    before = sizes.withColumn("start", F.sum("n").over(w.orderBy("part")) - F.col("n")).withColumn("size", F.sum("n").over(w)).drop("n")
    rank = F.row_number().over(Window.partitionBy(*group, "part").orderBy("h", id_col)) + F.col("start")
    placed = rows.join(before, [*group, "part"]).withColumn("is_test", rank <= F.round(F.lit(test_share) * F.col("size")))
    return placed.select(*by, id_col, label, "is_test")


def take(df: DataFrame, split: DataFrame, id_col: str, test: bool) -> DataFrame:
    """The rows of ``df`` on one side of a split table of a single fold."""
    side = split.where("is_test" if test else "NOT is_test").select(id_col)
    return df.join(side, id_col, "left_semi")
