"""Tabular sources and their preparation, with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the headerless files, in file order.
ABALONE = ("Sex", "Length", "Diameter", "Height", "Whole weight", "Shucked weight", "Viscera weight", "Shell weight", "Rings")
MUSHROOM = (
    "class", "cap-shape", "cap-surface", "cap-color", "bruises?", "odor", "gill-attachment", "gill-spacing", "gill-size", "gill-color", "stalk-shape", "stalk-root",
    "stalk-surface-above-ring", "stalk-surface-below-ring", "stalk-color-above-ring", "stalk-color-below-ring", "veil-type", "veil-color", "ring-number", "ring-type",
    "spore-print-color", "population", "habitat",
)
ANURAN = tuple(f"MFCCs_{i:>2}" for i in range(1, 23)) + ("Family", "Genus", "Species", "RecordID")
SEX_CODES = {"I": 0, "M": 1, "F": 2}
CLASS_CODES = {"p": 0, "e": 1}
FAMILY_CODES = {"Leptodactylidae": 1, "Hylidae": 0, "Dendrobatidae": 0, "Bufonidae": 0}
MUSHROOM_UNUSED = ("veil-type", "stalk-root")
ANURAN_UNUSED = ("Genus", "Species", "RecordID")


def map_values(c: Column, codes: dict[str, int]) -> Column:
    """Dictionary lookup; unmapped values are null."""
    out = F.lit(None).cast("int")
    for k, v in codes.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def in_labels(c: Column, positive: Iterable) -> Column:
    """1 if the value is among the positive labels, else 0; labels that don't occur are harmless, null is 0."""
    labels = list(positive)
    return F.coalesce(c.isin(labels).cast("int"), F.lit(0)) if labels else F.lit(0)


def parity(c: Column) -> Column:
    return (c % 2).cast("int")


def _csv(spark: SparkSession, source, names: tuple[str, ...], kinds: dict[str, T.DataType], header: bool, max_rows: int | None = None) -> DataFrame:
    """Read from a path or from an iterable of lines (an open stream); with ``max_rows`` no more rows than that."""
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    if isinstance(source, str):
        read = spark.read.schema(schema).option("header", header).csv(source)
        return read if max_rows is None else read.limit(max_rows)
    filled = (line for line in source if line.strip())
    lines = [(line,) for line in islice(filled, int(header), None if max_rows is None else int(header) + max_rows)]
    raw = spark.createDataFrame(lines, "line string")
    return raw.select(F.from_csv("line", _ddl(schema)).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_abalone(spark: SparkSession, source, max_rows: int | None = None) -> DataFrame:
    """Headerless measurements: a path or lines."""
    kinds = {n: T.DoubleType() for n in ABALONE[1:-1]} | {"Rings": T.IntegerType()}
    return _csv(spark, source, ABALONE, kinds, False, max_rows)


def read_mushroom(spark: SparkSession, source, max_rows: int | None = None) -> DataFrame:
    """Headerless categories."""
    return _csv(spark, source, MUSHROOM, {}, False, max_rows)


def read_anuran(spark: SparkSession, source, max_rows: int | None = None) -> DataFrame:
    """Coefficients with a header line."""
    kinds = {n: T.DoubleType() for n in ANURAN[:22]} | {"RecordID": T.LongType()}
    return _csv(spark, source, ANURAN, kinds, True, max_rows)


def read_digits(spark: SparkSession, source, pixels: int = 64, max_rows: int | None = None) -> DataFrame:
    """Headerless digit images: as many grey values as pixels, then the digit -> ``(features array<double>, digit)``."""
    names = tuple(f"pixel_{i}" for i in range(pixels)) + ("digit",)
    rows = _csv(spark, source, names, dict.fromkeys(names[:-1], T.DoubleType()) | {"digit": T.IntegerType()}, False, max_rows)
    return rows.select(F.array(*names[:-1]).alias("features"), "digit")


def prepare_abalone(df: DataFrame, sex: str = "Sex", rings: str = "Rings") -> DataFrame:
    """Sex as a number and 5 <= rings <= 15; the filter reaches the scan."""
    return df.where(F.col(f"`{rings}`").between(5, 15)).withColumn(sex, map_values(F.col(f"`{sex}`"), SEX_CODES))


def prepare_mushroom(df: DataFrame, label: str = "class", unused: tuple[str, ...] = MUSHROOM_UNUSED) -> DataFrame:
    return df.withColumn(label, map_values(F.col(f"`{label}`"), CLASS_CODES)).drop(*unused)


def prepare_anuran(df: DataFrame, family: str = "Family", unused: tuple[str, ...] = ANURAN_UNUSED) -> DataFrame:
    return df.withColumn(family, map_values(F.col(f"`{family}`"), FAMILY_CODES)).drop(*unused)


def vectors(df: DataFrame, id_col: str, columns: list[str], y: Column) -> DataFrame:
    """``(id_col, features, y)``."""
    return df.select(id_col, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features"), y.cast("int").alias("y"))


def digit_rows(df: DataFrame, id_col: str, features: str, digit: str) -> DataFrame:
    """Digit images, or any vectors with an integer label: the label's parity."""
    return df.select(id_col, F.col(features).cast("array<double>").alias("features"), parity(F.col(digit)).alias("y"))
