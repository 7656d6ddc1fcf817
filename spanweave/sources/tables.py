"""The domain tables as model rows: one per id, cleaned, with a binary label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import encode, textfeatures
from spanweave.sources import tabular

ABALONE_MEASURES = ["length", "diameter", "height", "whole_weight", "shucked_weight", "viscera_weight", "shell_weight"]
# The ring counts that are the positive class.
YOUNG_RINGS = (5, 6, 7, 8, 9)
MUSHROOM_FEATURES = [c.replace("-", "_").replace("?", "") for c in tabular.MUSHROOM[1:] if c not in tabular.MUSHROOM_UNUSED]
COEFFICIENTS = [f"mfccs_{i}" for i in range(1, 23)]


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def abalone(spark: SparkSession, d: str) -> DataFrame:
    """``(abalone_id, sex int, measures, rings)`` of records with 5 to 15 rings; stray spellings of sex are trimmed and upper-cased, a measure that is no number is null."""
    measures = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ABALONE_MEASURES]
    rows = read(spark, d, "abalone").select("abalone_id", F.upper(F.trim("sex")).alias("sex"), *measures, "rings").where("rings between 5 and 15")
    return rows.dropDuplicates(["abalone_id"]).withColumn("sex", tabular.map_values(F.col("sex"), tabular.SEX_CODES))


def abalone_vectors(spark: SparkSession, d: str, positive: tuple[int, ...] = YOUNG_RINGS) -> DataFrame:
    rows = abalone(spark, d).dropna(subset=["sex", *ABALONE_MEASURES])
    return tabular.vectors(rows, "abalone_id", ["sex", *ABALONE_MEASURES], tabular.in_labels(F.col("rings"), positive)).withColumnRenamed("abalone_id", "id")


def mushroom(spark: SparkSession, d: str) -> DataFrame:
    """``(mushroom_id, features…, y)`` with y 0 for p and 1 for e; other classes are left out."""
    rows = read(spark, d, "mushroom").select("mushroom_id", F.lower(F.trim("class_code")).alias("c"), *[F.lower(F.trim(c)).alias(c) for c in MUSHROOM_FEATURES])
    return rows.withColumn("y", tabular.map_values(F.col("c"), tabular.CLASS_CODES)).drop("c").where("y is not null").dropDuplicates(["mushroom_id"])


def mushroom_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = mushroom(spark, d)
    means = encode.fit_target_means(rows, MUSHROOM_FEATURES, "y")
    return encode.encoded_vectors(rows, "mushroom_id", MUSHROOM_FEATURES, means).join(rows.select("mushroom_id", "y"), "mushroom_id").withColumnRenamed("mushroom_id", "id")


def anuran(spark: SparkSession, d: str) -> DataFrame:
    """``(call_id, coefficients, y)`` of the four known families, compared without case and blanks."""
    codes = {k.lower(): v for k, v in tabular.FAMILY_CODES.items()}
    rows = read(spark, d, "anuran_calls").select("call_id", *COEFFICIENTS, tabular.map_values(F.lower(F.trim("family")), codes).alias("y"))
    return rows.where("y is not null").dropDuplicates(["call_id"])


def anuran_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = anuran(spark, d).dropna(subset=COEFFICIENTS)
    return tabular.vectors(rows, "call_id", COEFFICIENTS, F.col("y")).withColumnRenamed("call_id", "id")


def stories(spark: SparkSession, d: str, positive: str = "acq") -> DataFrame:
    """``(news_id, text, y)`` of the stories with topics."""
    from spanweave.sources.corpora import topic_batch

    rows = read(spark, d, "reuters").select("news_id", "title", "body", "topics").dropDuplicates(["news_id"])
    return topic_batch(rows, positive).select("news_id", "text", "y")


def reuters_vectors(spark: SparkSession, d: str, positive: str = "acq", **features) -> DataFrame:
    rows = stories(spark, d, positive)
    values, ranked = textfeatures.text_features(rows, "news_id", F.col("text"), F.col("y"), **features)
    dense = textfeatures.dense_vectors(values, "news_id", ranked, rows)
    return dense.join(rows.select("news_id", "y"), "news_id").withColumnRenamed("news_id", "id")


def newsgroup_vectors(spark: SparkSession, d: str, prefix: str = "lab.", **features) -> DataFrame:
    """Documents as posts: the category's first part is the class."""
    rows = read(spark, d, "documents").where("category is not null").select("doc_id", "text", F.col("category").startswith(prefix).cast("int").alias("y"))
    values, ranked = textfeatures.text_features(rows, "doc_id", F.col("text"), F.col("y"), **features)
    dense = textfeatures.dense_vectors(values, "doc_id", ranked, rows)
    return dense.join(rows.select("doc_id", "y"), "doc_id").withColumnRenamed("doc_id", "id")
