"""Tables written as the files that the sources read, in the shared folder of checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanweave.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def csv(df: DataFrame, name: str, header: bool = False) -> str:
    """Write comma-separated files; their folder."""
    path = scratch(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


def lines(df: DataFrame, name: str, rows: int = 1000) -> str:
    """Write a text column, one value a line, into ``.txt`` files of at most ``rows``; their folder."""
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).text(path)
    return path
