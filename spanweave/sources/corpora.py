"""Text corpora: SGML news files, newsgroup folders, vocabulary files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.ranking import with_global_rank
from spanweave.operators.textfeatures import strip_post
from spanweave.sources.tabular import in_labels


def _between(tag: str) -> Column:
    return F.regexp_extract("doc", rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def parse_sgml(raw: DataFrame) -> DataFrame:
    """``raw(path, content)``, with content as text -> ``(path, position, title, body, topics)``: one row per ``</REUTERS>`` document.

    Body white space is collapsed; a missing tag gives an empty text or list. Files are split by expressions only.
    """
    docs = raw.select("path", F.posexplode(F.split("content", "(?i)</REUTERS>")).alias("position", "doc")).where(F.col("doc").rlike("(?i)<REUTERS"))
    topics = F.regexp_extract_all(_between("TOPICS"), F.lit("(?is)<D>(.*?)</D>"), F.lit(1))
    return docs.select("path", "position", _unescape(_between("TITLE")).alias("title"), F.regexp_replace(_unescape(_between("BODY")), r"\s+", " ").alias("body"), F.transform(topics, _unescape).alias("topics"))


def _unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.replace(F.regexp_replace(c, "&#[0-9]+;", ""), F.lit("&amp;"), F.lit("&"))


def render_sgml(title: Column, body: Column, topics: Column) -> Column:
    """One document as SGML text, the inverse of :func:`parse_sgml`."""

    def escape(c: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return F.coalesce(c, F.lit(""))

    listed = F.array_join(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.concat(F.lit("<D>"), escape(t), F.lit("</D>"))), "")
    return F.concat(F.lit("<REUTERS><TOPICS>"), listed, F.lit("</TOPICS><TEXT><TITLE>"), escape(title), F.lit("</TITLE><BODY>"), escape(body), F.lit("</BODY></TEXT></REUTERS>"))


def read_sgml(spark: SparkSession, folder: str, pattern: str = "*.sgm") -> DataFrame:
    """The documents of all files of a folder that match, in Latin-1; a file is one row, so it must fit in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return parse_sgml(files.select("path", F.decode("content", "ISO-8859-1").alias("content")))


def topic_batch(docs: DataFrame, positive: str) -> DataFrame:
    """Documents with topics: ``text`` is title, blank line, body; ``y`` tells whether ``positive`` is among the topics."""
    if not isinstance(positive, str):
        raise TypeError("the positive topic is a string")
    rows = docs.where(F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return rows.withColumns({"text": text, "y": F.array_contains("topics", positive).cast("int")})


def read_reuters(spark: SparkSession, folder: str, positive: str = "acq") -> DataFrame:
    return topic_batch(read_sgml(spark, folder), positive)


def read_newsgroups(spark: SparkSession, folder: str, subset: str = "*") -> DataFrame:
    """``<folder>/<subset>/<category>/<post>`` -> ``(path, category, subset, text)`` without headers, quotes and signatures; nothing is downloaded."""
    files = spark.read.text(f"{folder}/{subset}/*/*", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -3), "(?i)^.*(train|test)$", "$1").alias("subset"), strip_post(F.col("raw")).alias("text"))


def seeded_order(df: DataFrame, key: str = "path", seed: int = 0) -> DataFrame:
    """Add ``position``: posts of all subsets (or of those of training) in one order that a seed gives, the same in any engine."""
    return with_global_rank(df, "position", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key))


def label_categories(df: DataFrame, categories: Iterable[str] | None, positive: Iterable[str], category: str = "category") -> DataFrame:
    """Keep the named categories and add ``y``: 1 for the positive ones."""
    kept = df if categories is None else df.where(F.col(category).isin(list(categories)))
    return kept.withColumn("y", in_labels(F.col(category), positive))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(term_id, term)``: one term per line, numbered from 0 in file order. A vocabulary file is read as one text of bounded size."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("term_id", "term"))
    return lines.select("term_id", F.trim("term").alias("term")).where("term <> ''")
