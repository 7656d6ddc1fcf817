"""Text features over sparse term counts ``tf(id, term, n)``; nothing is densified."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default tokens: two or more word characters; ``ascii`` keeps to letters that every engine's patterns agree on.
TOKEN = {"unicode": r"(?U)\b\w\w+\b", "ascii": r"[a-z0-9_]{2,}"}
# Frequent English function words.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or "
    "other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your yours".split()
)


def tokens(text: Column, alphabet: str = "unicode") -> Column:
    """Array of lower-case tokens; null and empty texts give an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN[alphabet]), F.lit(0))


def strip_post(text: Column) -> Column:
    """A newsgroup post without its headers (up to the first blank line), quoted lines, attribution lines and signature."""
    body = F.when(text.rlike(r"(?s)\A[\w-]+:.*?\n\n"), F.regexp_replace(text, r"(?s)\A.*?\n\n", "")).otherwise(text)
    unquoted = F.regexp_replace(body, r"(?m)^(?:[>|%].*|.*(?:writes in|writes:|wrote:|says:|said:).*|(?:In article|Quoted from).*)$\n?", "")
    return F.regexp_replace(unquoted, r"(?s)\n(?:--\s*|-{3,}\s*|_{3,}\s*)\n(?!.*\n\s*\n).*\z", "")


def term_counts(df: DataFrame, id_col: str, text: Column, vocabulary: DataFrame | Iterable[str] | None = None, stop_words: Iterable[str] = (), alphabet: str = "unicode") -> DataFrame:
    """``(id_col, term, n)``. Stop words go before the shuffle; a vocabulary table (``term``) is joined, a word list is filtered on."""
    words = df.select(id_col, F.explode(tokens(text, alphabet)).alias("term"))
    stop = list(stop_words)
    if stop:
        words = words.where(~F.col("term").isin(stop))
    if isinstance(vocabulary, DataFrame):
        words = words.join(vocabulary.select("term").distinct(), "term", "left_semi")
    elif vocabulary is not None:
        words = words.where(F.col("term").isin(list(vocabulary)))
    return words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(tf: DataFrame, documents: int) -> DataFrame:
    """``(term, df, idf)`` with the smooth idf ln((1 + D) / (1 + df)) + 1."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)


def tfidf(tf: DataFrame, id_col: str, documents: int) -> DataFrame:
    """``(id_col, term, value)``: tf * idf, each document of Euclidean length 1."""
    weighted = tf.join(document_frequency(tf, documents), "term").select(id_col, "term", (F.col("n") * F.col("idf")).alias("v"))
    return weighted.select(id_col, "term", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))).alias("value"))


def tfidf_score(tf: DataFrame, id_col: str, y: DataFrame) -> DataFrame:
    """``(term, score)``: column sums of the normalised tf-idf; ``y(id_col, y)`` gives the documents."""
    return tfidf(tf, id_col, y.count()).groupBy("term").agg(F.sum("value").alias("score"))


def mutual_information(tf: DataFrame, id_col: str, y: DataFrame, vocabulary_size: int | None = None) -> DataFrame:
    """``(term, score)``: sum over classes and counts, 0 included, of p(x,y) ln((p(x,y) + 1) / (p(x) p(y) + 1)).

    p(x,y) is a cell over documents times vocabulary, p(y) the class's share. The cells of count 0 are the class sizes less the others, so no zero is
    ever stored; class sizes are a row per class.
    """
    docs = y.count()
    terms = vocabulary_size if vocabulary_size is not None else tf.select("term").distinct().count()
    total = F.lit(float(max(1, docs * terms)))
    sizes = {r["y"]: r["c"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row per class
    size = F.create_map(*[x for k, c in sizes.items() for x in (F.lit(k), F.lit(c))]) if sizes else F.create_map(F.lit(0), F.lit(0))
    cells = tf.join(y.select(id_col, "y"), id_col).groupBy("term", "n", "y").agg(F.count(F.lit(1)).alias("c"))
    present = cells.groupBy("term").agg(*[F.sum(F.when(F.col("y") == F.lit(k), F.col("c")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(sizes)])
    zeros = present.select("term", F.lit(0).cast("long").alias("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("y"), (F.lit(c) - F.col(f"c{i}")).alias("c")) for i, (k, c) in enumerate(sizes.items())])).alias("z")).select("term", "n", "z.y", "z.c").where("c > 0")
    every = cells.select("term", F.col("n").cast("long").alias("n"), "y", "c").unionByName(zeros)
    joint = F.col("c") / total
    p_x = F.sum(joint).over(Window.partitionBy("term", "n"))
    p_y = F.element_at(size, F.col("y")) / F.lit(float(max(1, docs)))
    parts = every.withColumns({"pxy": joint, "px": p_x, "py": p_y})
    return parts.groupBy("term").agg(F.sum(F.col("pxy") * F.log((F.col("pxy") + 1) / (F.col("px") * F.col("py") + 1))).alias("score"))


#: Scorer name -> callable(tf, id_col, y).
SCORERS: dict[str, Callable[[DataFrame, str, DataFrame], DataFrame]] = {"mi": mutual_information, "tfidf": tfidf_score}


def top_terms(scores: DataFrame, n: int, digits: int = 12) -> DataFrame:
    """``(rank, term, score)`` of the ``n`` best, ties by term; TakeOrdered on each partition, then one sort of n rows."""
    best = scores.select("term", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "term").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "term"))).select("rank", "term", "score")


def l1_normalize(tf: DataFrame, id_col: str, scale: float = 10000.0) -> DataFrame:
    """``(id_col, term, value)``: counts over the document's count of all given terms, times ``scale``."""
    return tf.select(id_col, "term", (F.col("n") / F.sum("n").over(Window.partitionBy(id_col)) * scale).alias("value"))


#: Normaliser name -> callable(tf of the selected terms, id_col, number of documents, scale); tf-idf ignores the scale.
NORMALIZERS: dict[str, Callable[..., DataFrame]] = {"l1": lambda tf, id_col, docs, scale=10000.0: l1_normalize(tf, id_col, scale), "tfidf": lambda tf, id_col, docs, scale=None: tfidf(tf, id_col, docs)}


def select_terms(tf: DataFrame, ranked: DataFrame) -> DataFrame:
    """The counts of the ranked terms."""
    return tf.join(ranked.select("term"), "term", "left_semi")


def text_features(df: DataFrame, id_col: str, text: Column, y: Column, scorer: str = "mi", features: int = 600, normalizer: str = "l1", scale: float = 10000.0, vocabulary=None, stop_words: Iterable[str] = STOP_WORDS, fit_on: DataFrame | None = None, alphabet: str = "unicode") -> tuple[DataFrame, DataFrame]:
    """A corpus as ``(values(id_col, term, value), ranked(rank, term, score))``. ``fit_on`` (ids) restricts scoring to training documents."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}; known: {', '.join(SCORERS)}")
    if normalizer not in NORMALIZERS:
        raise ValueError(f"unknown normalizer {normalizer!r}; known: {', '.join(NORMALIZERS)}")
    tf = term_counts(df, id_col, text, vocabulary, stop_words, alphabet)
    labels = df.select(id_col, y.alias("y"))
    fitted, fit_labels = (tf, labels) if fit_on is None else (tf.join(fit_on.select(id_col), id_col, "left_semi"), labels.join(fit_on.select(id_col), id_col, "left_semi"))
    ranked = top_terms(SCORERS[scorer](fitted, id_col, fit_labels), features)
    return NORMALIZERS[normalizer](select_terms(tf, ranked), id_col, labels.count(), scale), ranked


def dense_vectors(values: DataFrame, id_col: str, ranked: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id_col, features)`` in rank order, zeros included, for the graph operators: as many entries as ranked terms."""
    placed = values.join(ranked.select("term", "rank"), "term").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    n = ranked.count()
    filled = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: F.coalesce(F.try_element_at(F.col("m"), r), F.lit(0.0)))
    return ids.select(id_col).join(placed, id_col, "left").select(id_col, F.coalesce(filled, F.array_repeat(F.lit(0.0), n)).alias("features"))
