"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import balanced_sample, bpe_automaton, leakage, lookalikes, mixture, near_duplicates, neighbours, terms

#: Folder of the public tokenizers' vocabulary files; a parameter.
TOKENIZERS = os.environ.get("SPANWEAVE_TOKENIZERS", "/opt/tokenizers")
MEASURES = ["length", "diameter", "whole_weight", "shell_weight"]
COEFFICIENTS = [f"mfccs_{i}" for i in range(1, 23)]


def _vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def _spellings() -> tuple[str, str]:
    """The vocabularies that canonical spellings come from; a missing file is an error."""
    return _vocabulary("byte_bpe_50k.tiktoken"), _vocabulary("byte_bpe_multi_50k.tiktoken")


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def story() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.chain_clusters(_read(spark, d, "abalone"), "abalone_id", ("length", "whole_weight"), 0.03)


def p1_abalone_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mixture.similarity_clusters(_read(spark, d, "abalone"), "abalone_id", ["length", "whole_weight"], positive=True)


def p1_call_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mixture.similarity_clusters(_read(spark, d, "anuran_calls"), "call_id", COEFFICIENTS, label="family")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_read(spark, d, "reuters"), "news_id", story())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("kind <> 'useful'").select("term", "kind")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    return terms.value_frequencies(_read(spark, d, "mushroom"), "mushroom_id", ["class_code", "odor", "stalk_root", "habitat"])


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = _read(spark, d, "sample_targets")
    shares = {r["table_name"]: r["s"] for r in targets.groupBy("table_name").agg(F.max("sample_share").alias("s")).collect()}  # a row a table
    first_topic = F.get("topics", F.lit(0))
    tables = (("abalone", "abalone_id", F.col("rings")), ("anuran_calls", "call_id", F.col("family")), ("mushroom", "mushroom_id", F.col("class_code")), ("reuters", "news_id", first_topic))
    return balanced_sample.balanced_samples([balanced_sample.Draw(t, _read(spark, d, t), key, category, targets.where(F.col("table_name") == t), shares.get(t) or 0.0) for t, key, category in tables])


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d)[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_report(spark, d).where("short").select("table_name", "category")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d)[0]


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """What any balanced draw has in common: each category is drawn to within one record of its need, or whole if it falls short."""
    report = p3_report(spark, d)
    met = F.when(F.col("short"), F.col("drawn") == F.col("available")).otherwise(F.abs("residual") < 1)
    return report.select("table_name", "category", "available", F.round("needed", 6).alias("needed"), "short", met.alias("met"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_read(spark, d, "reuters"), "news_id", story(), similarity=0.5, shingle=3, min_words=20).select("news_id_a", "news_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_read(spark, d, "reuters"), "news_id", story(), similarity=0.5, shingle=3, min_words=20)


def p4_document_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_read(spark, d, "documents"), "doc_id", F.col("text"), similarity=0.8, shingle=5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(_read(spark, d, "abalone"), "abalone_id", MEASURES, k=5)


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_vectors(_read(spark, d, "abalone"), "abalone_id", MEASURES, k=5)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe_automaton.encode_corpus(_read(spark, d, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe_automaton.decode_corpus(p7_ids(spark, d), _vocabulary("byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_read(spark, d, "documents"), _read(spark, d, "eval_items"), 12, _spellings())


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_read(spark, d, "documents"), _read(spark, d, "eval_items"), 12, _spellings(), spans=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_read(spark, d, "documents"), _spellings())


def p9_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_text(_read(spark, d, "documents"), _spellings())


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_classes(_read(spark, d, "documents"), _spellings())


_ALL = [p1_found, p1_abalone_clusters, p1_call_clusters, p2_found, p2_terms, p2_values, p3_found, p3_report, p3_balance, p3_sample, p4_found, p4_groups, p4_document_groups, p6_found, p6_neighbours, p7_ids, p7_decoded, p8_found, p8_passages, p9_found, p9_text, p9_classes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_STORY_WORDS = r"""
story AS (SELECT news_id, any_value(coalesce(title, '') || ' ' || coalesce(body, '')) AS text FROM reuters WHERE news_id IS NOT NULL GROUP BY news_id),
word AS (SELECT news_id, unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))) AS term FROM story),
"""
_TERMS = rf"""
WITH {_STORY_WORDS}
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT news_id) AS records FROM word GROUP BY term),
kinds AS (SELECT term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records,
  CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * (SELECT count(*) FROM story) THEN 'common' ELSE 'useful' END AS kind FROM counted)
"""
_NEED = r"""
WITH record AS (
  SELECT DISTINCT 'abalone' AS t, abalone_id AS id, CAST(rings AS VARCHAR) AS c FROM abalone
  UNION SELECT 'anuran_calls', call_id, lower(trim(family)) FROM anuran_calls
  UNION SELECT 'mushroom', mushroom_id, lower(trim(class_code)) FROM mushroom
  UNION SELECT 'reuters', news_id, lower(trim(topics[1])) FROM reuters),
usable AS (SELECT s.table_name, s.category, count(*) AS n FROM sample_targets s JOIN record r ON r.t = s.table_name AND r.c = lower(trim(s.category)) GROUP BY ALL),
need AS (SELECT s.table_name, s.category, coalesce(u.n, 0) AS available,
  greatest(s.target_share * s.sample_share * (SELECT sum(n) FROM usable x WHERE x.table_name = s.table_name), s.min_rows) AS needed
  FROM sample_targets s LEFT JOIN usable u ON u.table_name = s.table_name AND u.category = s.category)
"""
_CHAINS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT abalone_id AS id, any_value(length) AS x, any_value(whole_weight) AS y FROM abalone WHERE length > 0 AND NOT isnan(length) AND whole_weight > 0 AND NOT isnan(whole_weight) GROUP BY abalone_id),
e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON b.x BETWEEN a.x - 0.030000001 AND a.x + 0.030000001 AND abs(a.y - b.y) <= 0.030000001 AND a.id <> b.id),
cc(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION (SELECT e.dst, min(cc.c) FROM cc JOIN e ON e.src = cc.id JOIN recurring.cc AS r ON r.id = e.dst WHERE cc.c < r.c GROUP BY e.dst))
SELECT id AS abalone_id, c AS cluster_id FROM cc"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form_sql(text: str) -> str:
    """A text's look, letter by letter: like the consistent form, but in Latin letters whatever a word's script, so that equal forms have equal looks."""
    widths = {chr(c): to for c, to in lookalikes.PRINTED.items() if len(to) == 1} | dict.fromkeys(lookalikes.SPACES, " ")
    looks = {c: to for c in map(chr, [*range(0x80, 0x3000), *range(0xA4D0, 0xA500)]) if (to := unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(lookalikes._LOOK))) != unicodedata.normalize("NFC", c) and len(to) == 1}
    ignorable = "".join(f"\\x{{{ord(c):x}}}" for c in lookalikes.IGNORABLE if c != "\u200d")
    pictograph = r"\x{2190}-\x{2bff}\x{1f000}-\x{1faff}"
    bare = f"regexp_replace({text}, '[{ignorable}]', '', 'g')"
    joined = rf"regexp_replace(regexp_replace({bare}, '(^|[^{pictograph}])\x{{200d}}+', '\1', 'g'), '\x{{200d}}+([^{pictograph}]|$)', '\1', 'g')"
    for table in (widths, looks):
        joined = f"translate(nfc_normalize({joined}), {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"
    return f"nfc_normalize({joined})"


_LOOKS = rf"""WITH f AS MATERIALIZED (SELECT doc_id, text, {_form_sql("text")} AS form FROM documents WHERE text IS NOT NULL),
seen AS (SELECT * FROM f WHERE regexp_replace(form, '[\s[:cntrl:]\x{{85}}\x{{2028}}\x{{2029}}]', '', 'g') <> '')"""
_RUNS = "list_distinct(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' ')))"
_LEAKS = rf"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all({_form_sql("text")}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all({_form_sql("item_text")}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE item_text IS NOT NULL),
dr AS (SELECT doc_id, unnest({_RUNS}) AS run FROM d), ir AS (SELECT item_id, unnest({_RUNS}) AS run FROM i)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)"""
def _groups_sql(key: str, words: str, shingle: int, least: int, similarity: float) -> str:
    """Chains of similar sets from all pairs that share a shingle; ``words`` is the query of (key, w)."""
    return f"""WITH RECURSIVE ws AS ({words}),
st AS MATERIALIZED (SELECT {key} AS id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {shingle - 2}, 2)), lambda i: array_to_string(w[i : i + {shingle - 1}], ' ')))) AS s FROM ws WHERE len(w) >= {max(1, least)}),
sh AS MATERIALIZED (SELECT id, unnest(s) AS s FROM st),
e AS MATERIALIZED (SELECT x, y FROM (SELECT a.id AS x, b.id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY ALL) JOIN st p ON p.id = x JOIN st q ON q.id = y WHERE c >= {similarity} * (len(p.s) + len(q.s) - c)),
cc(id, g) USING KEY (id) AS (SELECT id, id FROM st UNION (SELECT e.y, min(cc.g) FROM cc JOIN e ON e.x = cc.id JOIN recurring.cc AS r ON r.id = e.y WHERE cc.g < r.g GROUP BY e.y)),
cl AS (SELECT id, min(id) OVER (PARTITION BY s) AS c FROM st)
SELECT {key}, coalesce(cl.c, {key}) AS class_id, coalesce(cc.g, {key}) AS group_id FROM (SELECT DISTINCT {key} FROM ws) k LEFT JOIN cl ON cl.id = k.{key} LEFT JOIN cc ON cc.id = k.{key}"""


_VALID = " AND ".join(f"{c} > 0 AND NOT isnan({c})" for c in MEASURES)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CHAINS,
        "p2_found": _TERMS + "SELECT term, kind FROM kinds WHERE kind <> 'useful'",
        "p2_terms": _TERMS + "SELECT * FROM kinds",
        "p2_values": "WITH v AS (UNPIVOT (SELECT DISTINCT mushroom_id, class_code, odor, stalk_root, habitat FROM mushroom) ON class_code, odor, stalk_root, habitat INTO NAME field VALUE value), "
        "c AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL) SELECT field, value, CAST(n AS BIGINT) AS occurrences, CAST(n AS BIGINT) AS records, "
        "CASE WHEN n < 3 THEN 'rare' WHEN n > 0.3 * (SELECT count(DISTINCT mushroom_id) FROM mushroom) THEN 'common' ELSE 'useful' END AS kind FROM c",
        "p3_found": _NEED + "SELECT table_name, category FROM need WHERE available < needed",
        "p3_balance": _NEED + "SELECT table_name, category, CAST(available AS BIGINT) AS available, round(needed, 6) AS needed, available < needed AS short, true AS met FROM need",
        "p4_found": rf"""
WITH {_STORY_WORDS}
ws AS (SELECT news_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w)) AS w FROM story),
sh AS (SELECT news_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM ws WHERE len(w) >= 20),
size AS (SELECT news_id, count(*) AS n FROM sh GROUP BY ALL),
shared AS (SELECT a.news_id AS x, b.news_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.news_id < b.news_id GROUP BY ALL)
SELECT x AS news_id_a, y AS news_id_b FROM shared JOIN size p ON p.news_id = x JOIN size q ON q.news_id = y WHERE c >= 0.5 * (p.n + q.n - c)""",
        "p6_found": f"""
WITH v AS (SELECT DISTINCT abalone_id AS id, length AS a, diameter AS b, whole_weight AS c, shell_weight AS d FROM abalone WHERE {_VALID}),
near AS (SELECT x.id AS q, y.id AS o, row_number() OVER (PARTITION BY x.id ORDER BY (x.a - y.a)**2 + (x.b - y.b)**2 + (x.c - y.c)**2 + (x.d - y.d)**2, y.id) AS r FROM v x JOIN v y ON x.id <> y.id)
SELECT DISTINCT least(q, o) AS abalone_id_a, greatest(q, o) AS abalone_id_b FROM near WHERE r <= 5""",
        "p4_groups": _groups_sql("news_id", r"SELECT news_id, any_value(list_transform(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(body, ''), '[\p{L}\p{N}]+'), lambda x: lower(x))) AS w FROM reuters GROUP BY news_id", 3, 20, 0.5),
        "p4_document_groups": _groups_sql("doc_id", r"SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents", 5, 0, 0.8),
        "p6_neighbours": f"""
WITH v AS (SELECT DISTINCT abalone_id AS id, length AS a, diameter AS b, whole_weight AS c, shell_weight AS d FROM abalone WHERE {_VALID}),
near AS (SELECT x.id AS q, y.id AS o, (x.a - y.a)**2 + (x.b - y.b)**2 + (x.c - y.c)**2 + (x.d - y.d)**2 AS d2 FROM v x JOIN v y ON x.id <> y.id)
SELECT q AS id, o AS neighbour, sqrt(d2) AS distance, CAST(row_number() OVER (PARTITION BY q ORDER BY d2, o) AS INTEGER) AS rank FROM near QUALIFY rank <= 5""",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_found": _LEAKS,
        "p9_found": _LOOKS + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM seen a JOIN seen b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p9_classes": _LOOKS + ", c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_spellings FROM seen GROUP BY form) SELECT doc_id, class_id, n_spellings FROM seen JOIN c USING (form)",
    }
