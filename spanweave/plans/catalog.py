"""Queries of the core operators over whole tables and, where SQL can express them, their SQL side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import classify, encode, evaluate, graph, impute, inference, splits, textfeatures
from spanweave.operators.components import connected_components
from spanweave.operators.graph import Graph
from spanweave.plans import experiment
from spanweave.session import materialize
from spanweave.sources import corpora, files, reports, tables, tabular

K, ROUNDS = 3, 10
UNLABELLED = 0.7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return experiment.embedding_rows(spark, d)


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_splits(_emb(spark, d), "id", "y", UNLABELLED)


def _hidden(spark: SparkSession, d: str) -> DataFrame:
    return experiment.hide_labels(_emb(spark, d), _split(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.number_vertices(_hidden(spark, d), "id", "features", "label")


def _built(spark: SparkSession, d: str, graph_type: str = "knn", metric: str = "euclidean") -> tuple[DataFrame, Graph]:
    nodes = _nodes(spark, d)
    return nodes, graph.build_graph(nodes, graph_type, metric, K)


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# --- SQL building blocks ---------------------------------------------------------------------------------------------------------------

EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label % 2 AS INTEGER) AS y FROM embeddings)"
SPLIT = """hashed AS (SELECT id, x, y, md5('0:0:' || id) AS h FROM emb),
ranked AS (SELECT id, x, y, row_number() OVER (PARTITION BY y ORDER BY h, id) <= round(CAST(0.7 AS DOUBLE) * count(*) OVER (PARTITION BY y)) AS is_test FROM hashed)"""
NODES = """nodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY is_test, id) - 1 AS vid, id, x, y, CASE WHEN is_test THEN -1 ELSE y END AS label FROM ranked)"""
BASE = f"WITH RECURSIVE {EMB}, {SPLIT}, {NODES}"
METRIC_SQL = {
    "euclidean": "1 / (1 + list_distance(a.x, b.x))",
    "gaussian": "exp(-(1.0 / (len(a.x) * len(a.x))) * list_distance(a.x, b.x) * list_distance(a.x, b.x))",
    "cosine": "list_cosine_similarity(a.x, b.x)",
}


def _pairs_sql(metric: str = "euclidean") -> str:
    return f"w AS MATERIALIZED (SELECT a.vid AS u, b.vid AS v, a.label AS lu, b.label AS lv, {METRIC_SQL[metric]} AS w FROM nodes a JOIN nodes b ON a.vid <> b.vid)"


INFLUENCE = """infl AS (SELECT u AS vid, round(sum(CASE WHEN lv = 1 THEN w ELSE 0 END), 9) AS pos_weight, round(sum(CASE WHEN lv = 0 THEN w ELSE 0 END), 9) AS neg_weight FROM w WHERE lu < 0 GROUP BY u),
influence AS (SELECT n.vid, i.pos_weight, i.neg_weight, CAST(CASE WHEN n.label >= 0 THEN -1 WHEN i.pos_weight > i.neg_weight THEN 1 ELSE 0 END AS INTEGER) AS influence FROM nodes n LEFT JOIN infl i USING (vid))"""
KNN = f"""top AS (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM w),
lab AS (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM w WHERE lv >= 0),
knn AS MATERIALIZED (SELECT least(u, v) AS src, greatest(u, v) AS dst, max(w) AS weight FROM (SELECT u, v, w FROM top WHERE r <= {K} UNION ALL SELECT u, v, w FROM lab WHERE r = 1) WHERE w > 0 GROUP BY ALL)"""
DIRECTED = """directed AS MATERIALIZED (SELECT src, dst, weight, label FROM (SELECT src, dst, weight FROM knn UNION ALL SELECT dst, src, weight FROM knn) JOIN nodes ON vid = src)"""


def _flood_sql(rounds: int, normalize: bool) -> str:
    parts = [DIRECTED, "m0 AS (SELECT src, dst, 0.0::DOUBLE AS m_neg, 0.0::DOUBLE AS m_pos FROM directed)"]
    top = "greatest(x_neg, x_pos)" if normalize else "0"
    for r in range(1, rounds + 1):
        p = f"m{r - 1}"
        parts.append(f"""m{r} AS MATERIALIZED (SELECT src, dst, round(x_neg - {top}, 9) AS m_neg, round(x_pos - {top}, 9) AS m_pos FROM (
SELECT d.src, d.dst, CASE d.label WHEN 0 THEN n_neg WHEN 1 THEN n_pos - 4 * d.weight ELSE greatest(n_neg, n_pos - 4 * d.weight) END AS x_neg,
CASE d.label WHEN 0 THEN n_neg - 4 * d.weight WHEN 1 THEN n_pos ELSE greatest(n_neg - 4 * d.weight, n_pos) END AS x_pos
FROM (SELECT d.*, t.a - m.m_neg AS n_neg, t.b - m.m_pos AS n_pos FROM directed d JOIN (SELECT dst, sum(m_neg) AS a, sum(m_pos) AS b FROM {p} GROUP BY dst) t ON t.dst = d.src JOIN {p} m ON m.src = d.dst AND m.dst = d.src) d))""")
    return ", ".join(parts)


def _boruvka_sql(source: str, rounds: int = 10, jumps: int = 10) -> str:
    """Maximum spanning forest of ``source(src, dst, weight)`` as ``forest``: rounds of best edges and pointer jumping, written out."""
    parts = ["c0 AS (SELECT vid, vid AS c FROM nodes)"]
    for r in range(rounds):
        parts.append(f"""e{r} AS MATERIALIZED (SELECT e.src, e.dst, e.weight, a.c AS a, b.c AS b FROM {source} e JOIN c{r} a ON a.vid = e.src JOIN c{r} b ON b.vid = e.dst WHERE a.c <> b.c),
best{r} AS MATERIALIZED (SELECT * FROM (SELECT a AS c, b AS d, src, dst, weight FROM e{r} UNION ALL SELECT b, a, src, dst, weight FROM e{r}) QUALIFY row_number() OVER (PARTITION BY c ORDER BY weight DESC, src, dst) = 1),
p{r}_0 AS (SELECT x.c, CASE WHEN y.d = x.c AND x.c < x.d THEN x.c ELSE x.d END AS p FROM best{r} x JOIN best{r} y ON y.c = x.d)""")
        for j in range(jumps):
            parts.append(f"p{r}_{j + 1} AS MATERIALIZED (SELECT x.c, y.p FROM p{r}_{j} x JOIN p{r}_{j} y ON y.c = x.p)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT vid, coalesce(p, x.c) AS c FROM c{r} x LEFT JOIN p{r}_{jumps} y ON y.c = x.c)")
    union = " UNION ".join(f"SELECT src, dst, weight FROM best{r}" for r in range(rounds))
    return ", ".join(parts) + f", forest AS ({union})"


# --- tabular sources and preparation ---------------------------------------------------------------------------------------------------

_ABALONE = f"""WITH a AS (SELECT DISTINCT abalone_id, upper(trim(sex)) AS s, {", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in tables.ABALONE_MEASURES)}, rings FROM abalone WHERE rings BETWEEN 5 AND 15),
prepared AS (SELECT abalone_id, CAST(CASE s WHEN 'I' THEN 0 WHEN 'M' THEN 1 WHEN 'F' THEN 2 END AS INTEGER) AS sex, {", ".join(tables.ABALONE_MEASURES)}, rings FROM a)"""


@query(_ABALONE + " SELECT * FROM prepared")
def abalone_prepare(spark, d):
    return tables.abalone(spark, d)


@query(_ABALONE + " SELECT abalone_id, CAST(rings IN (5, 6, 7, 8, 9) AS INTEGER) AS y FROM prepared")
def abalone_labels(spark, d):
    return tables.abalone(spark, d).select("abalone_id", tabular.in_labels(F.col("rings"), tables.YOUNG_RINGS).alias("y"))


_MF = tables.MUSHROOM_FEATURES
_MUSHROOM = f"""WITH m AS (SELECT DISTINCT mushroom_id, CASE lower(trim(class_code)) WHEN 'p' THEN 0 WHEN 'e' THEN 1 END AS y, {", ".join(f"lower(trim({c})) AS {c}" for c in _MF)} FROM mushroom),
k AS (SELECT * FROM m WHERE y IS NOT NULL), long AS (UNPIVOT k ON {", ".join(_MF)} INTO NAME feature VALUE value)"""


@query(_MUSHROOM + " SELECT mushroom_id, CAST(y AS INTEGER) AS y, " + ", ".join(_MF) + " FROM k")
def mushroom_prepare(spark, d):
    return tables.mushroom(spark, d).select("mushroom_id", "y", *_MF)


@query(_MUSHROOM + " SELECT feature, value, y::INTEGER AS y, count(*) AS n FROM long GROUP BY ALL")
def value_class_sizes(spark, d):
    return encode.unpivot(tables.mushroom(spark, d), "mushroom_id", _MF, "y").where("value is not null").groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("n"))


@query(_MUSHROOM + " SELECT feature, value, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(sum(y) / count(*), 6) AS encoded FROM long GROUP BY ALL")
def target_means(spark, d):
    return encode.fit_target_means(tables.mushroom(spark, d), _MF, "y").withColumn("encoded", F.round("encoded", 6))


_ENCODED = (
    _MUSHROOM
    + """, s AS (SELECT mushroom_id, row_number() OVER (PARTITION BY y ORDER BY md5('0:0:' || mushroom_id), mushroom_id) <= round(CAST(0.3 AS DOUBLE) * count(*) OVER (PARTITION BY y)) AS is_test FROM k),
means AS (SELECT feature, value, sum(y) / count(*) AS e FROM long JOIN s USING (mushroom_id) WHERE NOT is_test GROUP BY ALL),
cells AS (SELECT mushroom_id, f.feature FROM k CROSS JOIN (SELECT unnest([{names}]) AS feature) f)
SELECT c.mushroom_id, c.feature, round(coalesce(m.e, 0), 6) AS encoded FROM cells c JOIN s USING (mushroom_id)
LEFT JOIN long l ON l.mushroom_id = c.mushroom_id AND l.feature = c.feature LEFT JOIN means m ON m.feature = c.feature AND m.value = l.value WHERE {side}"""
)


def _encoded(spark, d, test: bool):
    rows = materialize(tables.mushroom(spark, d))
    split = splits.stratified_splits(rows, "mushroom_id", "y", 0.3)
    means = encode.fit_target_means(splits.take(rows, split, "mushroom_id", False), _MF, "y")
    return encode.apply_target_means(splits.take(rows, split, "mushroom_id", test), "mushroom_id", _MF, means).withColumn("encoded", F.round("encoded", 6))


@query(_ENCODED.replace("{names}", ", ".join(f"'{c}'" for c in _MF)).replace("{side}", "NOT is_test"))
def target_encode_train(spark, d):
    return _encoded(spark, d, False)


@query(_ENCODED.replace("{names}", ", ".join(f"'{c}'" for c in _MF)).replace("{side}", "is_test"))
def target_encode_test(spark, d):
    return _encoded(spark, d, True)


@query("""WITH a AS (SELECT DISTINCT call_id, CASE lower(trim(family)) WHEN 'leptodactylidae' THEN 1 WHEN 'hylidae' THEN 0 WHEN 'dendrobatidae' THEN 0 WHEN 'bufonidae' THEN 0 END AS y, """ + ", ".join(f"round({c}, 6) AS {c}" for c in tables.COEFFICIENTS) + """ FROM anuran_calls)
SELECT call_id, """ + ", ".join(tables.COEFFICIENTS) + ", CAST(y AS INTEGER) AS y FROM a WHERE y IS NOT NULL")  # fmt: skip
def anuran_prepare(spark, d):
    return tables.anuran(spark, d).select("call_id", *[_r(c) for c in tables.COEFFICIENTS], "y")


@query("SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS y FROM embeddings")
def parity_label(spark, d):
    return _emb(spark, d).select("id", "y")


@query("SELECT vec_id AS id, CAST(label IN (1, 3, 5, 42) AS INTEGER) AS y FROM embeddings")
def binary_label_isin(spark, d):
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), tabular.in_labels(F.col("label"), [1, 3, 5, 42]).alias("y"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_project(spark, d):
    return tables.read(spark, d, "customer").drop("c_name", "c_mktsegment")


@query("SELECT CAST(label % 2 AS INTEGER) AS y, count(*) AS n FROM embeddings GROUP BY ALL")
def class_distribution(spark, d):
    return _emb(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


# --- splits, union, filling (core problem 5) -------------------------------------------------------------------------------------------


@query(f"WITH {EMB}, {SPLIT} SELECT id, y, is_test FROM ranked")
def stratified_split(spark, d):
    return _split(spark, d).select("id", "y", "is_test")


@query(f"""WITH {EMB}, h AS (SELECT fold, id, y, md5('0:' || fold || ':' || id) AS h FROM emb CROSS JOIN (SELECT unnest(range(5)) AS fold))
SELECT CAST(fold AS INTEGER) AS fold, id, y, row_number() OVER (PARTITION BY fold, y ORDER BY h, id) <= round(CAST(0.7 AS DOUBLE) * count(*) OVER (PARTITION BY fold, y)) AS is_test FROM h""")
def stratified_split_5fold(spark, d):
    return splits.stratified_splits(_emb(spark, d), "id", "y", UNLABELLED, 5)


@query(f"""WITH {EMB}, h AS (SELECT CAST(fold AS INTEGER) AS fold, id, y, md5('0:' || fold || ':' || id) AS h FROM emb CROSS JOIN (SELECT unnest(range(5)) AS fold)),
o AS (SELECT fold, id, y, row_number() OVER (PARTITION BY fold, y ORDER BY h, id) <= round(CAST(0.3 AS DOUBLE) * count(*) OVER (PARTITION BY fold, y)) AS t FROM h),
i AS (SELECT o.*, CAST(g AS INTEGER) AS g, md5('1:' || fold || '.' || g || ':' || id) AS h2 FROM o CROSS JOIN (SELECT unnest(range(5)) AS g)),
j AS (SELECT fold, g, id, y, row_number() OVER (PARTITION BY fold, g, y ORDER BY h2, id) <= round(CAST(0.7 AS DOUBLE) * count(*) OVER (PARTITION BY fold, g, y)) AS u FROM i WHERE NOT t)
SELECT fold, g AS "inner", id, y, CASE WHEN u THEN 'unlabelled' ELSE 'labelled' END AS role FROM j UNION ALL SELECT fold, g, id, y, 'test' FROM i WHERE t""")
def nested_split(spark, d):
    return splits.nested_splits(_emb(spark, d), "id", "y", 0.3, 0.7, 5)


@query(BASE + " SELECT vid, id, CAST(label AS INTEGER) AS label FROM nodes")
def labelled_unlabelled_union(spark, d):
    hidden = _hidden(spark, d)
    both = graph.union_labelled(hidden.where("label >= 0"), hidden.where("label < 0"))
    return graph.number_vertices(both, "id", "features", "label").select("vid", "id", "label")


def _p5(spark, d):
    codes = impute.code_tables(tables.read(spark, d, "mushroom_codes"))
    rows = tables.read(spark, d, "mushroom")
    return rows, "mushroom_id", ["stalk_root", "odor"], [c for c in rows.columns if c in codes and c not in ("stalk_root", "odor")], codes, "lot_id", "collected_at"


@query(r"""SELECT DISTINCT mushroom_id, f AS field_name FROM (SELECT mushroom_id, 'stalk_root' AS f, stalk_root AS v FROM mushroom UNION ALL SELECT mushroom_id, 'odor', odor FROM mushroom)
WHERE v IS NULL OR NOT EXISTS (SELECT 1 FROM mushroom_codes c WHERE c.field_name = f AND (lower(c.code) = lower(regexp_replace(v, '^\s+|\s+$', '', 'g')) OR lower(c.meaning) = lower(regexp_replace(v, '^\s+|\s+$', '', 'g'))))""")
def p5_found(spark, d):
    """The missing values as the donor search leaves them: each has a donor, or the mark that nobody has one."""
    log = impute.fill_log(*_p5(spark, d))
    settled = F.when(F.col("donor_id").isNotNull(), F.col("value").isNotNull() & F.col("distance").isNotNull()).otherwise(F.col("donor_group").isNull())
    return log.where(settled).select(F.col("id").alias("mushroom_id"), F.col("field").alias("field_name"))


_P5_SQL = r"""WITH m AS (SELECT mushroom_id, any_value(CAST(lot_id AS VARCHAR)) AS lot, any_value(CAST(collected_at AS DATE)) AS day, any_value(stalk_root) AS stalk_root, any_value(odor) AS odor FROM mushroom GROUP BY mushroom_id),
cell AS (SELECT mushroom_id, lot, day, f, regexp_replace(lower(v), '^\s+|\s+$', '', 'g') AS v FROM (SELECT *, 'stalk_root' AS f, stalk_root AS v FROM m UNION ALL SELECT *, 'odor', odor FROM m)),
code AS (SELECT field_name AS f, lower(trim(code)) AS k, code FROM mushroom_codes UNION SELECT field_name, lower(trim(meaning)), code FROM mushroom_codes WHERE meaning IS NOT NULL),
seen AS MATERIALIZED (SELECT mushroom_id, lot, day, c.f, code FROM cell c LEFT JOIN code k ON k.f = c.f AND k.k = c.v)
"""


@query(_P5_SQL + """SELECT mushroom_id, f AS field_name, CASE WHEN lot IN (SELECT lot FROM seen s WHERE s.f = seen.f AND s.code IS NOT NULL AND lot IS NOT NULL) THEN 'group'
WHEN day IN (SELECT day FROM seen s WHERE s.f = seen.f AND s.code IS NOT NULL AND day IS NOT NULL) THEN 'day' WHEN EXISTS (SELECT 1 FROM seen s WHERE s.f = seen.f AND s.code IS NOT NULL) THEN 'all' END AS donor_group, true AS sound FROM seen WHERE code IS NULL""")
def p5_donors(spark, d):
    """Where each donor was found, and whether it really is of that lot or day and has the value it gives."""
    log = materialize(impute.fill_log(*_p5(spark, d)))
    codes = impute.code_tables(tables.read(spark, d, "mushroom_codes"))
    rows = tables.read(spark, d, "mushroom").select("mushroom_id", "lot_id", F.to_date("collected_at").alias("day"), *[impute.canonical_code(f, codes[f]).alias(f) for f in ("stalk_root", "odor")]).dropDuplicates(["mushroom_id"])
    given = rows.select(F.col("mushroom_id").alias("donor_id"), F.col("lot_id").alias("from_lot"), F.col("day").alias("from_day"), F.col("stalk_root").alias("gives_stalk_root"), F.col("odor").alias("gives_odor"))
    near = log.join(given, "donor_id", "left").join(rows.select(F.col("mushroom_id").alias("id"), "lot_id", "day"), "id")
    gives = F.when(F.col("field") == "odor", F.col("gives_odor")).otherwise(F.col("gives_stalk_root"))
    place = F.when(F.col("donor_group") == "group", F.col("from_lot") == F.col("lot_id")).when(F.col("donor_group") == "day", F.col("from_day") == F.col("day")).otherwise(True)
    sound = F.when(F.col("donor_id").isNull(), F.col("value").isNull()).otherwise(F.coalesce(place & (gives == F.col("value")), F.lit(False)))
    return near.select(F.col("id").alias("mushroom_id"), F.col("field").alias("field_name"), "donor_group", sound.alias("sound"))


@query()
def p5_log(spark, d):
    return impute.fill_log(*_p5(spark, d))


@query()
def p5_filled(spark, d):
    return impute.fill_missing(*_p5(spark, d))


@query(_P5_SQL + """SELECT mushroom_id, max(code) FILTER (f = 'stalk_root') AS stalk_root, max(code) FILTER (f = 'odor') AS odor, bool_or(f = 'stalk_root' AND code IS NULL) AS stalk_root_filled, bool_or(f = 'odor' AND code IS NULL) AS odor_filled FROM seen GROUP BY mushroom_id""")
def p5_marks(spark, d):
    """The filled table without its fills: observed values are unchanged, every other one is marked."""
    out = impute.fill_missing(*_p5(spark, d))
    return out.select("mushroom_id", *[F.when(~F.col(f"{f}_filled"), F.col(f)).alias(f) for f in ("stalk_root", "odor")], "stalk_root_filled", "odor_filled")


# --- graphs ----------------------------------------------------------------------------------------------------------------------------


def _sim(metric):
    sql = f"{BASE}, {_pairs_sql(metric)} SELECT u AS src, v AS dst, round(w, 6) AS weight FROM w WHERE u < v"

    def run(spark, d):
        return graph.pairwise_weights(_nodes(spark, d), metric, positive=False).withColumn("weight", F.round("weight", 6))

    run.__name__ = f"sim_{metric}"
    query(sql)(run)


def _infl(metric):
    sql = f"{BASE}, {_pairs_sql(metric)}, {INFLUENCE} SELECT vid, round(pos_weight, 6) AS pos_weight, round(neg_weight, 6) AS neg_weight, influence FROM influence"

    def run(spark, d):
        return graph.influence(_nodes(spark, d), metric).select("vid", _r("pos_weight"), _r("neg_weight"), "influence")

    run.__name__ = f"influence_{metric}"
    query(sql)(run)


for _m in METRIC_SQL:
    _sim(_m)
    _infl(_m)


@query(f"{BASE}, {_pairs_sql('cosine')} SELECT u AS src, v AS dst, round(w, 6) AS weight FROM w WHERE u < v AND w > 0")
def positive_edges(spark, d):
    return graph.pairwise_weights(_nodes(spark, d), "cosine").withColumn("weight", F.round("weight", 6))


@query(f"{BASE}, {_pairs_sql()}, {KNN} SELECT u AS src, v AS dst, round(w, 6) AS weight, CAST(r AS INTEGER) AS rank FROM top WHERE r <= {K}")
def knn_topk(spark, d):
    return graph.neighbour_candidates(_nodes(spark, d), k=K).where(F.col("rank") <= K).select("src", "dst", _r("weight"), "rank")


@query(f"{BASE}, {_pairs_sql()}, {KNN} SELECT u AS src, v AS dst, round(w, 6) AS weight FROM lab WHERE r = 1")
def knn_top1_labelled(spark, d):
    return graph.neighbour_candidates(_nodes(spark, d), k=K).where("labelled_rank = 1").select("src", "dst", _r("weight"))


@query(f"{BASE}, {_pairs_sql()}, {KNN} SELECT src, dst, round(weight, 6) AS weight FROM knn")
def knn_graph(spark, d):
    return graph.knn_graph(_nodes(spark, d), k=K).withColumn("weight", F.round("weight", 6))


@query(f"{BASE}, {_pairs_sql()}, {KNN} SELECT vid, count(*) AS degree, round(sum(weight), 6) AS strength FROM (SELECT src AS vid, weight FROM knn UNION ALL SELECT dst, weight FROM knn) GROUP BY vid")
def degree_distribution(spark, d):
    return graph.degrees(graph.knn_graph(_nodes(spark, d), k=K)).withColumn("strength", F.round("strength", 6))


@query(f"{BASE}, {_pairs_sql()}, full_edges AS (SELECT u AS src, v AS dst, w AS weight FROM w WHERE u < v AND w > 0), {_boruvka_sql('full_edges')} SELECT src, dst, round(weight, 6) AS weight FROM forest")
def mst_graph(spark, d):
    return graph.mst_graph(_nodes(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"{BASE}, {_pairs_sql()}, {KNN}, {_boruvka_sql('knn')} SELECT src, dst, round(weight, 6) AS weight FROM forest")
def knn_mst_graph(spark, d):
    return graph.knn_mst_graph(_nodes(spark, d), k=K).withColumn("weight", F.round("weight", 6))


@query(f"""{BASE}, {_pairs_sql()}, {KNN}, reach(v, r) AS (SELECT src, src FROM knn UNION SELECT dst, dst FROM knn UNION SELECT e.b, reach.r FROM reach JOIN (SELECT src AS a, dst AS b FROM knn UNION ALL SELECT dst, src FROM knn) e ON e.a = reach.v)
SELECT v AS node, min(r) AS component FROM reach GROUP BY v""")
def knn_components(spark, d):
    return connected_components(graph.knn_graph(_nodes(spark, d), k=K).select("src", "dst"))


# --- inference -------------------------------------------------------------------------------------------------------------------------


@query(f"{BASE}, {_pairs_sql()}, {KNN} SELECT src, dst, CAST(r AS INTEGER) AS receiver, round(CASE WHEN r = 0 THEN 0 ELSE -4 * weight END, 6) AS f_neg, round(CASE WHEN r = 0 THEN -4 * weight ELSE 0 END, 6) AS f_pos FROM knn CROSS JOIN (SELECT unnest([0, 1]) AS r)")
def factor_table(spark, d):
    e = graph.knn_graph(_nodes(spark, d), k=K).withColumn("receiver", F.explode(F.array(F.lit(0), F.lit(1))))
    neg, pos = inference.factor(F.col("weight"), F.col("receiver"))
    return e.select("src", "dst", "receiver", F.round(neg, 6).alias("f_neg"), F.round(pos, 6).alias("f_pos"))


def _flood_query(name: str, rounds: int):
    sql = f"{BASE}, {_pairs_sql()}, {KNN}, {_flood_sql(rounds, False)} SELECT src, dst, round(m_neg, 6) AS m_neg, round(m_pos, 6) AS m_pos FROM m{rounds}"

    def run(spark, d):
        messages = inference.flood(_built(spark, d)[1], rounds, normalize=False)
        return messages.select("src", "dst", _r("m_neg"), _r("m_pos"))

    run.__name__ = name
    query(sql)(run)


_flood_query("flood_round1", 1)
_flood_query("flood_round2", 2)
_flood_query("flood_raw_5_rounds", 5)
_BELIEFS = f"{BASE}, {_pairs_sql()}, {KNN}, {INFLUENCE}, {_flood_sql(ROUNDS, True)}, beliefs AS (SELECT dst AS vid, round(sum(m_neg), 6) AS b_neg, round(sum(m_pos), 6) AS b_pos FROM m{ROUNDS} GROUP BY dst)"


@query(_BELIEFS + " SELECT * FROM beliefs")
def flood_beliefs(spark, d):
    return inference.beliefs(inference.flood(_built(spark, d)[1], ROUNDS)).select("vid", _r("b_neg"), _r("b_pos"))


@query(_BELIEFS + """ SELECT n.vid, n.id, CAST(n.y AS INTEGER) AS y, CAST(CASE WHEN b_pos > b_neg THEN 1 WHEN b_neg > b_pos THEN 0 ELSE influence END AS INTEGER) AS predicted
FROM nodes n JOIN influence USING (vid) LEFT JOIN beliefs USING (vid) WHERE n.label < 0""")
def flood_labels(spark, d):
    """The flagship: rows to graph to labels of the unlabelled rows."""
    nodes, g = _built(spark, d)
    labels = inference.loop_labels(g, inference.flood(g, ROUNDS), digits=6)
    return nodes.select("vid", "id").join(inference.unlabelled_predictions(g, labels), "vid").join(_emb(spark, d).select("id", "y"), "id").select("vid", "id", "y", "predicted")


def _tree_sql(source: str) -> str:
    """Labels and messages of the forest ``source``, level by level: components, breadth-first down, messages up, labels down."""
    far = "4 * v.w"
    n_neg, n_pos = "coalesce(i.neg, 0)", "coalesce(i.pos, 0)"

    def choose(a: str, b: str) -> str:
        return f"CASE WHEN v.label >= 0 THEN v.label WHEN {a} = {b} THEN v.influence WHEN {b} > {a} THEN 1 ELSE 0 END"

    sent = f"""SELECT vid, component, parent, depth, label, CASE WHEN t_neg = 0 THEN n_neg ELSE n_pos - 4 * w END AS m_neg, CASE WHEN t_pos = 0 THEN n_neg - 4 * w ELSE n_pos END AS m_pos, t_neg, t_pos FROM (
SELECT v.*, {n_neg} AS n_neg, {n_pos} AS n_pos, {choose(n_neg, f"{n_pos} - {far}")} AS t_neg, {choose(f"{n_neg} - {far}", n_pos)} AS t_pos FROM bfs v LEFT JOIN {{inner}} i ON i.parent = v.vid WHERE v.depth = {{depth}}) x"""
    return f"""ways AS MATERIALIZED (SELECT src AS a, dst AS b, weight AS w FROM {source} UNION ALL SELECT dst, src, weight FROM {source}),
cc(vid, c) USING KEY (vid) AS (SELECT vid, vid FROM nodes UNION (SELECT e.b, min(cc.c) FROM cc JOIN ways e ON e.a = cc.vid JOIN recurring.cc AS r ON r.vid = e.b WHERE cc.c < r.c GROUP BY e.b)),
down(vid, component, parent, w, depth) AS (SELECT vid, c, vid, 0.0::DOUBLE, 0 FROM cc WHERE vid = c UNION ALL SELECT e.b, d.component, d.vid, e.w, d.depth + 1 FROM down d JOIN ways e ON e.a = d.vid WHERE e.b <> d.parent),
bfs AS MATERIALIZED (SELECT d.*, n.label, i.influence FROM down d JOIN nodes n USING (vid) JOIN influence i USING (vid)),
up AS ({sent.format(inner="(SELECT NULL::BIGINT AS parent, 0.0::DOUBLE AS neg, 0.0::DOUBLE AS pos)", depth="(SELECT max(depth) FROM bfs)")}
UNION ALL {sent.format(inner="(SELECT parent, sum(m_neg) AS neg, sum(m_pos) AS pos FROM up GROUP BY parent)", depth="(SELECT min(depth) FROM up) - 1")}),
told(vid, depth, label) AS (SELECT vid, depth, CASE WHEN label >= 0 THEN label ELSE t_neg END FROM up WHERE depth = 0
UNION ALL SELECT u.vid, u.depth, CASE WHEN u.label >= 0 THEN u.label WHEN t.label = 0 THEN u.t_neg ELSE u.t_pos END FROM told t JOIN up u ON u.parent = t.vid AND u.depth = t.depth + 1)"""


_WHOLE = f"{BASE}, {_pairs_sql()}, {INFLUENCE}, full_edges AS (SELECT u AS src, v AS dst, w AS weight FROM w WHERE u < v AND w > 0), {_boruvka_sql('full_edges')}"


@query(f"{_WHOLE}, {_tree_sql('forest')} SELECT vid, component, parent, u.depth, round(m_neg, 6) AS m_neg, round(m_pos, 6) AS m_pos, t_neg, t_pos, CAST(t.label AS INTEGER) AS label FROM up u JOIN told t USING (vid)")
def tree_messages(spark, d):
    _, g = _built(spark, d, "mst")
    return inference.tree_inference(g).select("vid", "component", "parent", "depth", _r("m_neg"), _r("m_pos"), "t_neg", "t_pos", "label")


@query(f"{_WHOLE}, {_tree_sql('forest')} SELECT vid, CAST(label AS INTEGER) AS label FROM told")
def flood_faithful_labels(spark, d):
    """The loop model with all its rounds; on a tree it is exact, so the tree's labels are its own."""
    _, g = _built(spark, d, "mst")
    return inference.infer(g, "graphical_loop")


@query()
def flood_loop_labels(spark, d):
    """The same on a graph with cycles."""
    return inference.infer(_built(spark, d)[1], "graphical_loop")


@query(f"{BASE}, {_pairs_sql()}, {INFLUENCE}, {KNN}, {_boruvka_sql('knn')}, {_tree_sql('forest')} SELECT vid, CAST(label AS INTEGER) AS label FROM told")
def tree_labels(spark, d):
    _, g = _built(spark, d, "knn_mst")
    return inference.infer(g, "graphical_tree")


@query(f"""{BASE}, {_pairs_sql()}, {KNN}, ends AS (SELECT src AS vid, dst AS o, weight FROM knn UNION ALL SELECT dst, src, weight FROM knn)
SELECT n.vid, round(coalesce(sum(CASE WHEN l.label = 1 THEN weight END), 0), 6) AS c_pos, round(coalesce(sum(CASE WHEN l.label = 0 THEN weight END), 0), 6) AS c_neg
FROM nodes n LEFT JOIN ends e ON e.vid = n.vid LEFT JOIN nodes l ON l.vid = e.o WHERE n.label < 0 GROUP BY n.vid""")
def terminal_capacities(spark, d):
    _, g = _built(spark, d)
    return inference.terminal_capacities(g.vertices, g.edges).select("vid", _r("c_pos"), _r("c_neg"))


@query()
def mincut_labels(spark, d):
    return inference.mincut_labels(_built(spark, d)[1])


@query()
def mincut_value(spark, d):
    _, g = _built(spark, d)
    return inference.cut_value(g.edges, inference.mincut_labels(g)).select(_r("value"))


@query(f"{BASE} SELECT count(*) FILTER (label >= 0) AS labelled_kept, 0::BIGINT AS improvable, true AS cut_is_flow FROM nodes")
def mincut_checks(spark, d):
    """A minimum cut keeps the labelled vertices, no single other vertex improves it, and its value is that of the largest flow."""
    _, g = _built(spark, d)
    labels = materialize(inference.mincut_labels(g))
    known = g.vertices.where("label >= 0").select("vid", F.col("label").alias("was"))
    kept = labels.join(known, "vid").where("was = label").agg(F.count(F.lit(1)).alias("n"))
    at = graph.both_directions(g.edges).join(labels.select(F.col("vid").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("vid").alias("dst"), F.col("label").alias("y")), "dst")
    flip = at.groupBy("src").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(-F.col("weight"))).alias("gain"))
    worse = flip.join(known.withColumnRenamed("vid", "src"), "src", "left_anti").where("gain < -1e-9").agg(F.count(F.lit(1)).alias("n"))
    parts = [(kept, "n"), (worse, "n"), (inference.cut_value(g.edges, labels), "value"), (inference.flow_value(g), "flow")]
    rows = reduce(DataFrame.union, [df.select(F.lit(i).alias("part"), F.col(c).cast("double").alias("v")) for i, (df, c) in enumerate(parts)])
    of = lambda i: F.max(F.when(F.col("part") == i, F.col("v")))
    return rows.agg(of(0).cast("long").alias("labelled_kept"), of(1).cast("long").alias("improvable"), (F.abs(of(2) - of(3)) < 1e-6).alias("cut_is_flow"))


_U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""{BASE}, {_pairs_sql()}, {KNN}, r AS (SELECT CAST(rep AS INTEGER) AS rep, src, dst, weight FROM knn CROSS JOIN (SELECT unnest(range(5)) AS rep))
SELECT rep, src, dst, round(CASE WHEN rep > 0 AND {_U.format("'0:hit:' || rep || ':' || src || ':' || dst")} < 0.3 THEN greatest(weight - 0.6 + {_U.format("'0:by:' || rep || ':' || src || ':' || dst")}, 0) ELSE weight END, 6) AS weight FROM r""")
def noisy_edges(spark, d):
    return inference.noisy_edges(graph.knn_graph(_nodes(spark, d), k=K)).withColumn("weight", F.round("weight", 6))


@query()
def randomized_mincut_vote(spark, d):
    return inference.randomized_mincut(_built(spark, d)[1])


# --- text ------------------------------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in textfeatures.STOP_WORDS)
_DOCS = """WITH story AS (SELECT news_id, any_value(coalesce(title, '') || chr(10) || chr(10) || coalesce(body, '')) AS text, any_value(topics) AS topics FROM reuters GROUP BY news_id HAVING len(any_value(topics)) > 0),
y AS (SELECT news_id, CAST(list_contains(topics, 'acq') AS INTEGER) AS y FROM story)"""
_TF = _DOCS + f""", tok AS (SELECT news_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS term FROM story),
tf AS MATERIALIZED (SELECT news_id, term, count(*) AS n FROM tok WHERE term NOT IN ({_STOP}) GROUP BY ALL),
docs AS (SELECT count(*) AS d FROM story), idf AS (SELECT term, count(*) AS df, ln((1 + any_value(d))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf CROSS JOIN docs GROUP BY term)"""
_TFIDF = _TF + ", v AS (SELECT news_id, term, n * idf AS v FROM tf JOIN idf USING (term)), tfidf AS (SELECT news_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY news_id)) AS value FROM v)"
_MI = _TF + """, size AS (SELECT y, count(*) AS c FROM y GROUP BY y), total AS (SELECT (SELECT d FROM docs) * (SELECT count(*) FROM idf) AS t),
nz AS (SELECT term, n, y, count(*) AS c FROM tf JOIN y USING (news_id) GROUP BY ALL),
z AS (SELECT i.term, 0 AS n, s.y, s.c - coalesce((SELECT sum(c) FROM nz WHERE nz.term = i.term AND nz.y = s.y), 0) AS c FROM idf i CROSS JOIN size s),
cells AS (SELECT * FROM nz UNION ALL SELECT * FROM z WHERE c > 0),
p AS (SELECT term, c::DOUBLE / t AS pxy, sum(c::DOUBLE / t) OVER (PARTITION BY term, n) AS px, (SELECT s.c::DOUBLE / d FROM size s, docs WHERE s.y = cells.y) AS py FROM cells CROSS JOIN total),
score AS (SELECT term, round(sum(pxy * ln((pxy + 1) / (px * py + 1))), 12) AS score FROM p GROUP BY term)"""


def _stories(spark, d):
    return tables.stories(spark, d)


def _tf(spark, d):
    return textfeatures.term_counts(_stories(spark, d), "news_id", F.col("text"), stop_words=textfeatures.STOP_WORDS, alphabet="ascii")


@query(_DOCS + " SELECT news_id, text, y FROM story JOIN y USING (news_id)")
def topic_batch(spark, d):
    return _stories(spark, d)


@query(r"""SELECT news_id, any_value(coalesce(title, '')) AS title, any_value(regexp_replace(regexp_replace(coalesce(body, ''), '&(lt|gt|amp|quot);', '&\1;', 'g'), '\s+', ' ', 'g')) AS body, any_value(coalesce(topics, [])) AS topics FROM reuters GROUP BY news_id""")
def sgml_parse(spark, d):
    rows = tables.read(spark, d, "reuters").select("news_id", "title", "body", "topics").dropDuplicates(["news_id"])
    raw = rows.select(F.col("news_id").cast("string").alias("path"), corpora.render_sgml(F.col("title"), F.col("body"), F.col("topics")).alias("content"))
    return corpora.parse_sgml(raw).select(F.col("path").cast("long").alias("news_id"), "title", "body", "topics")


@query(_TF + " SELECT * FROM tf")
def tokenize_count(spark, d):
    return _tf(spark, d)


@query(_TF + " SELECT term, count(*) AS n FROM tok WHERE term IN (" + _STOP + ") GROUP BY term")
def stopword_counts(spark, d):
    tf = textfeatures.term_counts(_stories(spark, d), "news_id", F.col("text"), vocabulary=textfeatures.STOP_WORDS, alphabet="ascii")
    return tf.groupBy("term").agg(F.sum("n").alias("n"))


@query(_TF + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_frequency_idf(spark, d):
    return textfeatures.document_frequency(_tf(spark, d), _stories(spark, d).count()).withColumn("idf", F.round("idf", 6))


@query(_TFIDF + ", s AS (SELECT term, round(sum(value), 12) AS score FROM tfidf GROUP BY term) SELECT CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank, term, round(score, 6) AS score FROM s ORDER BY s.score DESC, term LIMIT 400")
def tfidf_score_top(spark, d):
    scores = textfeatures.tfidf_score(_tf(spark, d), "news_id", _stories(spark, d))
    return textfeatures.top_terms(scores, 400).withColumn("score", F.round("score", 6))


@query(_MI + " SELECT CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank, term, round(score, 9) AS score FROM score ORDER BY score.score DESC, term LIMIT 400")
def mi_score_top(spark, d):
    scores = textfeatures.mutual_information(_tf(spark, d), "news_id", _stories(spark, d))
    return textfeatures.top_terms(scores, 400).withColumn("score", F.round("score", 9))


@query(_TF + " SELECT news_id, term, round(n::DOUBLE / sum(n) OVER (PARTITION BY news_id) * 10000, 6) AS value FROM tf")
def l1_normalize(spark, d):
    return textfeatures.l1_normalize(_tf(spark, d), "news_id").select("news_id", "term", _r("value"))


@query(_TFIDF + " SELECT news_id, term, round(value, 6) AS value FROM tfidf")
def tfidf_l2_normalize(spark, d):
    return textfeatures.tfidf(_tf(spark, d), "news_id", _stories(spark, d).count()).select("news_id", "term", _r("value"))


@query(_TFIDF.replace("idf AS (SELECT term,", "idf_all AS (SELECT term,", 1).replace(", v AS (SELECT news_id, term, n * idf AS v FROM tf JOIN idf USING (term))", """, top AS (SELECT term FROM (SELECT term, round(sum(value), 12) AS score FROM (
  SELECT news_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY news_id)) AS value FROM tf JOIN idf_all USING (term)) GROUP BY term) ORDER BY score DESC, term LIMIT 400),
  idf AS (SELECT * FROM idf_all), v AS (SELECT news_id, term, n * idf AS v FROM tf JOIN idf USING (term) WHERE term IN (SELECT term FROM top))""") + " SELECT news_id, term, round(value, 6) AS value FROM tfidf")
def tfidf_selected_terms(spark, d):
    """Text features as the experiments use them: the 400 best terms only, each document of length 1 over these."""
    rows = _stories(spark, d)
    values, _ = textfeatures.text_features(rows, "news_id", F.col("text"), F.col("y"), scorer="tfidf", features=400, normalizer="tfidf", alphabet="ascii")
    return values.select("news_id", "term", _r("value"))


@query(_TF + ", voc AS (SELECT DISTINCT lower(meaning) AS term FROM mushroom_codes) SELECT news_id, term, count(*) AS n FROM tok WHERE term IN (SELECT term FROM voc) GROUP BY ALL")
def vocabulary_counts(spark, d):
    """A vocabulary file, one word a line, as the table that tokens are joined to."""
    words = tables.read(spark, d, "mushroom_codes").select(F.lower("meaning").alias("term")).distinct()
    path = files.lines(words.orderBy("term").coalesce(1), "vocabulary")  # a code list, of fixed size
    return textfeatures.term_counts(_stories(spark, d), "news_id", F.col("text"), vocabulary=corpora.read_vocabulary(spark, path), alphabet="ascii")


@query(_DOCS + r" SELECT news_id, term, count(*) AS n FROM (SELECT news_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}')) AS term FROM story) GROUP BY ALL")
def tokenize_unicode(spark, d):
    return textfeatures.term_counts(_stories(spark, d), "news_id", F.col("text"))


# --- files -----------------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT CASE WHEN sex IN ('M', 'F', 'I') THEN sex END AS sex, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in tables.ABALONE_MEASURES) + ", rings FROM abalone")
def abalone_file(spark, d):
    """The table as a headerless file, read by the file's source."""
    rows = tables.read(spark, d, "abalone").select(F.when(F.col("sex").isin("M", "F", "I"), F.col("sex")).alias("sex"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in tables.ABALONE_MEASURES], "rings").distinct()
    read = tabular.read_abalone(spark, files.csv(rows, "abalone"))
    return read.toDF("sex", *tables.ABALONE_MEASURES, "rings")


_MC = ["class_code", *[c.replace("-", "_").replace("?", "") for c in tabular.MUSHROOM[1:]]]


@query("SELECT mushroom_id, " + ", ".join(rf"nullif(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '') AS {c}" for c in ("class_code", "odor", "cap_shape")) + ", y FROM (SELECT DISTINCT mushroom_id, class_code, odor, cap_shape, CASE lower(trim(class_code)) WHEN 'p' THEN 0 WHEN 'e' THEN 1 END::INTEGER AS y FROM mushroom)")
def mushroom_file(spark, d):
    """Categories as a headerless file; the id travels in the place of the last one."""
    rows = tables.read(spark, d, "mushroom").select(*[F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("")).alias(c) for c in _MC[:-1]], F.col("mushroom_id").cast("string").alias("id")).distinct()
    read = tabular.read_mushroom(spark, files.csv(rows, "mushroom"))
    y = tabular.map_values(F.col("class"), tabular.CLASS_CODES)
    return read.select(F.col(tabular.MUSHROOM[-1]).cast("long").alias("mushroom_id"), F.col("class").alias("class_code"), "odor", F.col("cap-shape").alias("cap_shape"), y.alias("y"))


@query("SELECT DISTINCT " + ", ".join(f"{c}" for c in tables.COEFFICIENTS) + ", nullif(trim(family), '') AS family, recordid FROM anuran_calls")
def anuran_file(spark, d):
    """Coefficients as a file with a header."""
    rows = tables.read(spark, d, "anuran_calls").select(*tables.COEFFICIENTS, F.nullif(F.trim("family"), F.lit("")).alias("family"), F.lit("g").alias("genus"), F.lit("s").alias("species"), "recordid").distinct()
    read = tabular.read_anuran(spark, files.csv(rows, "anuran", header=True))
    return read.toDF(*tables.COEFFICIENTS, "family", "genus", "species", "recordid").drop("genus", "species")


@query(r"""SELECT news_id, count(*) AS documents, any_value(coalesce(title, '')) AS title FROM (SELECT DISTINCT news_id, regexp_replace(title, '[^\x{20}-\x{7e}]', '?', 'g') AS title FROM reuters) GROUP BY news_id""")
def sgml_files(spark, d):
    """Stories in SGML files, read from a folder in Latin-1; the id is a topic of its own."""
    rows = tables.read(spark, d, "reuters").select("news_id", F.regexp_replace("title", r"[^\x20-\x7e]", "?").alias("title")).dropDuplicates(["news_id"])
    story = corpora.render_sgml(F.col("title"), F.lit("text"), F.array(F.col("news_id").cast("string")))
    read = corpora.read_sgml(spark, files.lines(rows.select(story.alias("value")), "news"), "*.txt")
    return read.groupBy(F.col("topics")[0].cast("long").alias("news_id")).agg(F.count(F.lit(1)).alias("documents"), F.first("title").alias("title"))


# --- evaluation and experiments --------------------------------------------------------------------------------------------------------


def _predicted(spark, d):
    nodes = _nodes(spark, d)
    found = graph.influence(nodes).where("influence >= 0").select("vid", F.col("influence").alias("predicted"))
    return nodes.select("vid", "id").join(found, "vid").join(_emb(spark, d).select("id", "y"), "id").select("id", "y", "predicted")


_PREDICTED = f"{BASE}, {_pairs_sql()}, {INFLUENCE}, pred AS (SELECT id, y, influence AS predicted FROM nodes JOIN influence USING (vid) WHERE label < 0)"


_BUCKETS = """, c AS (SELECT y AS k, count(*) FILTER (y = predicted)::DOUBLE AS tp, (SELECT count(*) FROM pred q WHERE q.predicted = p.y)::DOUBLE AS pp, count(*)::DOUBLE AS s FROM pred p GROUP BY y),
r AS (SELECT CAST(k AS VARCHAR) AS bucket, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r, s, tp FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r),
a AS (SELECT bucket, p, r, f, s FROM f UNION ALL SELECT 'micro avg', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM f
UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM f UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM f)
"""


@query(_PREDICTED + _BUCKETS + "SELECT bucket, metric, round(value, 6) AS value FROM (SELECT bucket, unnest(['precision', 'recall', 'f1-score', 'support']) AS metric, unnest([p, r, f, s]) AS value FROM a)")
def classification_report(spark, d):
    return evaluate.classification_report(_predicted(spark, d)).select("bucket", "metric", _r("value"))


@query(_PREDICTED + " SELECT round(avg((y = predicted)::INTEGER), 6) AS accuracy FROM pred")
def accuracy(spark, d):
    return evaluate.accuracy(_predicted(spark, d)).select(_r("accuracy"))


_FOLDS = f"""WITH {EMB}, h AS (SELECT CAST(fold AS INTEGER) AS fold, id, x, y, md5('0:' || fold || ':' || id) AS h FROM emb CROSS JOIN (SELECT unnest(range(5)) AS fold)),
s AS MATERIALIZED (SELECT fold, id, x, y, row_number() OVER (PARTITION BY fold, y ORDER BY h, id) <= round(CAST(0.7 AS DOUBLE) * count(*) OVER (PARTITION BY fold, y)) AS hidden FROM h),
pred AS (SELECT a.fold, a.id, any_value(a.y) AS y, CAST(round(sum(CASE WHEN b.y = 1 THEN w ELSE 0 END), 9) > round(sum(CASE WHEN b.y = 0 THEN w ELSE 0 END), 9) AS INTEGER) AS predicted
  FROM (SELECT a.fold, a.id, a.y, b.y AS by, {METRIC_SQL["euclidean"]} AS w FROM s a JOIN s b ON a.fold = b.fold AND a.hidden AND NOT b.hidden) q, LATERAL (SELECT q.by AS y) b, LATERAL (SELECT q.y AS y, q.fold AS fold, q.id AS id) a GROUP BY a.fold, a.id),
c AS (SELECT fold, k, count(*) FILTER (y = k AND predicted = k)::DOUBLE AS tp, count(*) FILTER (predicted = k)::DOUBLE AS pp, count(*) FILTER (y = k)::DOUBLE AS s FROM pred CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY ALL),
r AS (SELECT fold, CAST(k AS VARCHAR) AS bucket, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r, s, tp FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r),
a AS (SELECT fold, bucket, p, r, f, s FROM f UNION ALL SELECT fold, 'micro avg', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM f GROUP BY fold
UNION ALL SELECT fold, 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM f GROUP BY fold UNION ALL SELECT fold, 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM f GROUP BY fold)
SELECT bucket, metric, round(sum(value) / 5, 6) AS value FROM (SELECT bucket, unnest(['precision', 'recall', 'f1-score', 'support']) AS metric, unnest([p, r, f, s]) AS value FROM a) GROUP BY ALL"""


@query(_FOLDS)
def report_average(spark, d):
    rows = materialize(_emb(spark, d))
    every = materialize(splits.stratified_splits(rows, "id", "y", UNLABELLED, 5))
    parts = []
    for fold in range(5):
        hidden = materialize(experiment.hide_labels(rows, every.where(F.col("fold") == fold)))
        nodes = graph.number_vertices(hidden, "id", "features", "label")
        found = graph.influence(nodes).where("influence >= 0").select("vid", F.col("influence").alias("predicted"))
        parts.append(nodes.select("vid", "id").join(found, "vid").join(hidden.select("id", "y"), "id").select(F.lit(fold).alias("fold"), "y", "predicted"))
    report = evaluate.classification_report(reduce(DataFrame.unionByName, parts), ["fold"])
    return evaluate.accumulate_reports(report, [], 5.0).select("bucket", "metric", _r("value"))


@query(_PREDICTED + _BUCKETS + """SELECT CAST(list_position(['0', '1', 'micro avg', 'macro avg', 'weighted avg'], bucket) - 1 AS INTEGER) AS position,
format('{:>15}{:10.2f}{:10.2f}{:10.2f}{:10.2f}', bucket, round(p, 2), round(r, 2), round(f, 2), round(s, 2)) AS line FROM a""")
def report_text(spark, d):
    return reports.report_lines(evaluate.classification_report(_predicted(spark, d)))


@query(
    "WITH m AS (SELECT unnest(['mincut', 'mincut_randomize', 'graphical_tree', 'graphical_loop']) AS model), d AS (SELECT unnest(['euclidean', 'gaussian', 'cosine']) AS metric), g AS (SELECT unnest(['knn', 'mst', 'knn_mst']) AS graph_type) "
    "SELECT * FROM m CROSS JOIN d CROSS JOIN g WHERE NOT (model = 'graphical_tree' AND graph_type = 'knn')"
)
def param_grid(spark, d):
    return experiment.grid_table(spark)


@query(_PREDICTED + " SELECT n.id, CAST(CASE WHEN n.label >= 0 THEN n.label ELSE p.predicted END AS INTEGER) AS y_train FROM nodes n LEFT JOIN pred p ON p.id = n.id")
def pseudo_label_merge(spark, d):
    return experiment.merge_pseudo_labels(_hidden(spark, d), _predicted(spark, d)).select("id", "y_train")


@query()
def k_search(spark, d):
    rows = _hidden(spark, d).where("label >= 0").select("id", "features", "y")
    return experiment.search_k(rows, "mincut", "euclidean", "knn")[1]


def _baseline(spark, d, name):
    hidden = _hidden(spark, d)
    train, rest = hidden.where("label >= 0"), hidden.where("label < 0")
    return classify.SUPERVISED[name](train.select("id", "features", "y"), rest, "id").join(rest.select("id", "y"), "id").select("id", "y", "predicted")


@query()
def logreg_baseline(spark, d):
    return _baseline(spark, d, "logistic")


@query()
def svm_baseline(spark, d):
    return _baseline(spark, d, "svm")


@query()
def transductive_report(spark, d):
    return experiment.run_transductive(_emb(spark, d))


@query()
def inductive_report(spark, d):
    return experiment.run_inductive(_emb(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
