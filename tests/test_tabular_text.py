import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import encode, evaluate, splits, textfeatures as T
from spanweave.sources import corpora, reports, tabular

# Known rows, whose prepared and encoded forms below must come out.
ABALONE = """M,0.455,0.365,0.095,0.514,0.2245,0.101,0.15,15
M,0.35,0.265,0.09,0.2255,0.0995,0.0485,0.07,7
F,0.53,0.42,0.135,0.677,0.2565,0.1415,0.21,1
M,0.44,0.365,0.125,0.516,0.2155,0.114,0.155,10
I,0.33,0.255,0.08,0.205,0.0895,0.0395,0.055,7
I,0.425,0.3,0.095,0.3515,0.141,0.0775,0.12,8
F,0.53,0.415,0.15,0.7775,0.237,0.1415,0.33,20
F,0.545,0.425,0.125,0.768,0.294,0.1495,0.26,16
M,0.475,0.37,0.125,0.5095,0.2165,0.1125,0.165,9
F,0.55,0.44,0.15,0.8945,0.3145,0.151,0.32,19"""
MUSHROOM = """p,x,s,n,t,p,f,c,n,k,e,e,s,s,w,w,p,w,o,p,k,s,u
e,x,s,y,t,a,f,c,b,k,e,c,s,s,w,w,p,w,o,p,n,n,g
e,b,s,w,t,l,f,c,b,n,e,c,s,s,w,w,p,w,o,p,n,n,m
p,x,y,w,t,p,f,c,n,n,e,e,s,s,w,w,p,w,o,p,k,s,u
e,x,s,g,f,n,f,w,b,k,t,e,s,s,w,w,p,w,o,e,n,a,g
e,x,y,y,t,a,f,c,b,n,e,c,s,s,w,w,p,w,o,p,k,n,g
e,b,s,w,t,a,f,c,b,g,e,c,s,s,w,w,p,w,o,p,k,n,m
e,b,y,w,t,l,f,c,b,n,e,c,s,s,w,w,p,w,o,p,n,s,m
p,x,y,w,t,p,f,c,n,p,e,e,s,s,w,w,p,w,o,p,k,v,g
e,b,s,y,t,a,f,c,b,g,e,c,s,s,w,w,p,w,o,p,k,s,m"""


@pytest.mark.parametrize("from_file", [True, False])
def test_abalone(spark, tmp_path, from_file):
    source = ABALONE.splitlines()
    if from_file:
        (tmp_path / "a.csv").write_text(ABALONE)
        source = str(tmp_path / "a.csv")
    df = tabular.prepare_abalone(tabular.read_abalone(spark, source))
    assert [r["Sex"] for r in df.collect()] == [1, 1, 1, 0, 0, 1]
    assert [r["Rings"] for r in df.collect()] == [15, 7, 10, 7, 8, 9]
    for positive, want in (([7], [0, 1, 0, 1, 0, 0]), ([7, 20, 8], [0, 1, 0, 1, 1, 0]), ([], [0] * 6)):
        assert [r["y"] for r in df.select(tabular.in_labels(F.col("Rings"), positive).alias("y")).collect()] == want


def test_mushroom_encoding(spark):
    rows = tabular.read_mushroom(spark, MUSHROOM.splitlines()).coalesce(1).withColumn("id", F.monotonically_increasing_id())
    df = tabular.prepare_mushroom(rows)
    columns = [c for c in df.columns if c not in ("id", "class")]
    assert len(columns) == 20
    assert [r["class"] for r in df.orderBy("id").collect()] == [0, 1, 1, 0, 1, 1, 1, 1, 0, 1]
    means = encode.fit_target_means(df.where("id < 7"), columns, "class")
    got = [r["features"] for r in encode.encoded_vectors(df, "id", columns, means).orderBy("id").collect()]
    a, b, c = 4 / 6, 5 / 7, 2 / 3
    want = {
        0: [3 / 5, 4 / 5, 0, a, 0, b, a, 0, c, a, b, b, b, b, b, b, a, 2 / 4, 0, 0],
        4: [3 / 5, 4 / 5, 1, 1, 1, b, 1, 1, c, 1, b, b, b, b, b, b, 1, 1, 1, 1],
        7: [1, 1 / 2, c, a, 1, b, a, 1, c, a, b, b, b, b, b, b, a, 1, 0, 1],
        8: [3 / 5, 1 / 2, c, a, 0, b, a, 0, 0, a, b, b, b, b, b, b, a, 2 / 4, 0, 1],
    }
    for i, row in want.items():
        assert np.allclose(got[i], row)


def test_anuran_and_parity(spark):
    header = ",".join(c.replace(" ", "") for c in tabular.ANURAN)
    line = ",".join(["0.5"] * 22)
    df = tabular.prepare_anuran(tabular.read_anuran(spark, [header, f"{line},Leptodactylidae,g,s,1", f"{line},Hylidae,g,s,2", f"{line},Unknown,g,s,3"]))
    assert [r["Family"] for r in df.collect()] == [1, 0, None] and len(df.columns) == 23
    assert [r[0] for r in spark.range(3).select(tabular.parity(F.col("id"))).collect()] == [0, 1, 0]


def test_row_limits_and_digits(spark, tmp_path):
    lines = [",".join([str(k), "2", "1", "1", str(k)]) for k in range(5)]
    got = tabular.read_digits(spark, iter(lines), pixels=4, max_rows=3).collect()
    assert [(r["features"], r["digit"]) for r in got] == [([float(k), 2.0, 1.0, 1.0], k) for k in range(3)]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    assert tabular.read_digits(spark, str(tmp_path / "d.csv"), pixels=4, max_rows=2).count() == 2
    header = ",".join(c.replace(" ", "") for c in tabular.ANURAN)
    row = ",".join(["0.5"] * 22) + ",Hylidae,g,s,2"
    assert tabular.read_anuran(spark, [header, row, row, row], max_rows=2).count() == 2 and tabular.read_abalone(spark, ["M,1,1,1,1,1,1,1,9"] * 4, max_rows=0).count() == 0


def test_seeded_order(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(50)], "path string")
    a, b, c = ([r["path"] for r in corpora.seeded_order(x, "path", s).orderBy("position").collect()] for x, s in ((df, 1), (df.repartition(3), 1), (df, 2)))
    assert a == b != c and sorted(a) == sorted(c)


def test_long_reports(spark, tmp_path):
    """No line is left out, however many buckets there are."""
    rows = spark.range(1500).select(F.format_string("bucket %05d", "id").alias("bucket"), F.explode(F.array(*map(F.lit, evaluate.METRICS))).alias("metric"), F.lit(0.5).alias("value"))
    reports.export_text(rows, str(tmp_path / "r.txt"), "all")
    assert sum("bucket" in line for line in (tmp_path / "r.txt").read_text().splitlines()) == 1500


SGML = """<!DOCTYPE lewis SYSTEM "lewis.dtd">
<REUTERS TOPICS="YES"><TOPICS><D>acq</D><D>grain</D></TOPICS><TEXT>&#2;<TITLE>A &amp; B</TITLE><BODY>One  two
three &lt;X>
&#3;</BODY></TEXT></REUTERS>
<REUTERS><TOPICS></TOPICS><TEXT><BODY>none</BODY></TEXT></REUTERS>
<REUTERS><TOPICS><D>wool</D></TOPICS><TEXT><TITLE>café</TITLE></TEXT></REUTERS>"""


def test_sgml(spark, tmp_path):
    (tmp_path / "x.sgm").write_bytes(SGML.encode("latin-1"))
    (tmp_path / "y.txt").write_text("no")
    docs = corpora.read_sgml(spark, str(tmp_path)).orderBy("position").collect()
    assert [(d["title"], d["body"], d["topics"]) for d in docs] == [("A & B", "One two three <X> ", ["acq", "grain"]), ("", "none", []), ("café", "", ["wool"])]
    batch = corpora.read_reuters(spark, str(tmp_path), "acq").orderBy("position").collect()
    assert [(r["text"], r["y"]) for r in batch] == [("A & B\n\nOne two three <X> ", 1), ("café\n\n", 0)]
    with pytest.raises(TypeError):
        corpora.read_reuters(spark, str(tmp_path), ["acq"])
    assert corpora.parse_sgml(spark.createDataFrame([], "path string, content string")).count() == 0


def test_newsgroups_and_vocabulary(spark, tmp_path):
    post = "From: a@b\nSubject: x\n\nHello there\n> quoted\nBob writes:\nfine words\n\n--\nBob"
    for path in ("news-train/sci.space/1", "news-test/rec.autos/2"):
        (tmp_path / path).parent.mkdir(parents=True)
        (tmp_path / path).write_text(post)
    df = corpora.label_categories(corpora.read_newsgroups(spark, str(tmp_path)), None, ["sci.space"])
    rows = sorted((r["category"], r["subset"], r["y"]) for r in df.collect())
    assert rows == [("rec.autos", "test", 0), ("sci.space", "train", 1)]
    text = df.first()["text"]
    assert "Hello there" in text and "fine words" in text and "quoted" not in text and "Subject" not in text and "Bob" not in text
    (tmp_path / "v.txt").write_text("alpha\nbeta\ngamma\n")
    assert [(r["term_id"], r["term"]) for r in corpora.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()] == [(0, "alpha"), (1, "beta"), (2, "gamma")]


# Known word counts (documents, words) and classes, whose ranks below must come out.
COUNTS = np.array([[4, 2, 10, 4, 2, 1, 1, 1, 3, 9], [2, 4, 0, 0, 0, 0, 1, 0, 0, 0], [0, 3, 3, 0, 1, 1, 1, 0, 8, 5], [0, 2, 0, 0, 0, 0, 0, 0, 4, 0], [0, 8, 8, 0, 0, 0, 1, 0, 6, 1], [0, 2, 1, 0, 0, 0, 0, 0, 4, 5]])
CLASSES = [2, 2, 0, 0, 1, 1]


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(d, t, int(COUNTS[d, t])) for d in range(6) for t in range(10) if COUNTS[d, t]]
    return spark.createDataFrame(rows, "id long, term int, n long").cache(), spark.createDataFrame(list(enumerate(CLASSES)), "id long, y int").cache()


def test_mutual_information(counts):
    tf, y = counts
    got = {r["term"]: r["score"] for r in T.mutual_information(tf, "id", y).collect()}
    total = 60
    for t in range(10):
        want = 0.0
        for x in set(COUNTS[:, t]):
            p_x = (COUNTS[:, t] == x).sum() / total
            for c in (0, 1, 2):
                p = sum(1 for d in range(6) if COUNTS[d, t] == x and CLASSES[d] == c) / total
                want += p * math.log((p + 1) / (p_x / 3 + 1))
        assert got[t] == pytest.approx(want, abs=1e-12)
    rank = sorted(got, key=lambda t: -round(got[t], 12))
    assert rank[0] == 0 and set(rank[1:3]) == {8, 2} and rank[3:7] == [9, 1, 4, rank[6]]


def test_l1_and_tfidf(counts):
    tf, y = counts
    chosen = tf.where("term in (0, 8, 2, 9, 1)")
    got = {(r["id"], r["term"]): r["value"] for r in T.l1_normalize(chosen, "id", 10).collect()}
    sums = COUNTS[:, [0, 8, 2, 9, 1]].sum(1)
    assert all(v == pytest.approx(COUNTS[d, t] / sums[d] * 10) for (d, t), v in got.items())
    values = {}
    for r in T.tfidf(tf, "id", 6).collect():
        values.setdefault(r["id"], []).append(r["value"])
    assert all(sum(v * v for v in vs) == pytest.approx(1) for vs in values.values())


def test_tokens(spark):
    df = spark.createDataFrame([(1, "The naïve_x a I've 42"), (2, None), (3, "")], "id long, t string")
    got = {r["id"]: r["t"] for r in df.select("id", T.tokens(F.col("t")).alias("t")).collect()}
    assert got == {1: ["the", "naïve_x", "ve", "42"], 2: [], 3: []}
    tf = T.term_counts(df, "id", F.col("t"), stop_words=["the"], vocabulary=df.sparkSession.createDataFrame([("42",), ("the",)], "term string"))
    assert [tuple(r) for r in tf.collect()] == [(1, "42", 1)]


def test_text_features_dense(spark):
    df = spark.createDataFrame([(1, "corn wheat corn", 1), (2, "ship oil", 0), (3, None, 0)], "id long, t string, y int")
    values, ranked = T.text_features(df, "id", F.col("t"), F.col("y"), "tfidf", 3, "l1", 10)
    dense = {r["id"]: r["features"] for r in T.dense_vectors(values, "id", ranked, df).collect()}
    assert len(dense[1]) == 3 and dense[3] == [0.0, 0.0, 0.0] and sum(dense[1]) == pytest.approx(10)
    with pytest.raises(ValueError):
        T.text_features(df, "id", F.col("t"), F.col("y"), "chi2")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (0, None)], "y int, predicted int")
    got = {(r["bucket"], r["metric"]): r["value"] for r in evaluate.classification_report(df).collect()}
    assert got["1", "precision"] == pytest.approx(2 / 3) and got["1", "recall"] == pytest.approx(2 / 3) and got["0", "recall"] == pytest.approx(1 / 3)
    assert got["0", "precision"] == 0.5 and got["macro avg", "support"] == 6 and got["weighted avg", "recall"] == pytest.approx(0.5)
    assert evaluate.accuracy(df).first()[0] == 0.5
    nothing = {(r["bucket"], r["metric"]): r["value"] for r in evaluate.classification_report(df.limit(0)).collect()}
    assert set(nothing.values()) == {0.0} and len(nothing) == 20
    path = tmp_path / "r.out"
    for _ in range(2):
        reports.export_text(evaluate.classification_report(df), str(path), "mincut", 2.0, "run")
    text = path.read_text().splitlines()
    assert text.count("mincut") == 2 and "              1      0.33      0.33      0.33      1.50" in text
    reports.write_report(evaluate.classification_report(df), str(tmp_path / "p"))
    reports.write_report(evaluate.classification_report(df), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 40


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1000)], "id long, y int")
    s = splits.stratified_splits(df, "id", "y", 0.7, 3).collect()
    for fold in range(3):
        for y in range(3):
            rows = [r for r in s if r["fold"] == fold and r["y"] == y]
            assert sum(r["is_test"] for r in rows) == round(0.7 * len(rows))
    roles = splits.nested_splits(df, "id", "y", 0.3, 0.7, 2).collect()
    assert len(roles) == 4000 and {r["role"] for r in roles} == {"test", "labelled", "unlabelled"}
    assert splits.stratified_splits(df.limit(0), "id", "y", 0.5).count() == 0
