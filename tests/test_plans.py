import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spanweave.operators import classify, splits
from spanweave.plans import catalog, experiment
from spanweave.streaming.score import score_stream


def test_grid():
    grid = experiment.parameter_grid()
    assert len(grid) == len(set(grid)) == 33


def test_search_prefers_the_smallest_k(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.8)], "k int, accuracy double")
    assert experiment.best_k(scores).first()["k"] == 2
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, float(i)], i % 2) for i in range(24)], "id long, features array<double>, y int")
    best, table = experiment.search_k(rows, ks=range(1, 3))
    assert best in (1, 2) and table.count() == 2


def test_pipeline_and_reports(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + (i % 7) * 0.1, 0.1 * i], i % 2) for i in range(40)], "id long, features array<double>, y int")
    configs = [experiment.Config("mincut", "euclidean", "knn")]
    report = experiment.average_reports(experiment.run_transductive(rows, folds=1, configs=configs, ks=range(3, 4)))
    accuracy = {(r["experiment"], r["bucket"], r["metric"]): r["value"] for r in report.collect()}
    assert accuracy["mincut/euclidean/knn", "weighted avg", "recall"] > 0.9 and accuracy["logistic", "weighted avg", "recall"] > 0.9 and accuracy["svm", "weighted avg", "recall"] > 0.8
    inductive = experiment.run_inductive(rows, folds=1, configs=[experiment.Config("graphical_tree", "euclidean", "mst")], supervised=("logistic",))
    assert {r["experiment"] for r in inductive.collect()} == {"logistic", "graphical_tree/euclidean/mst+logistic"}
    with pytest.raises(ValueError):
        experiment.Pipeline().set_params(trans__colour=1)
    with pytest.raises(KeyError):
        experiment.get_experiment("iris")


def test_many_graphs_as_one(spark):
    """Every graph of a grid gets the labels that it gets alone, and every search for k the same k."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(2.0 * (i % 2), 1.0), rng.gauss(0.0, 1.0), rng.gauss(1.0 * (i % 2), 1.5)], i % 2) for i in range(60)], "id long, features array<double>, y int")
    split = splits.stratified_splits(rows, "id", "y", 0.6, 2)
    parts = {f: experiment.hide_labels(rows, split.where(F.col("fold") == f)) for f in (0, 1)}
    every = parts[0].withColumn("run", F.lit(0).cast("long")).unionByName(parts[1].withColumn("run", F.lit(1).cast("long")))
    configs = [experiment.Config("mincut", "euclidean", "knn"), experiment.Config("mincut_randomize", "cosine", "knn_mst"), experiment.Config("graphical_tree", "gaussian", "mst"), experiment.Config("graphical_loop", "euclidean", "knn")]
    base = experiment.similarities(every, ["cosine", "euclidean", "gaussian"], 3)
    wanted = spark.createDataFrame([(2 * n + f, f, c.model, c.metric, c.graph_type, 2 + f) for n, c in enumerate(configs) for f in (0, 1)], "graph long, run long, model string, metric string, graph_type string, k int")
    together = {(r["graph"], r["id"]): r["predicted"] for r in experiment.label_graphs(base, wanted).collect()}
    for n, c in enumerate(configs):
        for f in (0, 1):
            alone = experiment.Pipeline().set_params(trans__graph_type=c.graph_type, trans__metric=c.metric, infer__model_type=c.model).fit(parts[f].select("id", "features", "label"), 2 + f).predict()
            assert {r["id"]: r["predicted"] for r in alone.collect()} == {i: v for (g, i), v in together.items() if g == 2 * n + f}, (c, f)
    labelled = every.where("label >= 0").select("run", "id", "features", "y")
    chosen = {(r["run"], r["model"]): r["k"] for r in experiment.search_runs(labelled, configs[:1], range(1, 4)).collect()}
    for f in (0, 1):
        assert chosen[f, "mincut"] == experiment.search_k(labelled.where(F.col("run") == f).drop("run"), ks=range(1, 4))[0]



def test_runs_too_large_for_a_task(spark):
    """Graphs that a task makes and solves have the labels that they have through joins, and fits of many labellings are those of each."""
    rng = random.Random(6)
    rows = spark.createDataFrame([(r, i, [rng.gauss(1.0 * (i % 2), 1.0) for _ in range(3)], i % 2 if i % 3 == 0 else -1) for r, n in ((0, 36), (1, 24)) for i in range(n)], "run long, id long, features array<double>, label int")
    configs = [experiment.Config(m, "euclidean", g) for m, g in (("mincut", "knn"), ("mincut_randomize", "knn"), ("graphical_tree", "knn_mst"), ("graphical_tree", "mst"), ("graphical_loop", "knn"))]
    base = experiment.similarities(rows, ["euclidean"], 3)
    wanted = spark.createDataFrame([(2 * n + f, f, c.model, c.metric, c.graph_type, 2 + f) for n, c in enumerate(configs) for f in (0, 1)], "graph long, run long, model string, metric string, graph_type string, k int")
    a, b = (sorted(map(tuple, experiment.label_graphs(base, wanted, most).collect())) for most in (1000, 30))
    assert a == b and len(a) == len(configs) * (24 + 16)
    with pytest.raises(ValueError):
        experiment.label_graphs(base, wanted.withColumn("model", F.lit("guess")))
    ys = spark.createDataFrame([(r["run"], r["features"], [10 + r["run"], 20 + r["run"], 30 + r["run"]], [r["id"] % 2, int(r["features"][0] > 0), 1]) for r in rows.collect()], "by long, features array<double>, runs array<long>, ys array<int>")
    each = ys.select(F.explode(F.arrays_zip("runs", "ys")).alias("l"), "features").select(F.col("l.runs").alias("run"), "features", F.col("l.ys").alias("y"))
    of = lambda models: {(r["run"], r["name"]): r["weights"] for r in models.collect()}
    alone = of(classify.fit_many(each))
    for most in (1000, 30):
        together = of(classify.fit_labellings(ys, fit_rows=most))
        assert together.keys() == alone.keys() and all(together[m] == pytest.approx(alone[m], abs=1e-6) for m in alone)


def test_a_grid_is_few_jobs(spark):
    """However many graphs: a grid of them is labelled by tasks, not by rounds of jobs over all."""
    rows = spark.createDataFrame([(i, [float(i % 2) + 0.01 * i, 0.1 * (i % 7)], i % 2) for i in range(40)], "id long, features array<double>, y int")
    spark.sparkContext.setJobGroup("grid", "grid")
    report = experiment.run_inductive(rows, folds=2, ks=range(1, 4)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    spark.sparkContext._jsc.clearJobGroup()
    assert len(report) == 4 * 2 * 34 * 20 and jobs < 150, jobs


def test_main(spark, data, tmp_path):
    settings = {"folds": 1, "configs": [experiment.Config("mincut", "euclidean", "mst")], "supervised": ("logistic",)}
    experiment.main(spark, data, str(tmp_path), "digit", **settings)
    text = (tmp_path / "transductive.txt").read_text()
    assert "mincut/euclidean/mst" in text and "logistic" in text and "weighted avg" in text and "mst+logistic" in (tmp_path / "inductive.txt").read_text()
    assert (tmp_path / "experiment.log").exists()


def test_parameter_sets(spark, data):
    assert len(experiment.PARAMETERS) == 8 and {n for n, _ in experiment.PARAMETERS.values()} == set(experiment.EXPERIMENTS)
    assert experiment.get_experiment("newsgroups", "newsgroups2")(spark, data).where("y = 1").count() > 0
    for name in ("reuters", "nothing"):
        with pytest.raises(KeyError):
            experiment.get_experiment("newsgroups", name)


def test_large_fits_by_passes(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [rng.gauss(3.0 * (i % 2), 1.0), rng.gauss(0.0, 1.0)], i % 2) for i in range(80)] + [(100 + i, [0.0, 1.0], 1) for i in range(3)], "id long, features array<double>, y int")
    train, test = rows.where("id < 60"), rows.where("id >= 60")
    for name, fit in classify.SUPERVISED.items():
        a, b = ({r["id"]: r["predicted"] for r in fit(train, test, "id", most).collect()} for most in (1000, 5))
        assert a == b and sum(a[i] == i % 2 for i in range(60, 80)) >= 15, name
        one = fit(rows.where("id >= 100"), test, "id").collect()
        assert {r["predicted"] for r in one} == {1}
        assert {r["predicted"] for r in fit(train.limit(0), test, "id").collect()} == {0}


def test_datasets(spark, data):
    for name in experiment.EXPERIMENTS:
        df = experiment.get_experiment(name)(spark, data)
        assert set(df.columns) == {"id", "features", "y"} and df.where("y in (0, 1)").count() == df.count() > 0, name


def test_stream_scoring(spark, tmp_path):
    labelled = spark.createDataFrame([(1, [0.0], 0), (2, [9.0], 1)], "id long, features array<double>, label int")
    spark.createDataFrame([(10, [1.0]), (11, [8.0])], "id long, features array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<double>").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = score_stream(labelled, stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert {r["id"]: r["predicted"] for r in spark.read.parquet(out).collect()} == {10: 0, 11: 1}


def test_catalog_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["tree_messages", "tree_labels", "flood_faithful_labels", "flood_labels", "mincut_checks", "report_text", "report_average", "p5_found", "p5_donors", "p5_marks", "abalone_prepare", "abalone_file", "mushroom_file", "anuran_file", "sgml_files", "vocabulary_counts", "tokenize_unicode", "tfidf_selected_terms"])
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = catalog.queries()[name](spark, data)
    columns = sorted(got.columns)
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order([r[c] for c in columns] for r in got.collect()) == order(cursor.fetchall())


def test_report_average_scores_the_hidden_part(spark, data):
    from spanweave.plans import catalog

    got = {(r["bucket"], r["metric"]): r["value"] for r in catalog.report_average(spark, data).collect()}
    rows = catalog._emb(spark, data).count()
    assert len(got) == 20 and abs(got["micro avg", "support"] - 0.7 * rows) <= 2
    assert got["0", "support"] + got["1", "support"] == got["micro avg", "support"]
