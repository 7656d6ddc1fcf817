"""Experiments: pipelines, the parameter grid, the search for k, transductive and inductive runs, and the registry of datasets.

An experiment's folds, configurations and values of k are columns, not loops: similarities are computed once for each fold and metric, and a task makes and
labels all graphs of a fold, metric and type that follow from them. Graphs too large for a task are separate parts of one graph, which each of the four models
labels at once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.metrics import COLUMN_METRICS
from spanweave.operators import evaluate, splits
from spanweave.operators.classify import fit_labellings, fit_many, predict_many
from spanweave.operators.graph import GRAPH_TYPES, TASKS_PER_CORE, Graph, build_graph, compare_runs, forest_edges, influence, knn_edges, knn_of, neighbour_candidates, number_vertices, spanning_forest
from spanweave.operators.inference import MODELS, Solver, infer, unlabelled_predictions
from spanweave.session import materialize, parallelism
from spanweave.sources import reports
from spanweave.sources.tabular import in_labels, parity

log = logging.getLogger("spanweave")
# Graph types that each model is tried on; a tree model needs a forest.
GRAPHS_OF = {"mincut": ("knn", "mst", "knn_mst"), "mincut_randomize": ("knn", "mst", "knn_mst"), "graphical_tree": ("mst", "knn_mst"), "graphical_loop": ("knn", "mst", "knn_mst")}
K_RANGE = range(1, 11)
#: Vertices of a run whose graphs one task makes and solves.
TASK_VERTICES = 20_000


@dataclass(frozen=True)
class Config:
    model: str
    metric: str
    graph_type: str

    @property
    def name(self) -> str:
        return f"{self.model}/{self.metric}/{self.graph_type}"


def parameter_grid() -> list[Config]:
    """All 33 configurations."""
    return [Config(m, d, g) for m, graphs in GRAPHS_OF.items() for d in COLUMN_METRICS for g in graphs]


def grid_table(spark: SparkSession) -> DataFrame:
    """``(model, metric, graph_type)``."""
    return spark.createDataFrame([(c.model, c.metric, c.graph_type) for c in parameter_grid()], "model string, metric string, graph_type string")


@dataclass
class GraphTransformer:
    """First stage: labelled and unlabelled rows to a sparsified graph."""

    graph_type: str = "knn"
    metric: str = "euclidean"
    gamma: float | None = None
    graph: Graph | None = None
    nodes: DataFrame | None = None

    def set_params(self, **params) -> GraphTransformer:
        for k, v in params.items():
            if not hasattr(self, k):
                raise ValueError(f"unknown parameter {k!r}")
            setattr(self, k, v)
        return self

    def fit(self, rows: DataFrame, k: int = 3) -> GraphTransformer:
        """``rows(id, features, label)``, -1 for unlabelled."""
        self.nodes = number_vertices(rows, "id", "features", "label")
        self.graph = build_graph(self.nodes, self.graph_type, self.metric, k, self.gamma)
        return self

    def transform(self, _=None) -> Graph:
        return self.graph


@dataclass
class GraphInference:
    """Second stage: labels of the unlabelled rows."""

    model_type: str = "mincut"
    graph: Graph | None = None
    labels: DataFrame | None = None

    def set_params(self, **params) -> GraphInference:
        for k, v in params.items():
            if not hasattr(self, k):
                raise ValueError(f"unknown parameter {k!r}")
            setattr(self, k, v)
        return self

    def fit(self, graph: Graph) -> GraphInference:
        self.graph, self.labels = graph, materialize(infer(graph, self.model_type))
        return self

    def predict(self) -> DataFrame:
        return unlabelled_predictions(self.graph, self.labels)


@dataclass
class Pipeline:
    """``trans__`` and ``infer__`` parameters as in ``set_params(trans__metric="cosine")``."""

    trans: GraphTransformer = field(default_factory=GraphTransformer)
    infer: GraphInference = field(default_factory=GraphInference)

    def set_params(self, **params) -> Pipeline:
        for key, value in params.items():
            stage, _, name = key.partition("__")
            if stage not in ("trans", "infer") or not name:
                raise ValueError(f"unknown parameter {key!r}")
            getattr(self, stage).set_params(**{name: value})
        return self

    def fit(self, rows: DataFrame, k: int = 3) -> Pipeline:
        self.infer.fit(self.trans.fit(rows, k).transform())
        return self

    def predict(self) -> DataFrame:
        """``(id, predicted)`` of the unlabelled rows."""
        return self.trans.nodes.join(self.infer.predict(), "vid").select("id", "predicted")


def hide_labels(df: DataFrame, split: DataFrame, id_col: str = "id") -> DataFrame:
    """``df(id, features, y)`` and a one-fold split -> ``(id, features, label, y)`` with label -1 on the test side."""
    side = split.select(id_col, "is_test")
    return df.join(side, id_col).select(id_col, "features", F.when(F.col("is_test"), -1).otherwise(F.col("y")).cast("int").alias("label"), F.col("y").cast("int").alias("y"))


def search_k(rows: DataFrame, model: str = "mincut", metric: str = "euclidean", graph_type: str = "knn", ks=K_RANGE, seed: int = 0) -> tuple[int, DataFrame]:
    """Best k and ``(k, accuracy)``: half of the labelled ``rows(id, features, y)`` is hidden and inferred; the smallest k wins ties.

    Weights are computed once: the candidates of the largest k hold the graphs of all others.
    """
    split = splits.stratified_splits(rows, "id", "y", 0.5, 1, seed)
    hidden = materialize(hide_labels(rows, split))
    nodes = number_vertices(hidden, "id", "features", "label")
    candidates = materialize(neighbour_candidates(nodes, metric, None, max(ks)))
    vertices = materialize(nodes.select("vid", "label").join(influence(nodes, metric).select("vid", "influence"), "vid"))
    truth = nodes.select("vid", "id").join(hidden.select("id", "y"), "id")
    scores = []
    for k in ks:
        edges = knn_of(candidates, k)
        graph = Graph(vertices, materialize(spanning_forest(edges) if graph_type == "knn_mst" else edges))
        predicted = unlabelled_predictions(graph, infer(graph, model))
        scores.append((k, float(evaluate.accuracy(predicted.join(truth, "vid")).first()[0] or 0.0)))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    return best, rows.sparkSession.createDataFrame(scores, "k int, accuracy double")


def best_k(scores: DataFrame) -> DataFrame:
    """``(k, accuracy)`` of the best score, the smallest k on ties."""
    return scores.agg(F.max_by(F.struct("k", "accuracy"), F.struct("accuracy", (-F.col("k")).alias("m"))).alias("b")).select("b.k", "b.accuracy")


def merge_pseudo_labels(rows: DataFrame, predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels of ``rows(id, features, y, label)``: the known ones, and the predicted ones where hidden."""
    return rows.join(predicted.select(id_col, "predicted"), id_col, "left").withColumn("y_train", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("predicted", "label")).cast("int"))


@dataclass
class Similarities:
    """What all graphs of some runs follow from, for each metric."""

    nodes: DataFrame  # run, vid, id, label
    vertices: DataFrame  # metric, run, vid, id, label, influence
    candidates: DataFrame  # metric, run, src, dst, weight, rank, labelled_rank
    forests: DataFrame  # metric, run, src, dst, weight
    size: int


def similarities(rows: DataFrame, metrics: list[str], most: int, forests: bool = True) -> Similarities:
    """``rows(run, id, features, label)``, label -1 if hidden; graphs of up to ``most`` neighbours. Without ``forests`` no graph can be of type mst."""
    nodes = materialize(number_vertices(rows, "id", "features", "label", "run"))
    vertices, candidates, trees = compare_runs(nodes, metrics, most, forests)
    named = vertices.join(nodes.select("vid", "id"), "vid").select("metric", "run", "vid", "id", "label", "influence")
    return Similarities(nodes.drop("features"), *map(materialize, (named, candidates, trees)), nodes.count())


def label_graphs(base: Similarities, wanted: DataFrame, task_vertices: int = TASK_VERTICES) -> DataFrame:
    """``wanted(graph, run, model, metric, graph_type, k)``, graph numbers from 0 -> ``(graph, run, id, predicted)`` of every graph's hidden rows.

    All graphs of a run of up to ``task_vertices``, of a metric and type, are made and solved in one task, which gets the run's neighbours once; the graphs of
    larger runs go through joins. ``wanted`` has a row per graph of the grid and is broadcast.
    """
    wanted = materialize(wanted)
    for r in wanted.select("model").distinct().collect():
        if r["model"] not in MODELS:
            raise ValueError(f"unknown model {r['model']!r}; known: {', '.join(MODELS)}")
    large = materialize(base.nodes.groupBy("run").count().where(F.col("count") > task_vertices).select("run"))
    if large.isEmpty():
        return _label_in_tasks(base, wanted)
    return _label_in_tasks(base, wanted.join(large, "run", "left_anti")).unionByName(_label_by_joins(base, materialize(wanted.join(large, "run", "left_semi"))))


def _label_in_tasks(base: Similarities, wanted: DataFrame) -> DataFrame:
    by, no = ["run", "metric", "graph_type"], F.lit(None)
    jobs = wanted.select(*by, F.lit("job").alias("kind"), F.col("graph").alias("a"), F.col("k").cast("long").alias("b"), no.cast("double").alias("w"), no.cast("int").alias("c"), no.cast("int").alias("d"), "model")
    tasks = F.broadcast(materialize(wanted.select(*by).distinct()))
    vertices = base.vertices.join(tasks, ["run", "metric"]).select(*by, F.lit("vertex").alias("kind"), F.col("vid").alias("a"), F.col("id").alias("b"), no.alias("w"), F.col("label").alias("c"), F.col("influence").alias("d"), no.alias("model"))
    edge = (F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    near = base.candidates.join(tasks.where("graph_type <> 'mst'"), ["run", "metric"]).select(*by, *edge, F.col("rank").alias("c"), F.coalesce("labelled_rank", F.lit(0)).alias("d"), no.alias("model"))
    trees = base.forests.join(tasks.where("graph_type = 'mst'"), ["run", "metric"]).select(*by, *edge, F.lit(0).alias("c"), F.lit(0).alias("d"), no.alias("model"))
    rows = reduce(DataFrame.unionByName, (jobs, vertices, near, trees))
    parts = max(1, min(tasks.count(), TASKS_PER_CORE * parallelism(wanted.sparkSession)))
    return rows.repartition(parts, *by).groupBy(*by).applyInArrow(_solve_run, "graph long, run long, id long, predicted int")


def _solve_run(key: tuple, table: pa.Table) -> pa.Table:
    run, _, graph_type = (x.as_py() for x in key)
    part = {kind: table.filter(pc.equal(table["kind"], kind)) for kind in ("job", "vertex", "edge")}
    vid, ids, label, influence = (part["vertex"][c].to_numpy() for c in ("a", "b", "c", "d"))
    order = np.argsort(vid)  # numbers without gaps, run after run
    vid, ids, label, influence = vid[order], ids[order], label[order], influence[order]
    src, dst = (np.searchsorted(vid, part["edge"][c].to_numpy()) for c in ("a", "b"))
    weight, rank, labelled_rank = (part["edge"][c].to_numpy() for c in ("w", "c", "d"))
    whole, solver, hidden, graphs = knn_edges(src, dst, weight, np.ones(len(src), bool)), Solver(label, influence), label < 0, {}
    out: list[tuple[int, np.ndarray]] = []
    for job in sorted(part["job"].select(["a", "b", "model"]).to_pylist(), key=lambda j: j["a"]):
        k = job["b"]
        if k not in graphs:
            edges = whole if graph_type == "mst" else knn_edges(src, dst, weight, (rank <= k) | (labelled_rank == 1))
            graphs[k] = forest_edges(*edges) if graph_type == "knn_mst" else edges
        out.append((job["a"], solver.labels(job["model"], *graphs[k])[hidden]))
    n = int(hidden.sum())
    columns = [np.repeat([g for g, _ in out], n), np.full(n * len(out), run), np.tile(ids[hidden], len(out)), np.concatenate([x for _, x in out])]
    return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("graph", "run", "id", "predicted"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)})


def _label_by_joins(base: Similarities, wanted: DataFrame) -> DataFrame:
    """A vertex of graph g is numbered g times the vertices of all runs higher, so graphs never touch."""
    high = lambda c: (F.col("graph") * base.size + F.col(c)).alias(c)
    first = base.nodes.groupBy("run").agg(F.min("vid").alias("first"))
    placed = base.vertices.join(F.broadcast(first), "run").join(F.broadcast(wanted), ["run", "metric"])
    vertices = materialize(placed.select("graph", "model", F.col("graph").alias("run"), high("vid"), (F.col("vid") - F.col("first")).alias("place"), "label", "influence"))
    near = base.candidates.join(F.broadcast(wanted.where("graph_type <> 'mst'")), ["run", "metric"])
    chosen = near.where(((F.col("rank") <= F.col("k")) | (F.col("labelled_rank") == 1)) & (F.col("weight") > 0)).select("model", "graph_type", high("src"), high("dst"), "weight")
    knn = materialize(chosen.groupBy("model", "graph_type", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight")))
    model_of = vertices.select(F.col("vid").alias("src"), "model")
    thinned = spanning_forest(knn.where("graph_type = 'knn_mst'").select("src", "dst", "weight").repartition("src")).join(model_of, "src")
    whole = base.forests.join(F.broadcast(wanted.where("graph_type = 'mst'")), ["run", "metric"]).select("model", high("src"), high("dst"), "weight")
    edges = materialize(knn.where("graph_type = 'knn'").drop("graph_type").unionByName(thinned.select("model", "src", "dst", "weight")).unionByName(whole))
    found = []
    for model in sorted(r["model"] for r in wanted.select("model").distinct().collect()):
        mine = Graph(vertices.where(F.col("model") == model).drop("model", "graph"), edges.where(F.col("model") == model).drop("model"))
        found.append(materialize(unlabelled_predictions(mine, infer(mine, model))))
    predicted = reduce(DataFrame.unionByName, found).select(F.floor(F.col("vid") / base.size).alias("graph"), (F.col("vid") % base.size).alias("vid"), "predicted")
    return predicted.join(base.nodes.select("run", "vid", "id"), "vid").select("graph", "run", "id", "predicted")


def _numbered(df: DataFrame) -> DataFrame:
    """Number the rows of a grid."""
    return df.withColumn("graph", F.row_number().over(Window.orderBy("run", "model", "metric", "graph_type", "k")).cast("long") - 1)


def search_runs(labelled: DataFrame, configs: list[Config], ks=K_RANGE, seed: int = 0) -> DataFrame:
    """:func:`search_k` for every run of ``labelled(run, id, features, y)`` and every configuration: ``(run, model, metric, graph_type, k)``; k is 0 for whole trees."""
    each = F.array(*[F.struct(F.lit(c.model).alias("model"), F.lit(c.metric).alias("metric"), F.lit(c.graph_type).alias("graph_type")) for c in configs])
    grid = labelled.select("run").distinct().select("run", F.explode(each).alias("c")).select("run", "c.*")
    whole = grid.where("graph_type = 'mst'").withColumn("k", F.lit(0))
    near = [c for c in configs if c.graph_type != "mst"]
    if not near:
        return whole
    half = splits.stratified_runs(labelled, "run", "id", "y", 0.5, seed)
    hidden = materialize(labelled.join(half.select("run", "id", "is_test"), ["run", "id"]).select("run", "id", "features", "y", F.when(F.col("is_test"), -1).otherwise(F.col("y")).alias("label")))
    base = similarities(hidden, sorted({c.metric for c in near}), max(ks), forests=False)
    wanted = materialize(_numbered(grid.where("graph_type <> 'mst'").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))))
    scored = label_graphs(base, wanted).join(hidden.select("run", "id", "y"), ["run", "id"])
    scores = F.broadcast(wanted).join(evaluate.accuracy(scored, ["graph"]), "graph", "left").fillna(0.0, ["accuracy"])
    best = scores.groupBy("run", "model", "metric", "graph_type").agg(F.max_by("k", F.struct("accuracy", (-F.col("k")).alias("m"))).alias("k"))
    return best.unionByName(whole)


def run_transductive(rows: DataFrame, unlabelled_share: float = 0.7, folds: int = 5, configs: list[Config] | None = None, supervised: tuple[str, ...] = ("svm", "logistic"), ks=K_RANGE, seed: int = 0) -> DataFrame:
    """``(experiment, fold, bucket, metric, value)``: every model trained on the labelled part of a fold and scored on its unlabelled part."""
    configs = parameter_grid() if configs is None else configs
    rows = materialize(rows.select("id", "features", F.col("y").cast("int").alias("y")))
    split = splits.stratified_splits(rows, "id", "y", unlabelled_share, folds, seed)
    every = materialize(rows.join(split.select(F.col("fold").cast("long").alias("run"), "id", "is_test"), "id").select("run", "id", "features", "y", F.when(F.col("is_test"), -1).otherwise(F.col("y")).alias("label")))
    labelled, rest = every.where("label >= 0").drop("label"), every.where("label < 0")
    models = fit_many(labelled, supervised).withColumn("by", F.col("run"))
    told = [predict_many(materialize(models), rest.withColumn("by", F.col("run")), "by").select(F.col("name").alias("experiment"), "run", "id", "predicted")]
    if configs:
        base = similarities(every, sorted({c.metric for c in configs}), max(ks))
        wanted = materialize(_numbered(search_runs(labelled, configs, ks, seed)))
        named = F.concat_ws("/", "model", "metric", "graph_type").alias("experiment")
        told.append(label_graphs(base, wanted).join(F.broadcast(wanted.select("graph", named)), "graph").select("experiment", "run", "id", "predicted"))
    return _reports(reduce(DataFrame.unionByName, told), rest.select("run", "id", "y"))


def run_inductive(rows: DataFrame, test_share: float = 0.3, unlabelled_share: float = 0.7, folds: int = 5, configs: list[Config] | None = None, supervised: tuple[str, ...] = ("svm", "logistic"), ks=K_RANGE, seed: int = 0) -> DataFrame:
    """``(experiment, fold, bucket, metric, value)`` over nested folds: supervised models on the labelled part alone, and on the whole training part after
    each graph model has labelled the rest of it; all scored on the outer test part. ``fold`` is outer * folds + inner."""
    configs = parameter_grid() if configs is None else configs
    rows = materialize(rows.select("id", "features", F.col("y").cast("int").alias("y")))
    roles = splits.nested_splits(rows, "id", "y", test_share, unlabelled_share, folds, seed).select((F.col("fold") * folds + F.col("inner")).cast("long").alias("run"), "id", "role")
    every = materialize(rows.join(roles, "id"))
    test, labelled = every.where("role = 'test'").drop("role"), every.where("role = 'labelled'").drop("role")
    hidden = every.where("role <> 'test'").select("run", "id", "features", "y", F.when(F.col("role") == "labelled", F.col("y")).otherwise(-1).alias("label"))
    models = [fit_many(labelled, supervised).select(F.col("run").alias("by"), F.lit(-1).cast("long").alias("run"), "name", "scale", "weights")]
    titles = rows.sparkSession.createDataFrame([(-1, "")], "run long, title string")
    if configs:
        base = similarities(hidden, sorted({c.metric for c in configs}), max(ks))
        wanted = materialize(_numbered(search_runs(labelled, configs, ks, seed)))
        told = label_graphs(base, wanted).groupBy("run", "id").agg(F.map_from_entries(F.collect_list(F.struct("graph", "predicted"))).alias("told"))
        graphs = wanted.groupBy("run").agg(F.sort_array(F.collect_list("graph")).alias("graphs"))
        filled = every.where("role <> 'test'").join(F.broadcast(graphs), "run").join(told, ["run", "id"], "left")
        labels = F.transform("graphs", lambda g: F.when(F.col("role") == "labelled", F.col("y")).otherwise(F.element_at("told", g)))
        models.append(fit_labellings(filled.select(F.col("run").alias("by"), "features", F.col("graphs").alias("runs"), labels.alias("ys")), supervised))
        titles = titles.unionByName(wanted.select(F.col("graph").alias("run"), F.concat(F.concat_ws("/", "model", "metric", "graph_type"), F.lit("+")).alias("title")))
    # a test row of a run is met by all models of that run; the model's number tells which
    scored = predict_many(materialize(reduce(DataFrame.unionByName, models)).withColumn("run", F.col("run") * folds * folds + F.col("by")), test.withColumn("by", F.col("run")), "by")
    scored = scored.select(F.floor(F.col("run") / (folds * folds)).alias("graph"), F.pmod("run", F.lit(folds * folds)).alias("run"), "name", "id", "predicted")
    scored = scored.join(F.broadcast(titles.withColumnRenamed("run", "graph")), "graph").select(F.concat("title", "name").alias("experiment"), "run", "id", "predicted")
    return _reports(scored, test.select("run", "id", "y"))


def _reports(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    report = evaluate.classification_report(predicted.join(truth, ["run", "id"]), ["experiment", "run"])
    return report.select("experiment", F.col("run").cast("int").alias("fold"), "bucket", "metric", "value")


def average_reports(reports: DataFrame) -> DataFrame:
    """Sums over folds divided by their number."""
    n = F.size(F.collect_set("fold").over(Window.partitionBy("experiment")))
    return reports.withColumn("n", n).groupBy("experiment", "bucket", "metric").agg((F.sum("value") / F.first("n")).alias("value"))


def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), parity(F.col("label")).alias("y"))


def abalone_rows(spark: SparkSession, d: str, **parameters) -> DataFrame:
    from spanweave.sources import tables

    return tables.abalone_vectors(spark, d, **parameters)


def mushroom_rows(spark: SparkSession, d: str, **parameters) -> DataFrame:
    from spanweave.sources import tables

    return tables.mushroom_vectors(spark, d, **parameters)


def anuran_rows(spark: SparkSession, d: str, **parameters) -> DataFrame:
    from spanweave.sources import tables

    return tables.anuran_vectors(spark, d, **parameters)


def reuters_rows(spark: SparkSession, d: str, **parameters) -> DataFrame:
    from spanweave.sources import tables

    return tables.reuters_vectors(spark, d, **parameters)


def newsgroup_rows(spark: SparkSession, d: str, **parameters) -> DataFrame:
    from spanweave.sources import tables

    return tables.newsgroup_vectors(spark, d, **parameters)


#: Dataset name -> rows(spark, folder of tables, **parameters) -> (id, features, y).
EXPERIMENTS: dict[str, Callable[..., DataFrame]] = {"abalone": abalone_rows, "mushroom": mushroom_rows, "anuran": anuran_rows, "digit": embedding_rows, "newsgroups": newsgroup_rows, "reuters": reuters_rows}

_TEXT = {"scorer": "tfidf", "features": 400, "normalizer": "tfidf"}
#: Name of a parameter set -> (dataset, parameters). The three of newsgroups set one branch of categories against the rest.
PARAMETERS: dict[str, tuple[str, dict]] = {
    "anuran": ("anuran", {}),
    "mushroom": ("mushroom", {}),
    "abalone": ("abalone", {"positive": (5, 6, 7, 8, 9)}),
    "newsgroups": ("newsgroups", {"prefix": "rec."} | _TEXT),
    "newsgroups2": ("newsgroups", {"prefix": "sci."} | _TEXT),
    "newsgroups3": ("newsgroups", {"prefix": "talk."} | _TEXT),
    "digit": ("digit", {}),
    "reuters": ("reuters", {"positive": "acq"} | _TEXT),
}


def get_experiment(name: str, parameters: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The dataset ``name`` under a named parameter set, by default the one of its own name."""
    if name not in EXPERIMENTS:
        raise KeyError(f"unknown experiment {name!r}; known: {', '.join(EXPERIMENTS)}")
    chosen = parameters or name
    if chosen not in PARAMETERS or PARAMETERS[chosen][0] != name:
        raise KeyError(f"unknown parameters {chosen!r} of {name!r}; known: {', '.join(p for p, (n, _) in PARAMETERS.items() if n == name)}")
    return partial(EXPERIMENTS[name], **PARAMETERS[chosen][1])


def main(spark: SparkSession, d: str, folder: str, name: str = "abalone", parameters: str | None = None, **settings) -> None:
    """Both experiments of a dataset, averaged over folds and appended to ``folder`` as text, with a log beside."""
    handler = reports.log_to_file(f"{folder}/experiment.log")
    try:
        rows = get_experiment(name, parameters)(spark, d)
        for kind, run in (("transductive", run_transductive), ("inductive", run_inductive)):
            average = materialize(average_reports(run(rows, **settings)))
            for experiment in sorted(r["experiment"] for r in average.select("experiment").distinct().collect()):
                reports.export_text(average.where(F.col("experiment") == experiment), f"{folder}/{kind}.txt", experiment)
    finally:
        log.removeHandler(handler)
        handler.close()


__all__ = ["Config", "EXPERIMENTS", "GRAPH_TYPES", "GraphInference", "GraphTransformer", "MODELS", "Pipeline", "average_reports", "best_k", "PARAMETERS", "get_experiment", "in_labels", "main", "parameter_grid", "run_inductive", "run_transductive", "search_k"]
