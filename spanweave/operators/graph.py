"""Similarity graphs: vertices, pairwise weights, influence, nearest-neighbour and spanning-forest sparsification.

``nodes(vid long, features array<double>, label int)`` has label -1 for unlabelled rows; ``edges(src, dst, weight)`` has src < dst, each
undirected edge once. All pairs of n vertices are compared in blocks: a vertex is sent to as many block pairs as there are blocks, a
block pair is one bounded matrix product, and what leaves it is what the operator needs (edges, partial sums, the best k, a local forest).

Many graphs go through the operators at once as one graph of separate parts: ``nodes`` with a column ``run`` are compared inside their run only, and their
``vid`` is unique over all runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.metrics import BLOCK_METRICS, check_metric
from spanweave.operators.components import connected_components
from spanweave.operators.ranking import with_global_rank
from spanweave.session import materialize, parallelism

#: Vertices in a block: a block pair's weights take 8 * BLOCK**2 bytes.
BLOCK = 1024
EDGES = "src long, dst long, weight double"
#: Most tasks of a comparison of all pairs, for each core: the blocks' pairs are spread over them.
TASKS_PER_CORE = 32
#: Forests of at most this many candidate edges are finished in one task.
ONE_TASK_EDGES = 300_000


@dataclass
class Graph:
    vertices: DataFrame  # vid, label, influence; of many graphs also run, and place: the number within the run
    edges: DataFrame  # src, dst, weight


def number_vertices(df: DataFrame, id_col: str, features: str, label: str, run: str | None = None) -> DataFrame:
    """``(vid, id, features, label)``, with ``run`` also ``run``: labelled rows come first, then unlabelled ones (null or negative label), both by id; run after run."""
    runs = [F.col(run).cast("long").alias("run")] if run else []
    rows = df.select(*runs, F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("features"), F.coalesce(F.col(label).cast("int"), F.lit(-1)).alias("label"))
    rows = rows.where("id is not null and features is not null").withColumn("label", F.when(F.col("label") < 0, -1).otherwise(F.col("label")))
    order = [F.col("run")] if run else []
    return with_global_rank(rows, "vid", *order, F.col("label") < 0, F.col("id")).select(*(["run"] if run else []), "vid", "id", "features", "label")


def union_labelled(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """``labelled(id, features, label)`` and ``unlabelled(id, features)`` as one table with label -1 for the latter."""
    return labelled.select("id", "features", F.col("label").cast("int").alias("label")).unionByName(unlabelled.select("id", "features", F.lit(-1).alias("label")))


def _block_pairs(nodes: DataFrame, block: int) -> tuple[DataFrame, int, int]:
    """A row per vertex and block pair (p, q), p <= q, that its block is part of; and the numbers of blocks (of the largest run) and of runs."""
    sizes = nodes.groupBy(*_run_of(nodes)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    blocks = max(1, -(-(sizes[0] or 0) // block))
    own = F.pmod(F.col("vid"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = nodes.select(*_run_of(nodes), "vid", "features", "label", own.alias("b")).withColumn("o", F.explode(others))
    return rows.select(*_run_of(nodes), "vid", "features", "label", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q")), blocks, sizes[1]


def _run_of(nodes: DataFrame) -> list[str]:
    return ["run"] if "run" in nodes.columns else []


def _per_block(nodes: DataFrame, metric: str, gamma: float | None, kernel: Callable, schema: str, block: int) -> DataFrame:
    """Run ``kernel(rows_a, rows_b, weights, same)`` on every block pair; rows are (vid, label) arrays."""
    weigh = BLOCK_METRICS[check_metric(metric)]
    return _per_pair(nodes, lambda run, a, b, x, z, same: kernel(a, b, weigh(x, z, gamma), same), schema, block)


def _per_pair(nodes: DataFrame, kernel: Callable, schema: str, block: int) -> DataFrame:
    """Run ``kernel(run, rows_a, rows_b, features_a, features_b, same)`` on every block pair."""
    placed, blocks, runs = _block_pairs(nodes, block)
    by = [*_run_of(nodes), "p", "q"]

    def run(key, table):
        p, q = key[-2].as_py(), key[-1].as_py()
        vid, label, b = (table.column(c).to_numpy() for c in ("vid", "label", "b"))
        f = table.column("features").combine_chunks()
        x = f.flatten().to_numpy().reshape(len(vid), -1) if len(vid) else np.zeros((0, 1))
        order = np.argsort(vid)
        vid, label, b, x = vid[order], label[order], b[order], x[order]
        i, j = b == p, b == q
        return pa.Table.from_pydict(kernel(key[0].as_py(), (vid[i], label[i]), (vid[j], label[j]), x[i], x[j], p == q))

    # several block pairs a task once there are many: a task holds one pair at a time, and tasks stay a small multiple of the cores
    tasks = min(runs * blocks * (blocks + 1) // 2, TASKS_PER_CORE * parallelism(nodes.sparkSession))
    return placed.repartition(max(tasks, 1), *by).groupBy(*by).applyInArrow(run, schema)


def pairwise_weights(nodes: DataFrame, metric: str = "euclidean", gamma: float | None = None, positive: bool = True, block: int = BLOCK) -> DataFrame:
    """The full graph: ``edges`` between all pairs; with ``positive`` only those of weight above 0."""

    def kernel(a, b, w, same):
        keep = np.triu(np.ones(w.shape, bool), 1) if same else np.ones(w.shape, bool)
        if positive:
            keep &= w > 0
        i, j = np.nonzero(keep)
        s, t = a[0][i], b[0][j]
        return {"src": np.minimum(s, t), "dst": np.maximum(s, t), "weight": w[i, j]}

    return _per_block(nodes, metric, gamma, kernel, EDGES, block)


def _influence_of(a, b, w, same):
    out = {"vid": [], "pos": [], "neg": []}
    for rows, others, m in ((a, b, w),) if same else ((a, b, w), (b, a, w.T)):
        un = rows[1] < 0
        out["vid"].append(rows[0][un])
        out["pos"].append(m[un][:, others[1] == 1].sum(1))
        out["neg"].append(m[un][:, others[1] == 0].sum(1))
    return {k: np.concatenate(v) for k, v in out.items()}


def influence(nodes: DataFrame, metric: str = "euclidean", gamma: float | None = None, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """``(vid, pos_weight, neg_weight, influence)``: for an unlabelled vertex 1 if its weights to label 1 sum to more than those to label 0, else 0; -1 for
    labelled ones. Sums of all weights, negative ones included, rounded to ``digits`` before comparing. Weights never leave the blocks."""

    partial = _per_block(nodes, metric, gamma, _influence_of, "vid long, pos double, neg double", block)
    sums = partial.groupBy("vid").agg(F.round(F.sum("pos"), digits).alias("pos_weight"), F.round(F.sum("neg"), digits).alias("neg_weight"))
    labelled = nodes.where("label >= 0").select("vid", F.lit(None).cast("double").alias("pos_weight"), F.lit(None).cast("double").alias("neg_weight"), F.lit(-1).alias("influence"))
    return sums.withColumn("influence", (F.col("pos_weight") > F.col("neg_weight")).cast("int")).unionByName(labelled)


def neighbour_candidates(nodes: DataFrame, metric: str = "euclidean", gamma: float | None = None, k: int = 3, block: int = BLOCK) -> DataFrame:
    """``(src, dst, weight, rank, labelled_rank)``: for each vertex its ``k`` best neighbours and its best labelled neighbour (labelled_rank 1).

    Ties go to the smaller id. Each block sends its best ``k`` and best labelled row per vertex only; all smaller k follow from ``rank``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    found = _per_block(nodes, metric, gamma, _candidates_of(k), EDGES + ", is_labelled boolean", block).distinct()
    return _ranked(found, [], k).select("src", "dst", "weight", "rank", "labelled_rank")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = [F.desc("weight"), "dst"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "src").orderBy(*order)))
    ranked = ranked.withColumn("labelled_rank", F.when(F.col("is_labelled"), F.row_number().over(Window.partitionBy(*by, "src", "is_labelled").orderBy(*order))))
    return ranked.where((F.col("rank") <= k) | (F.col("labelled_rank") == 1))


def _best(m: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest values, equal ones in column order: the start of a stable sort, without sorting all."""
    if m.shape[1] <= 4 * k:
        return np.argsort(-m, axis=1, kind="stable")[:, :k]
    m = np.where(np.isnan(m), -np.inf, m)
    least = -np.partition(-m, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero(m >= least[:, None])
    order = np.lexsort((j, -m[i, j], i))
    start = np.searchsorted(i, np.arange(len(m)))
    return j[order][start[:, None] + np.arange(k)]


def _candidates_of(k: int):
    def kernel(a, b, w, same):
        out = {"src": [], "dst": [], "weight": [], "is_labelled": []}
        for rows, others, m in ((a, b, w),) if same else ((a, b, w), (b, a, w.T)):
            m = m.copy()
            if same:
                np.fill_diagonal(m, -np.inf)
            if not m.size:
                continue
            order = _best(m, k)  # others are in vid order
            lab = np.where(others[1][None] >= 0, m, -np.inf)
            best = lab.argmax(1)[:, None]
            pick = np.concatenate([order, best], axis=1)
            val = np.take_along_axis(m, pick, 1)
            ok = np.isfinite(val)
            ok[:, -1] &= np.isfinite(np.take_along_axis(lab, best, 1))[:, 0]
            r = np.nonzero(ok)[0]
            out["src"].append(rows[0][r])
            out["dst"].append(others[0][pick[ok]])
            out["weight"].append(val[ok])
            out["is_labelled"].append(others[1][pick[ok]] >= 0)
        empty = {"src": np.int64, "dst": np.int64, "weight": np.float64, "is_labelled": bool}
        return {c: np.concatenate(v) if v else np.empty(0, empty[c]) for c, v in out.items()}

    return kernel


def knn_edges(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`knn_of` of one run's candidates in a task, sorted; ``chosen`` tells those of a k."""
    chosen = chosen & (weight > 0)
    a, b, w = np.minimum(src, dst)[chosen], np.maximum(src, dst)[chosen], weight[chosen]
    order = np.lexsort((-w, b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], w[first]


def forest_edges(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`spanning_forest` of a graph in a task."""
    keep = _kruskal(src, dst, weight)
    return src[keep], dst[keep], weight[keep]


def knn_of(candidates: DataFrame, k: int) -> DataFrame:
    """The undirected graph of ``k`` neighbours from :func:`neighbour_candidates` of at least that k; either end's choice keeps an edge."""
    chosen = candidates.where(((F.col("rank") <= k) | (F.col("labelled_rank") == 1)) & (F.col("weight") > 0))
    return chosen.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def knn_graph(nodes: DataFrame, metric: str = "euclidean", k: int = 3, gamma: float | None = None, block: int = BLOCK) -> DataFrame:
    """Edges of weight above 0 that are among the ``k`` best of an end or lead to an end's best labelled vertex."""
    return knn_of(neighbour_candidates(nodes, metric, gamma, k, block), k)


def _kruskal(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the maximum spanning forest's edges under (weight descending, src, dst).

    The heaviest edges go first, a few for each vertex and ties whole; of the rest only those between different trees are looked at again.
    """
    if not len(src):
        return np.empty(0, np.int64)
    low = min(src.min(), dst.min())
    number = int(max(src.max(), dst.max()) - low) + 1
    if number <= 4 * len(src):
        s, t = src - low, dst - low
    else:
        vid, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        number, s, t = len(vid), at[: len(src)], at[len(src) :]
    parent = list(range(number))

    def root(a: int) -> int:
        while (p := parent[a]) != a:
            parent[a] = a = parent[p]
        return a

    keep, left, most = [], np.arange(len(src)), 4 * number + 1000
    while len(left):
        rest = left[:0]
        if len(left) > 2 * most:
            w = weight[left]
            heavy = w >= -np.partition(-w, most)[most]
            if heavy.any():
                left, rest = left[heavy], left[~heavy]
        left = left[np.lexsort((dst[left], src[left], -weight[left]))]
        for e, a, b in zip(left.tolist(), s[left].tolist(), t[left].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[b] = a
                keep.append(e)
        if len(rest):
            tree = np.array([root(a) for a in range(number)])
            rest = rest[tree[s[rest]] != tree[t[rest]]]
        left = rest
    return np.array(sorted(keep), dtype=np.int64)


def _forest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "weight": pd.Series(dtype="float64")})
    for pdf in batches:
        held = pd.concat([held, pdf], ignore_index=True)
        held = held.iloc[_kruskal(held["src"].to_numpy(), held["dst"].to_numpy(), held["weight"].to_numpy())].reset_index(drop=True)
    yield held


def _boruvka(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Boruvka rounds: each component takes its best outgoing edge, the chosen edges merge components, inner edges are dropped."""
    live = materialize(edges.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    chosen: list[DataFrame] = []
    for _ in range(max_rounds):
        both = live.select("a", "src", "dst", "weight").union(live.select("b", "src", "dst", "weight"))
        best = both.groupBy("a").agg(F.max(F.struct("weight", (-F.col("src")).alias("s"), (-F.col("dst")).alias("t"))).alias("m"))
        picked = best.select((-F.col("m.s")).alias("src"), (-F.col("m.t")).alias("dst"), F.col("m.weight").alias("weight")).distinct()
        round_edges = materialize(live.join(picked.select("src", "dst"), ["src", "dst"]))
        if round_edges.isEmpty():
            break
        chosen.append(round_edges.select("src", "dst", "weight"))
        comp = connected_components(round_edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        left = live.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        left = left.select("src", "dst", "weight", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        live = materialize(left)
    else:
        raise RuntimeError(f"no spanning forest after {max_rounds} rounds")
    out = edges.select("src", "dst", "weight").limit(0)
    for x in chosen:
        out = out.unionByName(x)
    return out


def spanning_forest(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """Maximum-weight spanning forest, ties by (src, dst).

    Every partition first drops the edges that close a cycle among its own (exact, as such an edge is in no maximum forest under a total order). If few
    enough remain they are finished in one task, else by Boruvka rounds.
    """
    local = materialize(edges.select("src", "dst", "weight").mapInPandas(_forest_batches, EDGES))
    if local.count() <= one_task_edges:
        return local.coalesce(1).mapInPandas(_forest_batches, EDGES)
    return _boruvka(local)


def mst_graph(nodes: DataFrame, metric: str = "euclidean", gamma: float | None = None, block: int = BLOCK) -> DataFrame:
    """Spanning forest of the full graph; a block pair sends its own forest only, so n**2 weights never leave the blocks."""

    return spanning_forest(_per_block(nodes, metric, gamma, _forest_of, EDGES, block))


def _forest_of(a, b, w, same):
    i, j = np.nonzero(np.triu(w > 0, 1) if same else w > 0)
    s, t, v = np.minimum(a[0][i], b[0][j]), np.maximum(a[0][i], b[0][j]), w[i, j]
    keep = _kruskal(s, t, v)
    return {"src": s[keep], "dst": t[keep], "weight": v[keep]}


def compare_runs(nodes: DataFrame, metrics: list[str], k: int, forests: bool = True, digits: int = 9, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`influence`, :func:`neighbour_candidates` and, unless left out, :func:`mst_graph` of the runs of ``nodes(run, ...)`` for each metric, from one comparison of all pairs.

    The first is ``(metric, run, vid, label, influence)`` of every vertex; the others have ``metric`` and ``run`` too.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    weigh = {m: BLOCK_METRICS[check_metric(m)] for m in metrics}

    def kernel(run, a, b, x, z, same):
        parts = []
        for metric, weights in weigh.items():
            w = weights(x, z, None)
            near, inf = _candidates_of(k)(a, b, w, same), _influence_of(a, b, w, same)
            parts.append(("near", metric, near["src"], near["dst"], near["weight"], np.zeros(len(near["src"])), near["is_labelled"]))
            parts.append(("influence", metric, inf["vid"], inf["vid"], inf["pos"], inf["neg"], np.zeros(len(inf["vid"]), bool)))
            if forests:
                tree = _forest_of(a, b, w, same)
                parts.append(("forest", metric, tree["src"], tree["dst"], tree["weight"], np.zeros(len(tree["src"])), np.zeros(len(tree["src"]), bool)))
        sizes = [len(p[2]) for p in parts]
        out = {c: pa.array(np.repeat(np.array([p[i] for p in parts], object), sizes), pa.string()) for i, c in enumerate(("kind", "metric"))}
        out["run"] = pa.array(np.full(sum(sizes), run), pa.int64())
        return out | {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("src", "dst", "weight", "other", "is_labelled"), 2)}

    found = materialize(_per_pair(nodes, kernel, f"kind string, metric string, run long, {EDGES}, other double, is_labelled boolean", block))
    sums = found.where("kind = 'influence'").groupBy("metric", F.col("src").alias("vid")).agg(F.round(F.sum("weight"), digits).alias("pos"), F.round(F.sum("other"), digits).alias("neg"))
    every = nodes.select("run", "vid", "label").withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    chosen = F.when(F.col("label") >= 0, -1).otherwise((F.col("pos") > F.col("neg")).cast("int"))
    vertices = every.join(sums, ["metric", "vid"], "left").select("metric", "run", "vid", "label", chosen.alias("influence"))
    near = found.where("kind = 'near'").select("metric", "run", "src", "dst", "weight", "is_labelled").distinct()
    near = _ranked(near, ["metric"], k).select("metric", "run", "src", "dst", "weight", "rank", "labelled_rank")
    trees = found.where("kind = 'forest'").select("metric", "run", "src", "dst", "weight")
    return vertices, near, _forests_of_runs(trees) if forests else trees


def _forests_of_runs(parts: DataFrame) -> DataFrame:
    """The spanning forest of each metric and run from its blocks' forests; one of many edges is finished apart from the others."""
    by = ["metric", "run"]

    def finish(table: pa.Table) -> pa.Table:
        return table.take(pa.array(_kruskal(*(table.column(c).to_numpy() for c in ("src", "dst", "weight")))))

    large = [r[:2] for r in parts.groupBy(*by).count().where(F.col("count") > ONE_TASK_EDGES).collect()]  # a row per run that is too large for a task
    mine = lambda m, r: (F.col("metric") == m) & (F.col("run") == r)
    small = reduce(lambda df, x: df.where(~mine(*x)), large, parts)
    out = small.groupBy(*by).applyInArrow(finish, parts.schema)
    return reduce(DataFrame.unionByName, [spanning_forest(parts.where(mine(*x))).select(F.lit(x[0]).alias("metric"), F.lit(x[1]).cast("long").alias("run"), "src", "dst", "weight") for x in large], out)


def knn_mst_graph(nodes: DataFrame, metric: str = "euclidean", k: int = 3, gamma: float | None = None, block: int = BLOCK) -> DataFrame:
    """Spanning forest of the nearest-neighbour graph."""
    return spanning_forest(knn_graph(nodes, metric, k, gamma, block))


#: Graph type -> builder(nodes, metric, k, gamma).
GRAPH_TYPES: dict[str, Callable[..., DataFrame]] = {
    "full": lambda nodes, metric, k, gamma: pairwise_weights(nodes, metric, gamma),
    "knn": lambda nodes, metric, k, gamma: knn_graph(nodes, metric, k, gamma),
    "mst": lambda nodes, metric, k, gamma: mst_graph(nodes, metric, gamma),
    "knn_mst": lambda nodes, metric, k, gamma: knn_mst_graph(nodes, metric, k, gamma),
}


def build_graph(nodes: DataFrame, graph_type: str = "knn", metric: str = "euclidean", k: int = 3, gamma: float | None = None) -> Graph:
    """Vertices with label and influence, and the sparsified edges; names are checked before any work."""
    if graph_type not in GRAPH_TYPES:
        raise ValueError(f"unknown graph type {graph_type!r}; known: {', '.join(GRAPH_TYPES)}")
    check_metric(metric)
    vertices = nodes.select("vid", "label").join(influence(nodes, metric, gamma).select("vid", "influence"), "vid")
    return Graph(materialize(vertices), materialize(GRAPH_TYPES[graph_type](nodes, metric, k, gamma)))


def degrees(edges: DataFrame) -> DataFrame:
    """``(vid, degree, strength)``."""
    ends = edges.select(F.col("src").alias("vid"), "weight").unionAll(edges.select("dst", "weight"))
    return ends.groupBy("vid").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
