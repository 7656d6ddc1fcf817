import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.operators import graph as G
from spanweave.operators.components import connected_components
from spanweave.operators.ranking import with_global_rank
from pyspark.sql import functions as F

POINTS = [(0, [1.0, 1.0], 0), (1, [2.0, 3.0], 1), (2, [3.0, 5.0], 1), (3, [4.0, 0.0], -1), (4, [1.0, 0.0], -1)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(POINTS, "vid long, features array<double>, label int").cache()


def edges_of(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


def matrix():
    x = np.array([p[1] for p in POINTS])
    return ((x[:, None] - x[None]) ** 2).sum(2)


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("metric, weigh", [("euclidean", lambda d: 1 / (1 + np.sqrt(d))), ("gaussian", lambda d: np.exp(-d / 4))])
def test_pairwise_weights(nodes, metric, weigh, block):
    want, got = weigh(matrix()), edges_of(G.pairwise_weights(nodes, metric, block=block))
    assert len(got) == 10
    assert all(abs(want[e] - w) < 1e-12 for e, w in got.items())


def test_cosine_weights_keep_their_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [-1.0, 0.1], 1), (2, [1.0, 1.0], -1), (3, [0.0, 0.0], -1)], "vid long, features array<double>, label int")
    got = edges_of(G.pairwise_weights(rows, "cosine"))
    assert set(got) == {(0, 2)} and abs(got[0, 2] - 2**-0.5) < 1e-12
    assert len(edges_of(G.pairwise_weights(rows, "cosine", positive=False))) == 6


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_knn_and_mst_golden(nodes, block):
    assert set(edges_of(G.knn_graph(nodes, k=2, block=block))) == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (3, 4)}
    assert set(edges_of(G.mst_graph(nodes, block=block))) == {(0, 1), (0, 4), (1, 2), (3, 4)}


def test_influence(nodes):
    w = 1 / (1 + np.sqrt(matrix()))
    got = {r["vid"]: r["influence"] for r in G.influence(nodes, block=2).collect()}
    assert got == {0: -1, 1: -1, 2: -1, 3: int(w[3, 1] + w[3, 2] > w[3, 0]), 4: int(w[4, 1] + w[4, 2] > w[4, 0])}


def test_every_vertex_has_a_labelled_neighbour(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), int(i % 2) if i < 6 else -1) for i in range(60)]
    df = spark.createDataFrame(rows, "vid long, features array<double>, label int")
    for block in (16, 1024):
        e = set(edges_of(G.knn_graph(df, k=1, block=block)))
        ends = {a for a, b in e if b < 6} | {b for a, b in e if a < 6}
        assert set(range(60)) <= ends


def test_names_are_checked(nodes):
    with pytest.raises(ValueError):
        G.build_graph(nodes, "ring")
    with pytest.raises(ValueError):
        G.build_graph(nodes, "knn", "manhattan")
    with pytest.raises(ValueError):
        G.knn_graph(nodes, k=0)


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "vid long, features array<double>, label int")
    assert edges_of(G.knn_graph(empty)) == {} and edges_of(G.mst_graph(empty)) == {} and G.influence(empty).count() == 0


def test_vertex_numbers(spark):
    rows = spark.createDataFrame([(9, [1.0], None, "x"), (5, [1.0], 1, "x"), (7, [2.0], 0, "x"), (3, [2.0], -1, "x"), (None, [2.0], 1, "x")], "key long, f array<double>, label int, vid string")
    got = {r["id"]: (r["vid"], r["label"]) for r in G.number_vertices(rows, "key", "f", "label").collect()}
    assert got == {5: (0, 1), 7: (1, 0), 3: (2, -1), 9: (3, -1)}


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert all(r["k"] == r["pos"] for r in with_global_rank(df, "pos", F.col("k")).collect())
    assert with_global_rank(df.limit(0), "pos", F.col("k")).count() == 0


def union_find(n, edges):
    p = list(range(n))

    def root(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        p[max(x, y)] = min(x, y)
    return [root(a) for a in range(n)]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, limit):
    rng = np.random.default_rng(limit)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, size=(55, 2))] + [(i, i + 1) for i in range(100, 140)] + [(100, 100), (200, 200)]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    want = union_find(201, edges)
    got = {r["node"]: r["component"] for r in connected_components(df, one_task_edges=limit).collect()}
    assert got == {v: want[v] for e in edges for v in e}
    assert connected_components(df.limit(0), one_task_edges=limit).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_boruvka_is_kruskal(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 14, size=(25, 2)).tolist() if a != b}
    rows = [(a, b, float(rng.integers(1, 4))) for a, b in sorted(pairs)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    one, many = edges_of(G.spanning_forest(df)), edges_of(G.spanning_forest(df, one_task_edges=-1))
    assert one == many
    parts = len(set(union_find(14, pairs)))
    assert len(one) == 14 - parts


def test_forests_and_best_without_sorting_all():
    rng = np.random.default_rng(3)
    for n, ties in ((40, False), (60, True), (300, True)):
        i, j = np.nonzero(np.triu(rng.random((n, n)) < 0.9, 1))
        w = rng.integers(1, 6, len(i)) / 4 if ties else rng.random(len(i))
        parent, expected = list(range(n)), []
        for e in np.lexsort((j, i, -w)).tolist():
            a, b = int(i[e]), int(j[e])
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[b] = a
                expected.append(e)
        for far in (0, 10**12):
            mix = rng.permutation(len(i))
            assert sorted(mix[G._kruskal(i[mix] + far, j[mix] + far, w[mix])].tolist()) == sorted(expected)
        m = np.full((n, n), -np.inf)
        m[i, j] = w
        for k in (1, 3, 10):
            best = G._best(m, k)
            finite = np.isfinite(np.take_along_axis(m, best, 1))
            sort = np.argsort(-m, axis=1, kind="stable")[:, :k]
            assert (finite == np.isfinite(np.take_along_axis(m, sort, 1))).all() and (best[finite] == sort[finite]).all()
