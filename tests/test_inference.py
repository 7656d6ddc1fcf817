import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanweave.operators import inference as I
from spanweave.operators.graph import Graph

# Known graphs (labels; edges), whose labels, cut, messages and routes below must come out.
CUT = ([1, 1, 1, 1, 0, 0, 0, 0, -1, -1, -1, -1], [(0, 3, 2), (0, 6, 3), (0, 9, 5), (2, 4, 3), (3, 7, 6), (3, 10, 5), (4, 10, 6), (5, 6, 4), (6, 8, 3), (7, 11, 4)])
TREE = ([-1, 1, 1, 1, 0, 0, 0, 0, -1, -1, -1, -1], [(0, 6, 3), (0, 9, 5), (2, 7, 6), (2, 10, 5), (3, 4, 3), (4, 10, 6), (5, 6, 4), (6, 8, 3), (7, 11, 4)])
LOOP = ([1, 1, -1, -1, 0, -1], [(0, 1, 3), (0, 3, 5), (1, 2, 6), (1, 5, 3), (2, 3, 4), (3, 4, 2), (4, 5, 5)])


def graph(spark, labels, edges, influence=None):
    infl = influence or [(-1 if x >= 0 else 0) for x in labels]
    v = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(labels, infl))], "vid long, label int, influence int")
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")
    return Graph(v, e)


def labels_of(df):
    return [r["label"] for r in sorted(df.collect(), key=lambda r: r["vid"])]


def test_factor(spark):
    row = spark.range(1).select(*I.factor(F.lit(2.0), F.lit(1)), *I.factor(F.lit(3.0), F.lit(-1))).first()
    assert list(row) == [-8.0, 0.0, 0.0, -12.0]


def test_mincut_golden(spark):
    g = graph(spark, *CUT)
    labels = I.mincut_labels(g)
    assert labels_of(labels) == [1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    assert I.cut_value(g.edges, labels).first()["value"] == 17 == I.flow_value(g).first()["flow"]


def brute_cut(labels, edges):
    free = [i for i, x in enumerate(labels) if x < 0]
    best = None
    for choice in itertools.product((0, 1), repeat=len(free)):
        f = list(labels)
        for i, c in zip(free, choice):
            f[i] = c
        value = sum(w for a, b, w in edges if f[a] != f[b])
        if best is None or value < best[0]:
            best = (value, f)
    return best


def random_graph(rng, n=9, p=0.35, tree=False):
    labels = [int(x) for x in rng.choice([-1, -1, 0, 1], size=n)]
    if tree:
        edges = [(int(rng.integers(0, i)), i, float(rng.integers(1, 6))) for i in range(1, n) if rng.random() < 0.9]
    else:
        edges = [(i, j, float(rng.integers(1, 6))) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    return labels, edges


@pytest.mark.parametrize("seed", range(4))
def test_mincut_is_minimal(spark, seed):
    labels, edges = random_graph(np.random.default_rng(seed))
    g = graph(spark, labels, edges or [(0, 1, 1.0)])
    got = I.mincut_labels(g)
    assert I.cut_value(g.edges, got).first()["value"] == pytest.approx(brute_cut(labels, edges or [(0, 1, 1.0)])[0])
    assert all(a == b for a, b in zip(labels_of(got), labels) if b >= 0)


@pytest.mark.parametrize("seed", range(2))
def test_push_relabel_gives_the_same_cut(spark, seed):
    labels, edges = random_graph(np.random.default_rng(10 + seed), 10, 0.4)
    for g in (graph(spark, labels, edges), graph(spark, *CUT)):
        assert labels_of(I.mincut_labels(g)) == labels_of(I.mincut_labels(g, kernel_edges=0))


def test_max_flow_kernel_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = 6
        s, t = rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
        edges = [(i, j, float(rng.integers(1, 5))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        side, flow = I.max_flow_side(n, s, t, edges)
        value = lambda f: sum(s[i] for i in range(n) if not f[i]) + sum(t[i] for i in range(n) if f[i]) + sum(w for a, b, w in edges if f[a] != f[b])
        every = [(value(f), sum(f)) for f in itertools.product((0, 1), repeat=n)]
        assert flow == pytest.approx(min(every)[0]) and value(side) == pytest.approx(flow)
        assert side.sum() == min(size for v, size in every if v == pytest.approx(min(every)[0]))


def test_tree_golden(spark):
    g = graph(spark, *TREE)
    for limit in (10**6, 0):
        out = {r["vid"]: r for r in I.tree_inference(g, kernel_vertices=limit).collect()}
        assert [out[i]["label"] for i in range(12)] == [0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]
        assert sorted({r["component"] for r in out.values()}) == [0, 1, 2]
        assert (out[3]["m_neg"], out[3]["m_pos"]) == (-12.0, 0.0)
        assert (out[11]["m_neg"], out[11]["m_pos"]) == (0.0, 0.0)
        assert [r["vid"] for r in sorted(out.values(), key=lambda r: (r["component"], r["depth"], r["vid"]))] == [0, 6, 9, 5, 8, 1, 2, 7, 10, 4, 11, 3]


@pytest.mark.parametrize("seed", range(3))
def test_tree_is_optimal_and_levels_agree(spark, seed):
    labels, edges = random_graph(np.random.default_rng(seed), 10, tree=True)
    g = graph(spark, labels, edges, [(-1 if x >= 0 else i % 2) for i, x in enumerate(labels)])
    one, levels = I.tree_inference(g), I.tree_inference(g, kernel_vertices=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, levels.collect()))
    f = labels_of(one)
    assert sum(w for a, b, w in edges if f[a] != f[b]) == brute_cut(labels, edges)[0]


def test_tree_refuses_cycles(spark):
    with pytest.raises(ValueError):
        I.tree_inference(graph(spark, *LOOP))


def brute_flood(labels, edges, rounds, normalize=False):
    directed = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    m = {(a, b): (0.0, 0.0) for a, b, _ in directed}
    for _ in range(rounds):
        new = {}
        for s, t, w in directed:
            n = [sum(m[x, y][c] for x, y, _ in directed if y == s and x != t) for c in (0, 1)]
            rows = [(n[0], n[1] - 4 * w), (n[0] - 4 * w, n[1])]
            pick = [max(r) if labels[s] < 0 else r[labels[s]] for r in rows]
            top = max(pick) if normalize else 0
            new[s, t] = (pick[0] - top, pick[1] - top)
        m = new
    return m


@pytest.mark.parametrize("rounds", [1, 2, 5])
@pytest.mark.parametrize("normalize", [False, True])
def test_flood_rounds(spark, rounds, normalize):
    g = graph(spark, *LOOP)
    want = brute_flood(*LOOP, rounds, normalize)
    for df in (I.flood(g, rounds, normalize), I.flood_exact(g, rounds - 1, normalize), I.flood_exact(g, rounds - 1, normalize, kernel_edges=0)):
        got = {(r["src"], r["dst"]): (r["m_neg"], r["m_pos"]) for r in df.collect()}
        assert got == want


def test_flood_first_round_golden(spark):
    got = {(r["src"], r["dst"]): (r["m_neg"], r["m_pos"]) for r in I.flood(graph(spark, *LOOP), 1, False).collect()}
    assert got[0, 1] == (-12.0, 0.0) and got[0, 3] == (-20.0, 0.0) and got[3, 0] == (0.0, 0.0) and got[4, 5] == (0.0, -20.0)


def test_loop_labels_golden(spark):
    g = graph(spark, *LOOP)
    assert labels_of(I.infer(g, "graphical_loop")) == [1, 1, 1, 1, 0, 0]
    assert labels_of(I.loop_labels(g, I.flood(g, 15))) == [1, 1, 1, 1, 0, 0]


def test_loop_ties_take_influence(spark):
    g = graph(spark, [1, 0, -1, -1], [(0, 2, 2), (1, 2, 2)], [-1, -1, 1, 1])
    assert labels_of(I.loop_labels(g, I.flood(g, 4))) == [1, 0, 1, 1]


def test_randomized_vote(spark):
    g = graph(spark, *CUT)
    a, b = I.randomized_mincut(g, seed=1), I.randomized_mincut(g, seed=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    rows = {r["vid"]: r for r in a.collect()}
    assert all(rows[i]["label"] == x for i, x in enumerate(CUT[0]) if x >= 0)
    assert all(r["label"] == int(r["votes"] > r["accepted"] // 2) for r in rows.values())
    noise = I.noisy_edges(g.edges, seed=1)
    assert noise.where("weight < 0").count() == 0 and noise.where("rep = 0").exceptAll(g.edges.select(F.lit(0).alias("rep"), "src", "dst", "weight")).count() == 0


def test_accepted_cuts(spark):
    sides = spark.createDataFrame([(r, v, int(v < k)) for r, k in ((0, 0), (1, 0), (2, 50), (3, 100)) for v in range(100)], "rep int, vid long, side int")
    assert sorted(r["rep"] for r in I.accepted_cuts(sides, 100).collect()) == [0, 2]


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        I.infer(graph(spark, *LOOP), "votes")


def _flood_by_definition(src, dst, w, label, rounds):
    s, t = [*src, *dst], [*dst, *src]
    m = {(a, b): (0.0, 0.0) for a, b in zip(s, t, strict=True)}
    weight = dict(zip(zip(s, t, strict=True), [*w, *w], strict=True))
    fine = lambda x: float(np.round(x, 9)) if abs(x) < 1e6 else x
    with np.errstate(invalid="ignore", over="ignore"):
        for r in range(max(rounds.values())):
            total = {v: [np.float64(0), np.float64(0)] for v in t}
            for a, b in sorted(m):
                total[b] = [total[b][c] + m[a, b][c] for c in (0, 1)]
            new = {}
            for a, b in m:
                n = [total[a][c] - m[b, a][c] for c in (0, 1)]
                far = -4 * weight[a, b]
                x = {0: (n[0], n[0] + far), 1: (n[1] + far, n[1]), -1: (np.maximum(n[0], n[1] + far), np.maximum(n[1], n[0] + far))}[label[a]]
                new[a, b] = tuple(map(fine, x)) if r < rounds[a] else m[a, b]
            m = new
    return m


def test_flooding_ends_when_messages_are_no_numbers(spark):
    """Messages over a graph with cycles are no numbers after some hundred rounds, and then stay so: further rounds cost nothing and change nothing."""
    cycles = [(a, b, 0.2 + 0.1 * ((3 * a + b) % 5)) for a in range(6) for b in range(a + 1, 6)]
    ring = [(10, 11, 0.7), (11, 12, 0.4), (10, 12, 0.9), (12, 13, 0.5)]
    path = [(20, 21, 0.3), (21, 22, 0.8)]
    src, dst, w = zip(*cycles, *ring, *path, strict=True)
    label = {v: -1 for v in {*src, *dst}} | {0: 1, 1: 0, 10: 1, 13: 0, 20: 0}
    frame = lambda rounds: pd.DataFrame({"src": [*src, *dst], "dst": [*dst, *src], "weight": [*w, *w], "label": [label[v] for v in [*src, *dst]], "rounds": [rounds[v] for v in [*src, *dst]]})
    rounds = {v: 700 if v < 10 else 37 if v < 20 else 5 for v in label}
    got = I._flood_kernel(False)(frame(rounds))
    expected = _flood_by_definition(src, dst, w, label, rounds)
    for r in got.itertuples():
        assert np.array_equal([r.m_neg, r.m_pos], expected[r.src, r.dst], equal_nan=True), r
    assert got.where(got["src"] < 10)["m_neg"].isna().any() and got[got["src"] >= 10]["m_neg"].notna().all()
    began = time.process_time()
    long = I._flood_kernel(False)(frame({v: 5_000_000 if v < 10 else 5 for v in label}))
    assert time.process_time() - began < 20  # five million rounds of them would take minutes
    pd.testing.assert_frame_equal(got[got["src"] < 10], long[long["src"] < 10])


def test_noise_is_the_same_in_tasks(spark):
    edges = [(a, b, 0.1 * (a + b)) for a in range(7) for b in range(a + 1, 9)]
    got = I.noise_of(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    rows = I.noisy_edges(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    by = {(r["rep"], r["src"], r["dst"]): r["weight"] for r in rows}
    for rep in range(1, 5):
        for e, (a, b, w) in enumerate(edges):
            assert max(w + got[rep - 1, e], 0.0) == by[rep, a, b]
