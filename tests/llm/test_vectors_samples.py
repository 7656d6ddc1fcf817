import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import balanced_sample as S
from spanweave.llm import mixture as M
from spanweave.llm import neighbours as V


def brute_neighbours(x, ids, k):
    out = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        near = sorted((d[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out |= {(ids[i], b) for _, b in near}
    return out


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(3000, 1)) * [1, 0.8, 2, 0.5] + rng.normal(size=(3000, 4)) * 0.05) + 0.01
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double, d double")
    got = {(r["id"], r["neighbour"]) for r in V.similar_vectors(df, "id", ["a", "b", "c", "d"]).collect()}
    want = brute_neighbours(x, list(range(3000)), 5)
    assert got == want


def test_neighbours_over_partitions_and_outliers(spark, monkeypatch):
    """Partitions of a few vectors, two far groups, and one vector that would stretch any scale: nothing is lost."""
    monkeypatch.setattr(V, "PART_ROWS", 60)
    monkeypatch.setattr(V, "_FAN", 3)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(1, 2, (500, 3)), 1000 + rng.uniform(0, 1, (40, 3)), [[1e9, 1e9, 1e9]]])
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double")
    got = {(r["id"], r["neighbour"]) for r in V.similar_vectors(df, "id", ["a", "b", "c"], k=4, trees=3, candidates=6).collect()}
    assert got == brute_neighbours(x, list(range(len(x))), 4)


def test_prefixes():
    strings = np.array([b"\x00\x00", b"\x00\x01", b"\x80\x00", b"\x80\x00"], "S2")
    assert V._common_prefix(strings, 2).tolist() == [-1, 15, 0, 16, -1]
    x = np.arange(4.0)[:, None]
    who, d2 = V._ascend(strings, x, 2, 2)
    assert who.tolist() == [[1, 2], [0, 2], [3, 1], [2, 1]] and d2[3].tolist() == [1.0, 4.0]


def test_neighbours_copies_ties_and_dirt(spark):
    rows = [(i, 1.0, 1.0) for i in range(40)] + [(100, 1.0, 2.0), (101, 2.0, 1.0), (102, 5.0, 5.0)]
    dirt = [(200, None, 1.0), (201, float("nan"), 1.0), (202, 0.0, 1.0), (203, -1.0, 1.0), (204, float("inf"), 1.0), (None, 1.0, 1.0), (0, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, 9) for r in rows + dirt], "id long, x double, y double, vid int")
    got = {}
    for r in V.similar_vectors(df, "id", ["x", "y"], k=3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    got = {i: [n for _, n in sorted(v)] for i, v in got.items()}
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[39] == [0, 1, 2] and got[100] == [0, 1, 2] and len(got) == 43
    assert got[102] == [100, 101, 0]
    two = df.where("id in (100, 101)")
    assert sorted(map(tuple, V.neighbour_pairs(two, "id", ["x", "y"]).collect())) == [(100, 101)]
    assert V.similar_vectors(df.limit(0), "id", ["x", "y"]).count() == 0
    assert V.similar_vectors(df.where("id = 100"), "id", ["x", "y"]).count() == 0


def brute_chains(points, reach):
    ids = sorted(points)
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in ids if abs(points[i][0] - points[j][0]) <= reach + 1e-9 and abs(points[i][1] - points[j][1]) <= reach + 1e-9) for i in ids}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0.1, 3, size=(8, 2))
    x = np.abs(centres[rng.integers(0, 8, 500)] + rng.normal(scale=0.08, size=(500, 2))) + 1e-3
    x[:10] *= 10
    points = {i: tuple(map(float, row)) for i, row in enumerate(x)}
    rows = [(i, *p) for i, p in points.items()] + [(0, *points[0]), (900, None, 1.0), (901, float("nan"), 1.0), (902, 0.0, 1.0), (903, 1.0, -1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, length double, weight double, cx int")
    got = {r["id"]: r["cluster_id"] for r in M.chain_clusters(df, "id", ("length", "weight"), 0.03, sizes=(1, 2, 4)).collect()}
    assert got == brute_chains(points, 0.03)


def test_chains_edges(spark):
    rows = [(5, 0.5, 1.0), (7, 0.53, 1.03), (6, 0.56, 1.06), (9, 0.591, 1.06), (20, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "id long, length double, weight double")
    got = {r["id"]: r["cluster_id"] for r in M.chain_clusters(df, "id", ("length", "weight")).collect()}
    assert got == {5: 5, 7: 5, 6: 5, 20: 5, 9: 9}
    assert M.chain_clusters(df.limit(0), "id", ("length", "weight")).count() == 0
    one = df.where("id = 9")
    assert [tuple(r) for r in M.chain_clusters(one, "id", ("length", "weight")).collect()] == [(9, 9)]


def test_mixture_finds_groups(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [6, 6, 0], [-6, 6, 3]])
    truth = rng.integers(0, 3, 1500)
    x = centres[truth] + rng.normal(size=(1500, 3))
    rows = [(i, *map(float, r), "ABC"[t]) for i, (r, t) in enumerate(zip(x, truth))]
    rows += [(2000, None, 0.0, 0.0, "A"), (2001, float("nan"), None, None, None), rows[0], (None, 0.0, 0.0, 0.0, "A")]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, component string")
    out = M.similarity_clusters(df, "id", ["a", "b", "c"], typical=2, label="component", sizes=(1, 2, 3, 4)).collect()
    assert len({r["cluster"] for r in out}) == 3 and sum(r["size"] for r in out if r["member_rank"] == 1) == 1502
    for r in out:
        assert r["label_share"] > 0.95 and r["label"] == "abc"[truth[r["id"]]] if r["id"] < 1500 else True
    assert M.similarity_clusters(df.limit(0), "id", ["a", "b"], label="component").count() == 0
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(30)], "id long, a double, b double")
    got = M.similarity_clusters(same, "id", ["a", "b"]).collect()
    assert [r["size"] for r in got] == [30] * 3 and sorted(r["id"] for r in got) == [0, 1, 2]


def test_sizes_grow_until_the_criterion_rises(spark):
    rng = np.random.default_rng(2)
    rows = [(60 * c + i, *map(float, rng.normal((10 * (c % 6), 10 * (c // 6)), 0.3))) for c in range(30) for i in range(60)]
    model = M.fit_mixture(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"])
    best = min(model.bic, key=model.bic.get)
    assert len(model.weights) == best >= 24 and max(model.bic) > best
    assert set(model.passes) == set(model.bic) and all(1 < p < M.MOST_PASSES for p in model.passes.values())
    with_few = M.fit_mixture(spark.createDataFrame(rows[:5], "id long, a double, b double"), "id", ["a", "b"])
    assert max(with_few.bic) <= 5


def test_flight_keeps_sums():
    rng = np.random.default_rng(0)
    cat = rng.integers(0, 7, 5000)
    p = rng.random(7)[cat]
    flown = S.flight(p.copy(), cat, lambda s, n: rng.random(n))
    for c in range(7):
        assert flown[cat == c].sum() == pytest.approx(p[cat == c].sum())
        assert ((flown[cat == c] > 0) & (flown[cat == c] < 1)).sum() <= 1
    assert set(np.unique(S.landing(flown, lambda s, n: rng.random(n)))) <= {0.0, 1.0}


def test_flight_inclusion_probabilities():
    rng = np.random.default_rng(1)
    p = np.array([0.2, 0.5, 0.8, 0.5, 0.3, 0.7])
    hits = np.zeros(6)
    for _ in range(4000):
        hits += S.landing(S.flight(p.copy(), np.array([0, 0, 0, 1, 1, 1]), lambda s, n: rng.random(n)), lambda s, n: rng.random(n))
    assert np.abs(hits / 4000 - p).max() < 0.04


def test_sample(spark):
    rows = [(i, " Big " if i % 3 else "big") for i in range(900)] + [(i, "MID") for i in range(1000, 1100)] + [(i, "tiny") for i in range(2000, 2004)]
    rows += [(5000, None), (5001, ""), (5002, "other"), rows[0], (None, "big")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, kind string, cat int")
    targets = spark.createDataFrame([("big", 0.5, 5), ("Mid", 0.4, 5), ("tiny", 0.1, 10), ("none", 0.0, 3), (None, 0.5, 1)], "category string, target_share double, min_rows int")
    drawn, report = S.balanced_sample(df, "id", F.col("kind"), targets, 0.2)
    got = {r["category"]: r for r in report.collect()}
    usable = 1004
    assert got["big"]["needed"] == pytest.approx(0.1 * usable) and abs(got["big"]["residual"]) < 1 and abs(got["Mid"]["residual"]) < 1
    assert got["tiny"]["short"] and got["tiny"]["drawn"] == 4 and got["none"]["available"] == 0 and got["none"]["short"] and not got["big"]["short"]
    ids = [r["id"] for r in drawn.collect()]
    assert len(ids) == len(set(ids)) == sum(r["drawn"] for r in got.values())
    again, _ = S.balanced_sample(df.repartition(3), "id", F.col("kind"), targets, 0.2)
    assert sorted(ids) == sorted(r["id"] for r in again.collect())
    empty, report = S.balanced_sample(df.limit(0), "id", F.col("kind"), targets, 0.2)
    assert empty.count() == 0 and all(r["short"] and r["drawn"] == 0 for r in report.collect())


def test_samples_of_several_tables(spark):
    """Drawn together, each table keeps its total; the same ids and categories in two tables don't meet."""
    a = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("c"))
    b = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("c"))
    share = lambda n: spark.createDataFrame([(str(k), 1.0 / n, 2) for k in range(n)], "category string, target_share double, min_rows int")
    drawn, report = S.balanced_samples([S.Draw("a", a, "id", F.col("c"), share(7), 0.1), S.Draw("b", b, "id", F.col("c"), share(3), 0.21)], rows_per_group=100)
    assert all(abs(r["residual"]) < 1 for r in report.collect()) and report.count() == 10
    counts = {r["table_name"]: r["count"] for r in drawn.groupBy("table_name").count().collect()}
    assert abs(counts["a"] - 300) <= 1 and abs(counts["b"] - 210) <= 1
    assert drawn.where("table_name = 'b' and id >= 1000").count() == 0 and drawn.distinct().count() == drawn.count()


def test_sample_many_groups(spark):
    """More groups than one merge takes: undecided records go up two levels."""
    df = spark.range(20_000).select("id", (F.col("id") % 3).cast("string").alias("c"))
    targets = spark.createDataFrame([("0", 0.5, 1), ("1", 0.3, 1), ("2", 0.2, 1)], "category string, target_share double, min_rows int")
    drawn, report = S.balanced_sample(df, "id", F.col("c"), targets, 0.1, rows_per_group=200)
    assert all(abs(r["residual"]) < 1 for r in report.collect()) and abs(drawn.count() - 2000) <= 1
