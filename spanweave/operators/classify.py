"""Supervised baselines over ``(id, features array<double>, y)``: logistic regression and a Gaussian-kernel SVM, many fits at once.

Both are convex with a penalty of half the squared weights (the intercept is free), so they are fitted by Newton steps to one optimum, whichever way the sums of
a step are made: a fit of up to ``FIT_ROWS`` rows is one task's group, a larger one is a pass over all its rows per step that sends sums only. The kernel SVM
has squared hinge losses on random Fourier features, which approximate the Gaussian kernel with gamma = 1 / (number of features * their variance);
Spark has no kernel SVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize, parallelism

#: Training rows of one fit that a task holds.
FIT_ROWS = 100_000
#: Random Fourier directions of the kernel SVM, and their seed.
DIRECTIONS, SEED = 200, 0
NAMES = ("svm", "logistic")
_MODELS = "run long, name string, scale double, weights array<double>"


def _fourier(d: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(d, DIRECTIONS)), rng.uniform(0, 2 * np.pi, DIRECTIONS)


def lift(name: str, x: np.ndarray, scale: float) -> np.ndarray:
    """A model's inputs with an intercept; ``scale`` is the root of twice the kernel's gamma."""
    if name == "svm":
        directions, offsets = _fourier(x.shape[1])
        x = np.sqrt(2 / DIRECTIONS) * np.cos(x @ (directions * scale) + offsets)
    return np.column_stack([x, np.ones(len(x))])


def _loss(name: str, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the rows, flat."""
    sign = np.where(y == 1, 1.0, -1.0)
    m = sign * (z @ w)
    if name == "svm":
        gap = np.maximum(1 - m, 0)
        loss, slope, curve = (gap**2).sum(), -2 * sign * gap, 2.0 * (gap > 0)
    else:
        p = 1 / (1 + np.exp(np.clip(m, -700, 700)))
        loss, slope, curve = np.logaddexp(0, -m).sum(), -sign * p, p * (1 - p)
    return np.concatenate([[loss], z.T @ slope, ((z * curve[:, None]).T @ z).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], d: int, steps: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of least penalised loss; ``sums(w)`` gives loss, gradient and Hessian of the rows. A step that raises the loss is halved."""
    penalty = np.append(np.ones(d - 1), 0.0)

    def at(w: np.ndarray):
        s = sums(w)
        return s[0] + 0.5 * (penalty * w * w).sum(), s[1 : 1 + d] + penalty * w, s[1 + d :].reshape(d, d) + np.diag(penalty + 1e-9)

    w = np.zeros(d)
    loss, gradient, curvature = at(w)
    for _ in range(steps):
        step, share = np.linalg.solve(curvature, gradient), 1.0
        while True:
            new = w - share * step
            state = at(new)
            if state[0] <= loss or share < 1e-6:
                break
            share /= 2
        moved = np.abs(new - w).max()
        w, (loss, gradient, curvature) = new, state
        if moved < tolerance:
            break
    return w


def _constant(d: int, positive: bool) -> np.ndarray:
    """A training set with one class predicts it."""
    return np.append(np.zeros(d - 1), 1.0 if positive else -1.0)


def _width(name: str, features: int) -> int:
    return (DIRECTIONS if name == "svm" else features) + 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _fits(names: tuple[str, ...], x: np.ndarray, runs: list[int], ys: np.ndarray) -> list[dict]:
    """Models of the rows under each labelling, a column of ``ys``; equal labellings are fitted once."""
    variance = x.var()
    scale = float(np.sqrt(2 / (x.shape[1] * variance))) if variance > 0 else 1.0
    out = []
    for name in names:
        d, z, known = _width(name, x.shape[1]), lift(name, x, scale), {}
        for run, y in zip(runs, ys.T, strict=True):
            if (key := y.tobytes()) not in known:
                known[key] = (_constant(d, y[0] == 1) if len(np.unique(y)) < 2 else newton(lambda w, name=name, z=z, y=y: _loss(name, z, y, w), d)).tolist()
            out.append({"run": run, "name": name, "scale": scale, "weights": known[key]})
    return out


_ARROW = pa.schema([("run", pa.int64()), ("name", pa.string()), ("scale", pa.float64()), ("weights", pa.list_(pa.float64()))])


def _fit_kernel(names: tuple[str, ...]):
    def run(key, table):
        return pa.Table.from_pylist(_fits(names, _matrix(table["features"]), [key[0].as_py()], table["y"].to_numpy()[:, None]), _ARROW)

    return run


def fit_labellings(train: DataFrame, names: tuple[str, ...] = NAMES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``train(by, features, runs, ys)``, ``ys`` a row's labels under each of the ``runs``, which are the same in all rows of a ``by`` -> ``(by, run, name, scale, weights)``.

    The same as :func:`fit_many` of every labelling, but the rows of a ``by`` are sent and lifted once for all of them.
    """

    def run(key, table):
        return pa.Table.from_pylist([{"by": key[0].as_py()} | m for m in _fits(names, _matrix(table["features"]), table["runs"][0].as_py(), _matrix(table["ys"]))], _ARROW.insert(0, pa.field("by", pa.int64())))

    train = materialize(train)
    sizes = train.groupBy("by").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > fit_rows).select("by")
    models = train.join(large, "by", "left_anti").repartition(parallelism(train.sparkSession), "by").groupBy("by").applyInArrow(run, "by long, " + _MODELS)
    if large.isEmpty():
        return models
    each = train.join(large, "by").select("by", "features", F.explode(F.arrays_zip("runs", "ys")).alias("l")).select("by", F.col("l.runs").alias("run"), "features", F.col("l.ys").alias("y"))
    whose = train.join(large, "by").select("by", F.explode("runs").alias("run")).distinct()
    return models.unionByName(fit_many(each, names, fit_rows).join(whose, "run").select("by", "run", "name", "scale", "weights"))


def _fit_by_passes(train: DataFrame, name: str) -> tuple[float, np.ndarray]:
    """The same fit, each step a pass that sends one vector of sums a task."""
    first = train.agg(F.min("y"), F.max("y"), F.max(F.size("features"))).first()
    spread = train.select(F.explode("features").alias("x")).agg(F.var_pop("x")).first()[0]
    scale = float(np.sqrt(2 / (first[2] * spread))) if spread else 1.0
    d = _width(name, first[2])
    if first[0] == first[1]:
        return scale, _constant(d, first[0] == 1)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + d + d * d)
            for batch in batches:
                for k in range(0, batch.num_rows, 10_000):
                    part = batch.slice(k, 10_000)
                    x = part.column(0).flatten().to_numpy().reshape(part.num_rows, -1)
                    total += _loss(name, lift(name, x, scale), part.column(1).to_numpy(), w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        out = np.zeros(1 + d + d * d)
        for i, v in train.select("features", "y").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v
        return out

    return scale, newton(sums, d)


def fit_many(train: DataFrame, names: tuple[str, ...] = NAMES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``train(run, features, y)`` -> a model for each run and name: ``(run, name, scale, weights)``."""
    sizes = train.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    large = [r["run"] for r in sizes.where(F.col("n") > fit_rows).select("run").collect()]  # a run has more rows than a task holds: they are few
    small = train.join(sizes.where(F.col("n") <= fit_rows).select("run"), "run", "left_semi")
    models = small.select("run", "features", "y").groupBy("run").applyInArrow(_fit_kernel(names), _MODELS)
    if not large:
        return models
    rows = []
    for run in large:
        mine = materialize(train.where(F.col("run") == run).select("features", "y"))
        for name in names:
            scale, w = _fit_by_passes(mine, name)
            rows.append((run, name, scale, w.tolist()))
    return models.unionByName(train.sparkSession.createDataFrame(rows, _MODELS))


def predict_many(models: DataFrame, df: DataFrame, by: str = "run") -> DataFrame:
    """``models(by, run, name, scale, weights)`` over ``df(by, id, features)`` -> ``(run, name, id, predicted)``: every model of a ``by`` on all its rows.

    The models (a row per fit of an experiment's grid, never of the data) are sent to every task.
    """
    held: dict[int, list] = {}
    for r in models.select(by, "run", "name", "scale", "weights").toLocalIterator():
        held.setdefault(r[by], []).append((r["run"], r["name"], r["scale"], np.array(r["weights"])))
    shared = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for g in np.unique(group):
                at, lifted = np.flatnonzero(group == g), {}
                for number, name, scale, w in shared.value.get(int(g), []):
                    key = (name, scale if name == "svm" else 0.0)
                    if key not in lifted:
                        lifted = {k: v for k, v in lifted.items() if k[0] != name} | {key: lift(name, x[at], scale)}
                    positive = (lifted[key] @ w > 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array([name] * len(at)), pa.array(ids[at]), pa.array(positive)], names=["run", "name", "id", "predicted"])

    return df.select(F.col(by).cast("long"), F.col("id").cast("long"), "features").mapInArrow(run, "run long, name string, id long, predicted int")


def _one(name: str):
    def fit(train: DataFrame, df: DataFrame, id_col: str = "id", fit_rows: int = FIT_ROWS) -> DataFrame:
        zero = F.lit(0).cast("long")
        rows = materialize(train.select(zero.alias("run"), "features", "y"))
        if rows.isEmpty():
            return df.select(id_col, F.lit(0).alias("predicted"))
        models = fit_many(rows, (name,), fit_rows).withColumn("by", zero)
        return predict_many(models, df.select(zero.alias("by"), F.col(id_col).alias("id"), "features"), "by").select(F.col("id").alias(id_col), "predicted")

    return fit


#: Supervised model name -> callable(train, df, id_col) -> (id_col, predicted).
SUPERVISED = {name: _one(name) for name in NAMES}
