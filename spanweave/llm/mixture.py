"""Similarity clusters by a Gaussian mixture.

Features are standardised and reduced to the principal directions that hold most of the variance (two at least); mixtures of several sizes are fitted at
once by expectation-maximisation with regularised covariances, every iteration being one pass over all rows that sends sums only; the
Bayesian information criterion picks the size, and larger sizes are added until it has risen twice. Each size starts from the best of several fits
to a bounded sample, so that few passes are left and another seed gives much the same fit. Members of highest density represent a cluster.

Chain clusters (:func:`chain_clusters`) use the mixture as a partition for an exact linking step: a record is placed in its own component and in every
component that may own a record within reach, so each link is seen inside a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.sampling import hash_sample
from spanweave.operators.components import connected_components
from spanweave.session import materialize

#: Rows, about, chosen by id hashes, that the starting mixtures are fitted to; the fit itself reads all rows.
START_ROWS = 10_000
#: Starting rows for each component, where there are more than START_ROWS over this.
START_EACH = 100
#: Starts of every size (up to four times as many on a smaller sample), and their passes over the sample before the best of them goes on for LONG_PASSES.
STARTS, SHORT_PASSES, LONG_PASSES = 15, 6, 30
#: Sizes that are fitted first; then two more at a time, up to twice the largest, until the two largest are both worse than the best.
FIRST_SIZES = (1, 2, 4, 8, 12, 16)
#: A size is given up when so many more steps like its last would not bring it level with the best.
GIVEN_UP = 20
#: Passes after which a size that hasn't settled is an error.
MOST_PASSES = 1000
_CHUNK = 8_192


@dataclass
class Mixture:
    mean: np.ndarray  # of the raw features
    scale: np.ndarray
    axes: np.ndarray  # (reduced, features)
    weights: np.ndarray
    centres: np.ndarray
    covariances: np.ndarray
    bic: dict[int, float]
    rows: int
    passes: dict[int, int] = field(default_factory=dict)  # of EM, by size

    @property
    def factors(self) -> np.ndarray:
        """Inverse Cholesky factors."""
        return np.linalg.inv(np.linalg.cholesky(self.covariances))

    @property
    def constants(self) -> np.ndarray:
        """log weight and normaliser of each component."""
        d = self.centres.shape[1]
        return np.log(self.weights) + np.log(np.abs(np.linalg.det(self.factors))) - 0.5 * d * np.log(2 * np.pi)

    def reduce(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.axes.T

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        """(rows, components) log of weight times density."""
        return _terms(z) @ _coefficients(self.weights, self.centres, self.covariances)


def _log_joint(z, centres, factors, constants):
    """The same by inverse Cholesky factors, without the cancellation of expanded squares."""
    out = np.empty((len(z), len(centres)))
    for k, (centre, factor) in enumerate(zip(centres, factors, strict=True)):
        m = (z - centre) @ factor.T
        out[:, k] = constants[k] - 0.5 * np.einsum("ni,ni->n", m, m)
    return out


def _terms(z: np.ndarray) -> np.ndarray:
    """1, the features and their products: log densities are linear in them, and so are the sums that EM needs."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)


def _coefficients(weights: np.ndarray, centres: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """(terms, components) such that terms @ coefficients are the log joint densities."""
    r = centres.shape[1]
    i, j = np.triu_indices(r)
    precision = np.linalg.inv(covariances)
    linear = np.einsum("kij,kj->ki", precision, centres)
    constant = np.log(weights) - 0.5 * (np.linalg.slogdet(covariances)[1] + r * np.log(2 * np.pi) + np.einsum("ki,ki->k", linear, centres))
    return np.concatenate([constant[:, None], linear, np.where(i == j, -0.5, -1.0) * precision[:, i, j]], axis=1).T


def _expectation(terms: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Log likelihood of the rows and each component's sums of the terms, flat."""
    joint = terms @ coefficients
    top = joint.max(1, keepdims=True)
    share = np.exp(joint - top)
    total = share.sum(1, keepdims=True)
    share /= total
    return np.concatenate([[(top + np.log(total)).sum()], (share.T @ terms).ravel()])


def _maximisation(sums: np.ndarray, centres: np.ndarray, regular: float) -> list[np.ndarray]:
    """Weights, centres and covariances from the sums of a pass; a component without rows stays where it was."""
    k, r = centres.shape
    i, j = np.triu_indices(r)
    s = sums.reshape(k, -1)
    mass = np.maximum(s[:, 0], 1e-9)
    means = s[:, 1 : 1 + r] / mass[:, None]
    second = np.empty((k, r, r))
    second[:, i, j] = second[:, j, i] = s[:, 1 + r :] / mass[:, None]
    spread = second - means[:, :, None] * means[:, None, :]
    # rounding must not leave a direction below nothing
    values, vectors = np.linalg.eigh(spread)
    spread = np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, 0), vectors)
    dead = s[:, 0] < 1e-6
    spread[dead], means[dead] = np.eye(r), centres[dead]
    return [mass / mass.sum(), means, spread + regular * np.eye(r)]


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(df: DataFrame, fn, length: int) -> np.ndarray:
    """Sum of ``fn(matrix)`` (a flat vector) over all batches; one vector per task is shuffled, its entries are added by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            x = _matrix(batch, 0) if batch.num_rows else None
            for k in range(0, batch.num_rows, _CHUNK):
                total += fn(x[k : k + _CHUNK])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(length)
    for i, v in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])


def _seeds(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds, each the best of a few drawn, refined by a few Lloyd rounds."""
    centres = [sample[rng.integers(len(sample))]]
    d = ((sample - centres[0]) ** 2).sum(1)
    squares = (sample**2).sum(1)
    for _ in range(k - 1):
        if d.sum() <= 0:
            centres.append(sample[0])
            continue
        drawn = sample[rng.choice(len(sample), size=2 + int(np.log(k)), p=d / d.sum())]
        near = np.minimum(d, np.maximum(squares - 2 * drawn @ sample.T + (drawn**2).sum(1)[:, None], 0))
        best = near.sum(1).argmin()
        centres.append(drawn[best])
        d = near[best]
    centres = np.array(centres)
    for _ in range(5):
        near = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        centres = np.array([sample[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
    return centres


def _start(sample: np.ndarray, k: int, seed: int, regular: float) -> list[np.ndarray]:
    """A mixture of ``k``: the likeliest of several fits to the sample, whatever other sizes there are."""
    rng = np.random.default_rng([seed, k])
    terms, r = _terms(sample), sample.shape[1]

    def improve(model: list[np.ndarray], passes: int) -> tuple[float, list[np.ndarray]]:
        likelihood = -np.inf
        for _ in range(passes):
            sums = _expectation(terms, _coefficients(*model))
            model = _maximisation(sums[1:], model[1], regular)
            if sums[0] - likelihood < 1e-5 * abs(sums[0]):
                break
            likelihood = sums[0]
        return sums[0], model

    fits = [improve([np.full(k, 1 / k), _seeds(sample, k, rng), np.tile(np.eye(r) * (1.0 if k == 1 else 0.5), (k, 1, 1))], SHORT_PASSES) for _ in range(min(4 * STARTS, max(STARTS, START_ROWS * STARTS // len(sample))) if k > 1 else 1)]
    return improve(max(fits, key=lambda f: f[0])[1], LONG_PASSES)[1]


def fit_mixture(df: DataFrame, id_col: str, columns: list[str], sizes: tuple[int, ...] | None = None, variance: float = 0.95, regular: float = 1e-3, max_iter: int | None = None, tolerance: float = 1e-4, seed: int = 3) -> Mixture | None:
    """Fit on all rows of ``df`` (numbers without nulls); None for an empty table.

    Without ``sizes``, they grow from ``FIRST_SIZES`` until the two largest are both worse than the best, as one may be a poor local optimum, and are halved around the best until it stays; given ones are all there are. Every size is iterated until its mean log
    likelihood changes by less than ``tolerance`` of it or it is hopelessly behind (``GIVEN_UP``); not settling in ``MOST_PASSES`` is an error. With ``max_iter`` it ends after so many passes.
    Sizes above the number of rows are left out. ``regular`` is added to every covariance's diagonal, so repeated rows and
    constant features don't collapse a component.
    """
    x = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.xxhash64(id_col).alias("h"))
    d = len(columns)
    m = _summed(x.select("x"), _moments, 1 + d + d * d)
    n = int(m[0])
    if not n:
        return None
    mean = m[1 : 1 + d] / n
    cov = m[1 + d :].reshape(d, d) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    share = np.cumsum(np.maximum(values[order], 0)) / max(np.maximum(values, 0).sum(), 1e-12)
    r = min(d, max(2, int(np.searchsorted(share, variance - 1e-12)) + 1))
    axes = vectors[:, order[:r]].T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = (((_matrix(batch, 0) - mean) / scale) @ axes.T).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * r), pa.array(z.ravel()))], names=["z"])

    z = x.select("x").mapInArrow(project, "z array<float>").persist(StorageLevel.MEMORY_AND_DISK)

    def starts(rows: int) -> np.ndarray:
        first = sorted(hash_sample(x, F.col("h"), n, rows).collect(), key=lambda f: (f["h"], f["x"]))
        return ((np.array([f["x"] for f in first or x.limit(1).collect()]) - mean) / scale) @ axes.T

    sample = starts(START_ROWS)
    models: dict[int, list] = {}
    likelihood: dict[int, float] = {}
    passes: dict[int, int] = {}
    part = 1 + r + r * (r + 1) // 2

    def settle(active: list[int]) -> None:
        for _ in range(max_iter or MOST_PASSES):
            if not active:
                return
            params = [_coefficients(*models[k]) for k in active]

            def expect(rows: np.ndarray, params=params) -> np.ndarray:
                terms = _terms(rows.astype(float))
                return np.concatenate([_expectation(terms, p) for p in params])

            sums = _summed(z, expect, sum(1 + k * part for k in active))
            at = 0
            for k in list(active):
                passes[k] = passes.get(k, 0) + 1
                new, s = sums[at] / n, sums[at + 1 : at + 1 + k * part]
                at += 1 + k * part
                gain = new - likelihood[k] if k in likelihood else np.inf
                likelihood[k] = new
                behind = criterion(k)[0] - min(criterion(j)[0] for j in likelihood if j != k) if len(likelihood) > 1 else 0.0
                # settled, or so far behind that many more steps like the last would not make it the best
                if abs(gain) < tolerance * max(1.0, abs(new)) or max_iter is None and behind > 2 * n * GIVEN_UP * abs(gain):
                    active.remove(k)
                models[k] = _maximisation(s, models[k][1], regular)
        if active and max_iter is None:
            raise RuntimeError(f"mixtures of {active} components have not settled in {MOST_PASSES} passes")

    def criterion(k: int) -> tuple[float, int]:
        return -2 * likelihood[k] * n + (k - 1 + k * r + k * r * (r + 1) / 2) * np.log(n), k

    def fit(wanted: list[int]) -> int:
        """Fit sizes; the best of all so far."""
        nonlocal sample
        if len(sample) < min(n, START_EACH * max(wanted) // 2):
            sample = starts(START_EACH * max(wanted))
        fresh = [k for k in wanted if k <= max(1, len(sample))]
        models.update({k: _start(sample, k, seed, regular) for k in fresh})
        settle(fresh)
        return min(models, key=criterion)

    try:
        best = fit(list(FIRST_SIZES if sizes is None else sizes))
        while sizes is None and sum(k > best for k in models) < 2 and 2 * max(models) <= n:
            best = fit([max(models) * 3 // 2, max(models) * 2])
        while sizes is None:
            below, above = (max((k for k in models if k < best), default=best), min((k for k in models if k > best), default=best))
            between = sorted({(below + best) // 2, (best + above) // 2} - set(models))
            if not between or fit(between) == best:
                break
            best = min(models, key=criterion)
    finally:
        z.unpersist()
    return Mixture(mean, scale, axes, *models[best], bic={k: criterion(k)[0] for k in models}, rows=n, passes=passes)


def _usable(df: DataFrame, id_col: str, columns: list[str], positive: bool) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).where("id is not null")
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        if positive:
            rows = rows.where(F.col(c) > 0)
    return rows.dropDuplicates(["id"])


def assign(rows: DataFrame, model: Mixture, columns: list[str]) -> DataFrame:
    """``(id, component, log_density)``: most probable component and the mixture's log density. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, 1)
            joint = np.concatenate([model.log_joint(model.reduce(x[k : k + _CHUNK])) for k in range(0, len(x), _CHUNK)])
            top = joint.max(1)
            density = top + np.log(np.exp(joint - top[:, None]).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joint.argmax(1).astype(np.int32)), pa.array(density)], names=["id", "component", "log_density"])

    return rows.select("id", F.array(*columns).alias("x")).mapInArrow(run, "id long, component int, log_density double")


def _filled(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Like :func:`_usable`, but a coefficient that is no finite number gets the mean of its column, which standardises to 0."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in columns]
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).where("id is not null").select("id", *finite)
    rows = materialize(rows.dropDuplicates(["id"]))
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return rows.fillna({c: means[c] if means[c] is not None else 0.0 for c in columns})


def cluster_members(df: DataFrame, id_col: str, columns: list[str], positive: bool = False, **fit) -> DataFrame | None:
    """``(id, component, log_density)`` of every record by the best mixture; None for an empty table.

    Records are distinct ids. With ``positive`` only those whose ``columns`` are all numbers above 0; else all, missing numbers being
    replaced by the column's mean.
    """
    rows = materialize(_usable(df, id_col, columns, True)) if positive else _filled(df, id_col, columns)
    model = fit_mixture(rows, "id", columns, **fit)
    return None if model is None else assign(rows, model, columns)


def similarity_clusters(df: DataFrame, id_col: str, columns: list[str], typical: int = 3, positive: bool = False, label: str | None = None, **fit) -> DataFrame:
    """``(cluster, size, share, member_rank, id_col, log_density)``: each cluster's size and its ``typical`` members of highest density.

    See :func:`cluster_members` for the records. Ties in density go to the smaller id. With ``label`` (the name of a column, trimmed and lower-cased)
    ``label, label_share`` give the cluster's most frequent label and its share of the cluster. An empty table gives no rows.
    """
    member = cluster_members(df, id_col, columns, positive, **fit)
    schema = f"cluster int, size long, share double, member_rank int, `{id_col}` long, log_density double" + (", label string, label_share double" if label else "")
    if member is None:
        return df.sparkSession.createDataFrame([], schema)
    member = materialize(member)
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0]
    if label:
        named = df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(F.col(label).cast("string"))).alias("label")).where("label is not null").groupBy("id").agg(F.min("label").alias("label"))
        counts = member.join(named, "id").groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
        modes = counts.groupBy("component").agg(F.max(F.struct("n", "label")).alias("m")).select("component", F.col("m.label").alias("label"), F.col("m.n").alias("n"))
        sizes = sizes.join(modes, "component", "left").withColumn("label_share", F.col("n") / F.col("size")).drop("n")
    best = Window.partitionBy("component").orderBy(F.desc("log_density"), "id")
    top = member.withColumn("member_rank", F.row_number().over(best)).where(F.col("member_rank") <= typical)
    out = [F.col("component").alias("cluster"), "size", (F.col("size") / total).alias("share"), "member_rank", F.col("id").alias(id_col), "log_density"]
    return top.join(F.broadcast(sizes), "component").select(*out, *(["label", "label_share"] if label else []))  # a row per component


def _halo(model: Mixture | None, reach: float, dims: int):
    """(id, x) -> a row for every component that may own a record within ``reach`` in every coordinate.

    In a component's whitened space a step within reach is at most r_c long, so its log density there lies between that at m + r_c and at
    max(0, m - r_c). A component whose upper bound is under the lower bound of the record's own can own no neighbour.
    """
    corners = np.array(np.meshgrid(*[[-reach, reach]] * dims)).reshape(dims, -1).T
    lengths = None if model is None else np.sqrt((np.einsum("kij,nj->nki", model.factors, (corners / model.scale) @ model.axes.T) ** 2).sum(2)).max(0) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, 1)
            ids = batch.column(0).to_numpy()
            z = model.reduce(x)
            m = np.sqrt(np.maximum(2 * (model.constants - _log_joint(z, model.centres, model.factors, model.constants)), 0))
            upper = model.constants - 0.5 * np.maximum(m - lengths, 0) ** 2
            lower = model.constants - 0.5 * (m + lengths) ** 2
            home = (model.constants - 0.5 * m**2).argmax(1)
            row, component = np.nonzero(upper >= lower[np.arange(len(x)), home][:, None] - 1e-9)
            cell = np.floor(x / reach).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(component.astype(np.int32)), pa.array(cell[row, 0]), pa.array(cell[row, 1]), pa.array(x[row, 0]), pa.array(x[row, 1])],
                names=["id", "component", "cx", "cy", "x", "y"],
            )

    return run


def _frontier(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions on the four staircases: the points that no other point of the cell beats towards one of the four corners."""
    keep = np.zeros(len(x), bool)
    for sx in (1, -1):
        for sy in (1, -1):
            order = np.lexsort((-sy * y, -sx * x))
            best = np.maximum.accumulate(sy * y[order])
            keep[order[np.concatenate([[True], best[1:] > best[:-1]])]] = True
    return np.flatnonzero(keep)


def _frontiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frontier points of every component and cell of this task's rows, and its smallest id; merged every few batches."""
    held: pa.Table | None = None

    def shrink(t: pa.Table) -> pa.Table:
        c, cx, cy, x, y, low = (t.column(k).to_numpy() for k in ("component", "cx", "cy", "x", "y", "low"))
        order = np.lexsort((cy, cx, c))
        same = (np.diff(c[order]) == 0) & (np.diff(cx[order]) == 0) & (np.diff(cy[order]) == 0)
        cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(order)]])
        rows, lows = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            f = at[_frontier(x[at], y[at])]
            rows.append(f)
            lows.append(np.full(len(f), low[at].min()))
        f = np.concatenate(rows)
        return pa.table({"component": c[f], "cx": cx[f], "cy": cy[f], "x": x[f], "y": y[f], "low": np.concatenate(lows)})

    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).rename_columns(["low", "component", "cx", "cy", "x", "y"]).select(["component", "cx", "cy", "x", "y", "low"])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > 200_000:
                held = shrink(held)
    if held is not None:
        yield from shrink(held).to_batches()


def chain_clusters(df: DataFrame, id_col: str, columns: tuple[str, str], reach: float = 0.03, **fit) -> DataFrame:
    """``(id_col, cluster_id)``: records joined by chains whose steps change each of two features by at most ``reach``.

    Records are distinct ids whose two features are numbers above 0. ``cluster_id`` is the smallest id of the chain; a record alone is its own.
    A step of exactly ``reach`` in decimals counts (differences are compared with 1e-9 to spare). The records of one cell of side ``reach`` are
    chained anyway, so cells are the nodes; two neighbouring cells are linked if, in some component, a point of the one is within reach of
    a point of the other, which the points on the cells' staircases decide. Only these points are shuffled, however many rows a cell holds.
    """
    cols = list(columns)
    rows = materialize(_usable(df, id_col, cols, positive=True))
    model = fit_mixture(rows, "id", cols, **({"variance": 1.0, "sizes": (1, 2, 3, 4, 6), "max_iter": 5} | fit))
    schema = "id long, component int, cx long, cy long, x double, y double"
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.col("id").alias("cluster_id"))
    placed = rows.select("id", F.array(*cols).alias("x")).mapInArrow(_halo(model, reach, 2), schema)
    corner = "component int, cx long, cy long, x double, y double, low long"
    local = placed.mapInArrow(_frontiers, corner)

    def merge(key, table):
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        f = _frontier(x, y)
        return pa.table({"component": pa.array([key[0].as_py()], pa.int32()), "cx": pa.array([key[1].as_py()], pa.int64()), "cy": pa.array([key[2].as_py()], pa.int64()), "low": pa.array([min(table.column("low").to_pylist())], pa.int64()), "xs": pa.array([x[f].tolist()]), "ys": pa.array([y[f].tolist()])})

    cells = materialize(local.groupBy("component", "cx", "cy").applyInArrow(merge, "component int, cx long, cy long, low long, xs array<double>, ys array<double>"))
    nodes = cells.groupBy("cx", "cy").agg(F.min("low").alias("node"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    a = cells.select("component", "cx", "cy", F.col("xs").alias("axs"), F.col("ys").alias("ays"), around.alias("o"))
    a = a.withColumns({"nx": F.col("cx") + F.col("o.dx"), "ny": F.col("cy") + F.col("o.dy")})
    b = cells.select("component", F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("xs").alias("bxs"), F.col("ys").alias("bys"))
    limit = reach + 1e-9

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for axs, ays, bxs, bys in zip(*(batch.column(k) for k in (4, 5, 6, 7)), strict=True):
                ax, ay, bx, by = (v.values.to_numpy() for v in (axs, ays, bxs, bys))
                keep.append(bool(((np.abs(ax[:, None] - bx) <= limit) & (np.abs(ay[:, None] - by) <= limit)).any()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], names=["cx", "cy", "nx", "ny"]).filter(pa.array(keep, pa.bool_()))

    links = a.join(b, ["component", "nx", "ny"]).select("cx", "cy", "nx", "ny", "axs", "ays", "bxs", "bys").mapInArrow(linked, "cx long, cy long, nx long, ny long").distinct()
    ends = links.join(nodes.withColumnRenamed("node", "src"), ["cx", "cy"]).join(nodes.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("node").alias("dst")), ["nx", "ny"])
    group = connected_components(ends.select("src", "dst"))
    label = nodes.join(group, "node", "left").select("cx", "cy", F.coalesce("component", "node").alias("cluster_id"))
    at = [F.floor(F.col(c) / reach).cast("long").alias(n) for c, n in zip(cols, ("cx", "cy"), strict=True)]
    return rows.select("id", *at).join(label, ["cx", "cy"]).select(F.col("id").alias(id_col), "cluster_id")
