"""The k most similar vectors of every vector, by a forest of sorted hash strings.

As in LSH Forest (Bawa, Condie, Ganesan 2005), each tree has its own sequence of hash functions, and a vector's long hash string orders it: here a
random rotation, each direction brought to ranks (quantiles of a bounded sample, so that no outlier coarsens the rest), shifted and cut
dyadically, the bits of all directions interleaved. A tree is one sorted array over all partitions. In every tree a vector descends to
its longest-prefix match, of whatever length, and ascends from node to node, in all trees by the same number of candidates, always to the side
with the longer common prefix. The best k over all trees give a radius that holds the k nearest.

An exact check follows: in the first tree, the ascent goes on to exactly those runs of hash strings that a vector's ball touches, in whatever
partition they are. So nothing is lost to a bad hash, a partition's border or the number of candidates, which only set how
tight the radius is.

Equal vectors are collapsed first and expanded from at most k + 1 ids afterwards, so a vector that a third of all rows hold is one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.sampling import hash_sample
from spanweave.session import materialize, parallelism

#: Vectors, about, chosen by id hashes, that ranks and partition borders are read from; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Vectors of one tree in a partition, about.
PART_ROWS = 100_000
_KNOTS = 513
_TAIL = 1 / 64
_LEAF, _FAN, _QUERIES = 16, 32, 512
_ZEROS = np.array([8] + [8 - int(i).bit_length() for i in range(1, 256)])


def _finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))


class HashTree:
    """Hash strings of one tree: ``bits`` cuts of every direction, the first cuts of all directions first."""

    def __init__(self, sample: np.ndarray, seed: int, number: int, bits: int, parts: int):
        rng = np.random.default_rng([seed, number])
        dims = sample.shape[1]
        self.bits, self.width = bits, -(-bits * dims // 8)
        self.rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        self.shift = rng.uniform(0, 1, dims)
        self.knots = np.quantile(sample @ self.rotation.T, np.linspace(0, 1, _KNOTS), axis=0)
        order = np.sort(self.strings(sample))
        self.borders = order[[len(order) * p // parts for p in range(1, parts)]]

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """Place of each direction's value among the sample's, in (0, 1); values beyond the sample keep their order in a thin tail."""
        y = x @ self.rotation.T
        out = np.empty_like(y)
        grid = np.linspace(_TAIL, 1 - _TAIL, _KNOTS)
        for j in range(y.shape[1]):
            knots, v = self.knots[:, j], y[:, j]
            span = max(knots[-1] - knots[0], 1e-300)
            below, above = np.maximum((knots[0] - v) / span, 0), np.maximum((v - knots[-1]) / span, 0)
            out[:, j] = np.interp(v, knots, grid) - _TAIL * below / (1 + below) + _TAIL * above / (1 + above)
        return out

    def strings(self, x: np.ndarray) -> np.ndarray:
        cell = np.clip((self.ranks(x) + self.shift) * (0.5 * (1 << self.bits)), 0, (1 << self.bits) - 1).astype(np.int64)
        planes = (cell[:, None, :] >> np.arange(self.bits - 1, -1, -1)[None, :, None]) & 1
        return np.packbits(planes.reshape(len(x), -1).astype(np.uint8), axis=1).view(f"S{self.width}").ravel()

    def parts(self, strings: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, strings, side="right")


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _common_prefix(strings: np.ndarray, width: int) -> np.ndarray:
    """Bits that each string shares with the next; -1 before the first and after the last."""
    raw = strings.astype(f"S{width}").view(np.uint8).reshape(len(strings), width)
    differ = raw[1:] ^ raw[:-1]
    first = (differ != 0).argmax(1)
    byte = differ[np.arange(len(differ)), first]
    return np.concatenate([[-1], np.where(byte == 0, 8 * width, 8 * first + _ZEROS[byte]), [-1]])


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squares added in the order of the columns, so that equal distances are equal numbers."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for j in range(x.shape[-1]):
        d = x[..., j] - y[..., j]
        out += d * d
    return out


def _ascend(strings: np.ndarray, x: np.ndarray, width: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """Over one sorted array: the first ``candidates`` rows that each row meets ascending from its longest-prefix match, and their squared distances."""
    n = len(strings)
    steps = min(candidates, n - 1)
    prefix = _common_prefix(strings, width)
    at = np.arange(n)
    left, right, up, down = at.copy(), at.copy(), prefix[:-1].copy(), prefix[1:].copy()
    who, d2 = np.zeros((n, steps), np.int64), np.empty((n, steps))
    for k in range(steps):
        to_left = (up > down) | ((up == down) & (at - left < right - at))
        to_left = (to_left & (left > 0)) | (right == n - 1)
        left, right = np.where(to_left, left - 1, left), np.where(to_left, right, right + 1)
        who[:, k] = np.where(to_left, left, right)
        d2[:, k] = _squared(x[who[:, k]], x)
        up, down = np.where(to_left, np.minimum(up, prefix[left]), up), np.where(to_left, down, np.minimum(down, prefix[right + 1]))
    return who, d2


def _plant(trees: list[HashTree], parts: int, dims: int):
    """(vid, x) -> a row for each tree: partition, hash string, vid and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            for t, tree in enumerate(trees):
                strings = tree.strings(x)
                raw = pa.py_buffer(strings.tobytes())
                cols = [pa.array((t * parts + tree.parts(strings)).astype(np.int32)), pa.Array.from_buffers(pa.binary(tree.width), len(x), [None, raw]).cast(pa.binary()), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "hash", "vid", "x"])

    return run


def _gather(trees: list[HashTree], parts: int, dims: int, k: int, candidates: int):
    """Over partitions of the forest: each vector's best ``k`` there; the first tree's rows hand on the vector."""
    width = trees[0].width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        part, vid, x = t["part"].to_numpy(), t["vid"].to_numpy(), _matrix(t["x"].combine_chunks(), dims)
        strings = np.frombuffer(b"".join(t["hash"].to_pylist()), f"S{width}")
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            rows = rows[np.argsort(strings[rows], kind="stable")]
            n, v, y = len(rows), vid[rows], x[rows]
            who, d2 = _ascend(strings[rows], y, width, candidates)
            keep = min(k, who.shape[1])
            if keep < who.shape[1]:
                best = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
                who, d2 = np.take_along_axis(who, best, 1), np.take_along_axis(d2, best, 1)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * keep)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(y.ravel())) if p < parts else pa.nulls(n, pa.list_(pa.float64()))
            near = pa.StructArray.from_arrays([pa.array(d2.ravel()), pa.array(v[who].ravel())], names=["d2", "vid"])
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.ListArray.from_arrays(offsets, near), vector], names=["vid", "near", "x"])

    return run


def _boxes(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(x), size)
    return np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)


def _touched(low: np.ndarray, high: np.ndarray, q: np.ndarray, r2: np.ndarray) -> np.ndarray:
    gap = np.zeros(np.broadcast_shapes(low.shape, q.shape)[:-1])
    for j in range(q.shape[-1]):
        g = np.maximum(np.maximum(low[..., j] - q[..., j], q[..., j] - high[..., j]), 0)
        gap += g * g
    return gap <= r2


def _touching(low: np.ndarray, high: np.ndarray, q: np.ndarray, r2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, box) whose box the query's ball touches; ``_FAN`` boxes in a row are looked at together first."""
    n = len(low)
    starts = np.arange(0, n, _FAN)
    low2, high2 = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    for a in range(0, len(q), _QUERIES):
        part, limit = q[a : a + _QUERIES], r2[a : a + _QUERIES]
        who, run = np.nonzero(_touched(low2[None], high2[None], part[:, None], limit[:, None]))
        for b in range(0, len(who), 8192):
            i, box = who[b : b + 8192, None], run[b : b + 8192, None] * _FAN + np.arange(_FAN)
            inside = box < n
            box = np.where(inside, box, 0)
            hit = _touched(low[box], high[box], part[i], limit[i]) & inside
            yield a + np.broadcast_to(i, hit.shape)[hit], box[hit]


def _within(x: np.ndarray, q: np.ndarray, r2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x`` (in hash order) within each query's radius: blocks of (query, row, squared distance). Runs of strings that the ball misses are skipped."""
    n = len(x)
    low, high = _boxes(x, _LEAF)
    for i, leaf in _touching(low, high, q, r2):
        row = leaf[:, None] * _LEAF + np.arange(_LEAF)
        inside = row < n
        row = np.where(inside, row, 0)
        d2 = _squared(x[row], q[i][:, None])
        hit = (d2 <= r2[i][:, None]) & inside
        yield np.broadcast_to(i[:, None], hit.shape)[hit], row[hit], d2[hit]


def _route(low: np.ndarray, high: np.ndarray, dims: int):
    """(vid, r2, x) -> a row for every partition of the first tree that the ball touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for who, part in _touching(low, high, _matrix(batch.column(2), dims), batch.column(1).to_numpy()):
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[batch.column(c).take(who) for c in range(3)]], names=["part", "vid", "r2", "x"])

    return run


def _check(k: int, dims: int):
    """A partition's vectors and the queries that touch it -> ``(vid, own, near)``: ids within the radius, the best k + 1, and the vector's own ids at home."""

    def run(key, data: pa.Table, asked: pa.Table) -> pa.Table:
        data = data.take(pa.array(np.argsort(np.array(data["hash"].to_pylist()), kind="stable"))).combine_chunks() if data.num_rows else data
        asked = asked.combine_chunks()
        q, r2, asker = _matrix(asked["x"].combine_chunks(), dims), asked["r2"].to_numpy(), asked["vid"].to_numpy()
        vid = data["vid"].to_numpy()
        x = _matrix(data["x"].combine_chunks(), dims) if data.num_rows else np.empty((0, dims))
        found = list(_within(x, q, r2)) if len(x) and len(q) else []
        who, row, d2 = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(3))
        ids = data["ids"].combine_chunks()
        copies = ids.value_lengths().to_numpy() if data.num_rows else np.empty(0, np.int64)
        each = copies[row] if len(row) else np.empty(0, np.int64)
        flat = ids.take(pa.array(row)).flatten().to_numpy() if len(row) else np.empty(0, np.int64)
        home = np.repeat(vid[row] == asker[who], each) if len(row) else np.empty(0, bool)
        who, d2 = np.repeat(who, each), np.repeat(d2.astype(float), each)
        order = np.lexsort((flat, d2, who))
        who, d2, flat, home = who[order], d2[order], flat[order], home[order]
        place = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        keep = (place <= k) | home
        who, d2, flat, home = who[keep], d2[keep], flat[keep], home[keep]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.empty(0, np.int64)
        offsets = pa.array(np.concatenate([starts, [len(who)]]).astype(np.int32))
        near = pa.StructArray.from_arrays([pa.array(d2), pa.array(flat), pa.array(home)], names=["d2", "id", "own"])
        return pa.table([pa.array(asker[who[starts]], pa.int64()), pa.ListArray.from_arrays(offsets, near)], names=["vid", "near"])

    return run


_NEAR = "array<struct<d2: double, id: bigint, own: boolean>>"


def similar_vectors(df: DataFrame, id_col: str, columns: list[str], k: int = 5, trees: int = 5, candidates: int = 32, bits: int = 16, seed: int = 11) -> DataFrame:
    """``(id, neighbour, distance, rank)``: for every record its ``k`` nearest others by Euclidean distance, ties to the smaller id.

    Records are distinct ids whose ``columns`` are all numbers above 0; nulls, NaN, infinities, zeros and negatives leave a row out, and of an id's
    deliveries that differ the smallest counts. A collection of at most ``k`` records gives fewer rows, an empty one none. The result is exact; ``trees``,
    ``candidates`` (of a vector in a tree) and ``bits`` (of a direction) set how much the check has to look at.
    """
    spark, dims = df.sparkSession, len(columns)
    valid = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).where("id is not null")
    names = [f"c{i}" for i in range(dims)]
    for c in names:
        valid = valid.where(_finite(c))
    valid = valid.groupBy("id").agg(F.min(F.struct(*names)).alias("v")).select("id", "v.*")
    ranked = valid.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).where(F.col("r") <= k + 1)
    vectors = ranked.groupBy(*names).agg(F.min("id").alias("vid"), F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = materialize(vectors.select("vid", "ids", F.array(*names).alias("x")))
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, distance double, rank int")
    sample = np.array([r["x"] for r in hash_sample(vectors.select("vid", "x"), F.col("vid"), n, SAMPLE_ROWS).collect()])
    parts = min(max(math.ceil(n / PART_ROWS), math.ceil(parallelism(spark) / trees)), max(1, len(sample) // 2))
    forest = [HashTree(sample, seed, t, bits, parts) for t in range(trees)]
    planted = vectors.select("vid", "x").mapInArrow(_plant(forest, parts, dims), "part int, hash binary, vid long, x array<double>")
    gathered = planted.repartitionById(trees * parts, "part").mapInArrow(_gather(forest, parts, dims, k, candidates), "vid long, near array<struct<d2: double, vid: bigint>>, x array<double>")
    best = gathered.groupBy("vid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), F.first("x", ignorenulls=True).alias("x"))  # at most trees * k entries
    radius = F.coalesce(F.try_element_at("near", F.lit(k))["d2"], F.lit(float("inf")))
    asked = best.select("vid", radius.alias("r2"), "x")

    first = forest[0]
    at = vectors.mapInArrow(_home(first, dims), "part int, hash binary, vid long, ids array<long>, x array<double>")
    home = materialize(at)
    edges = [e for i in range(dims) for e in (F.min(F.col("x")[i]).alias(f"l{i}"), F.max(F.col("x")[i]).alias(f"h{i}"))]
    low, high = np.full((parts, dims), np.inf), np.full((parts, dims), -np.inf)
    for r in home.groupBy("part").agg(*edges).collect():  # a row per partition
        low[r["part"]], high[r["part"]] = [r[f"l{i}"] for i in range(dims)], [r[f"h{i}"] for i in range(dims)]
    routed = asked.mapInArrow(_route(low, high, dims), "part int, vid long, r2 double, x array<double>")
    found = home.groupBy("part").cogroup(routed.groupBy("part")).applyInArrow(_check(k, dims), f"vid long, near {_NEAR}")
    lists = found.groupBy("vid").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    each = lists.select(F.explode(F.filter("near", lambda e: e["own"])).alias("me"), "near").select(F.col("me.id").alias("id"), "near")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k)
    out = each.select("id", F.posexplode(others).alias("rank", "e")).select("id", F.col("e.id").alias("neighbour"), F.sqrt("e.d2").alias("distance"), (F.col("rank") + 1).alias("rank"))
    # of a vector with more than k + 1 ids, the others have the first k as their nearest
    many = vectors.where(F.size("ids") > k).select("ids", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    if many.isEmpty():
        return out
    rest = valid.join(many, names).where(F.col("id") > F.element_at("ids", -1)).select("id", F.posexplode(F.slice("ids", 1, k)).alias("rank", "neighbour"))
    return out.unionByName(rest.select("id", "neighbour", F.lit(0.0).alias("distance"), (F.col("rank") + 1).alias("rank")))


def _home(tree: HashTree, dims: int):
    """(vid, ids, x) with partition and hash string in one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                strings = tree.strings(_matrix(batch.column(2), dims))
                raw = pa.Array.from_buffers(pa.binary(tree.width), len(strings), [None, pa.py_buffer(strings.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(tree.parts(strings).astype(np.int32)), raw, *batch.columns], names=["part", "hash", "vid", "ids", "x"])

    return run


def neighbour_pairs(df: DataFrame, id_col: str, columns: list[str], k: int = 5, **forest: int) -> DataFrame:
    """``(id_col_a, id_col_b)``, a < b: pairs of which at least one is among the ``k`` nearest of the other."""
    near = similar_vectors(df, id_col, columns, k, **forest)
    return near.select(F.least("id", "neighbour").alias(f"{id_col}_a"), F.greatest("id", "neighbour").alias(f"{id_col}_b")).distinct()
