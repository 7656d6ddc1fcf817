"""A sample that matches target category shares, drawn by the cube method (Deville, Tillé 2004).

Every record has an inclusion probability, the need of its category over the records it has; the balancing variables are the
category indicators. The flight phase moves the probabilities along directions that leave all balancing sums as they are, until they
reach 0 or 1. For indicators, such a direction joins two undecided records of one category; all disjoint pairs of a
partition are moved at once, so a partition needs as many vectorised steps as its largest category has binary digits. What stays
undecided, at most one record per category and partition, merges upward in groups of partitions and flies again. At the top, the
landing phase gives up the category sums and keeps the total: it decides the last record of each category, and the residual imbalance is reported.

Samples from several tables are drawn together: their categories are categories of one flight, and only the landing keeps each table's total.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize, parallelism

#: Probabilities closer than this to 0 or 1 are decided.
EPS = 1e-9
#: Groups merged into one at each level above the partitions.
FAN_IN = 32


def _uniform(seed: int, level: int, group: int, step: int, n: int) -> np.ndarray:
    """Random numbers that a rerun of the task draws again."""
    key = int.from_bytes(hashlib.blake2b(f"{seed}:{level}:{group}:{step}".encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(key).random(n)


def flight(p: np.ndarray, category: np.ndarray, draw) -> np.ndarray:
    """Probabilities after the flight: all but at most one record of each category are 0 or 1; category sums stay as they were.

    ``draw(step, n)`` gives uniform numbers. A step takes u = e_i - e_j for each pair of neighbours i, j of a category: with
    lambda1 = min(1 - p_i, p_j) and lambda2 = min(p_i, 1 - p_j), p moves by lambda1 u with probability lambda2 / (lambda1 + lambda2), else by -lambda2 u.
    """
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
    step = 0
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        open_ = open_[np.argsort(category[open_], kind="stable")]
        c = category[open_]
        place = np.arange(len(c)) - np.searchsorted(c, c, side="left")
        first = np.flatnonzero((place[:-1] % 2 == 0) & (c[:-1] == c[1:])) if len(c) > 1 else np.empty(0, np.int64)
        if not len(first):
            return p
        i, j = open_[first], open_[first + 1]
        up, down = np.minimum(1 - p[i], p[j]), np.minimum(p[i], 1 - p[j])
        move = np.where(draw(step, len(i)) * (up + down) < down, up, -down)
        p[i] += move
        p[j] -= move
        p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
        step += 1


def landing(p: np.ndarray, draw, table: np.ndarray | None = None) -> np.ndarray:
    """Decide what the last flight left: one flight balanced on each table's total only, then its last record by its own probability."""
    p = flight(p, np.zeros(len(p), np.int64) if table is None else table, draw)
    left = (p > 0) & (p < 1)
    p[left] = (draw(-1, int(left.sum())) < p[left]).astype(float)
    return p


def _leaf_flight(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        group, ids, cat, p = (t.column(c).to_numpy() for c in ("grp", "id", "cat", "p"))
        order = np.lexsort((cat, ids, group))
        group, ids, cat, p = group[order], ids[order], cat[order], p[order]
        out = np.empty(len(p))
        for g in np.unique(group):
            at = slice(*np.searchsorted(group, [g, g + 1]))
            # records in the order of a hash of their ids, not of the delivery
            mixed = np.argsort((ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed), kind="stable")
            flown = np.empty(len(mixed))
            flown[mixed] = flight(p[at][mixed], cat[at][mixed], lambda s, n, g=g: _uniform(seed, 0, int(g), s, n))
            out[at] = flown
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids), pa.array(cat), pa.array(out)], names=["grp", "id", "cat", "p"])

    return run


def _merge(seed: int, level: int, table_of: np.ndarray | None):
    """Fly a group's undecided records; with ``table_of`` (category -> table), the top, land them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cat", "id"], ignore_index=True)
        g = int(pdf["grp"].iloc[0])
        draw = lambda s, n: _uniform(seed, level, g, s, n)
        p = flight(pdf["p"].to_numpy(float).copy(), pdf["cat"].to_numpy(), draw)
        if table_of is not None:
            p = landing(p, lambda s, n: _uniform(seed, level + 1, g, s, n), table_of[pdf["cat"].to_numpy()])
        return pdf.assign(p=p)

    return run


def usable_records(df: DataFrame, id_col: str, category: Column, targets: DataFrame) -> DataFrame:
    """``(id, cat)``: distinct ids whose category, trimmed and lower-cased, is in ``targets(cat, key)``; an id with two counts as the first by ``cat``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(category.cast("string"))).alias("key")).where("id is not null")
    return rows.join(F.broadcast(targets.select("cat", "key")), "key").groupBy("id").agg(F.min("cat").alias("cat"))


def _merged(left: DataFrame, groups: int, seed: int, table_of: np.ndarray) -> list[DataFrame]:
    """Levels above the partitions; each level's groups hold at most ``FAN_IN`` undecided records of a category."""
    done, level = [], 1
    while True:
        last = groups <= FAN_IN
        level_df = left.withColumn("grp", F.lit(0) if last else F.floor(F.col("grp") / FAN_IN).cast("int"))
        flown = materialize(level_df.groupBy("grp").applyInPandas(_merge(seed, level, table_of if last else None), "grp int, id long, cat int, p double"))
        if last:
            return [*done, flown]
        done.append(flown.where("p = 0 or p = 1"))
        left, groups, level = flown.where("p > 0 and p < 1"), math.ceil(groups / FAN_IN), level + 1


@dataclass
class Draw:
    """What to draw from one table: ``targets`` has ``category, target_share, min_rows`` and is of the size of the category list."""

    table: str
    df: DataFrame
    id_col: str
    category: Column
    targets: DataFrame
    sample_share: float


def balanced_samples(draws: list[Draw], seed: int = 5, rows_per_group: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Draw all samples together: ``(drawn(table_name, id, category), report)``.

    A category needs the larger of ``target_share * sample_share * usable records of its table`` and ``min_rows``; one with fewer records gives all it has.
    The report has a row for every target: ``table_name, category, available, needed, drawn, residual`` (drawn less the smaller of needed and available)
    and ``short``. Ids count once; rows without a listed category are not usable; an empty table draws nothing and is short of every category.
    """
    spark = draws[0].df.sparkSession
    listed, records = [], []
    for t, d in enumerate(draws):
        rows = d.targets.select("category", "target_share", "min_rows").dropna(subset=["category"]).orderBy("category").collect()  # a category list
        mine = [(len(listed) + i, t, r["category"], float(r["target_share"] or 0.0), int(r["min_rows"] or 0)) for i, r in enumerate(rows)]
        keys = spark.createDataFrame([(i, c.strip().lower()) for i, _, c, _, _ in mine], "cat int, key string").coalesce(1)
        records.append(usable_records(d.df, d.id_col, d.category, keys))
        listed += mine
    usable_rows = materialize(reduce(DataFrame.unionByName, records))
    available = {r["cat"]: r["n"] for r in usable_rows.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per target
    usable = [sum(available.get(i, 0) for i, u, *_ in listed if u == t) for t in range(len(draws))]
    needed = {i: max(share * draws[t].sample_share * usable[t], float(least)) for i, t, _, share, least in listed}
    chance = {i: min(1.0, needed[i] / available[i]) for i in available}
    groups = max(parallelism(spark), math.ceil(sum(usable) / rows_per_group))
    table_of = np.array([t for _, t, *_ in listed], np.int64)
    p_of = F.element_at(F.create_map(*[x for i, p in chance.items() for x in (F.lit(i), F.lit(p))]), F.col("cat")) if chance else F.lit(0.0)
    placed = usable_rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), "id", "cat", p_of.alias("p"))
    flown = materialize(placed.repartition(groups, "grp").mapInArrow(_leaf_flight(seed), "grp int, id long, cat int, p double"))
    decided = [flown.where("p = 0 or p = 1"), *_merged(flown.where("p > 0 and p < 1"), groups, seed, table_of)]
    taken = reduce(DataFrame.unionByName, decided)
    names = spark.createDataFrame([(i, draws[t].table, c, float(needed[i]), int(available.get(i, 0))) for i, t, c, _, _ in listed], "cat int, table_name string, category string, needed double, available long").coalesce(1)
    drawn = taken.where("p = 1").select("id", "cat")
    counts = drawn.groupBy("cat").agg(F.count(F.lit(1)).alias("drawn"))
    report = names.join(counts, "cat", "left").select("table_name", "category", "available", "needed", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    report = report.withColumn("residual", F.col("drawn") - F.least("needed", F.col("available").cast("double"))).withColumn("short", F.col("available") < F.col("needed"))
    return drawn.join(F.broadcast(names.select("cat", "table_name", "category")), "cat").select("table_name", "id", "category"), report


def balanced_sample(df: DataFrame, id_col: str, category: Column, targets: DataFrame, sample_share: float, seed: int = 5, rows_per_group: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """One table's ``(drawn(id, category), report)``; see :func:`balanced_samples`."""
    drawn, report = balanced_samples([Draw("", df, id_col, category, targets, sample_share)], seed, rows_per_group)
    return drawn.drop("table_name"), report.drop("table_name")
