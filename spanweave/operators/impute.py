"""Filling missing values by predictive mean matching.

Each target has a linear predictor over the other fields and its group's mean of the target (the row's own value left out), fitted by normal
equations in two passes that send sums only. Categorical targets are quantified first: their levels get the scores of the first canonical
variate between level and predictor indicators. Rows with a value are donors. A row without one looks up the donors of its group whose predictions are
nearest to its own, else those of its day, else of the whole table, takes one of them, and gets that donor's observed value.

The nearest are found among all donors: donors and rows in need are sorted by group, target and prediction over ranges of bounded size, and each row in
need looks at the donors before and after it. Donors beyond a range's borders are carried over, so a group that holds a third of all rows is no more
than many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize, parallelism

#: Nearest donors one of which is taken.
NEAREST = 3
#: Rows of a sorted range, which one task holds.
RANGE_ROWS = 250_000
#: Where a donor may be found, nearest first.
SCOPES = ("group", "day", "all")
_ORDER = ["scope", "key", "f", "prediction", "h", "id"]
_BORDER = "part int, tail boolean, scope int, key string, f int, prediction double, id long, value string"
_FOUND = "id long, f int, scope int, donor long, value string, distance double"


def canonical_code(column: str, codes: dict[str, str]) -> Column:
    """The code of a value that is, trimmed and lower-cased, a key of ``codes``; else null."""
    if not codes:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    raw = F.col(f"`{column}`").cast("string")
    # most values are clean, and a clean one is found as it is
    return F.coalesce(F.try_element_at(table, raw), F.try_element_at(table, F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))))


def code_tables(codes: DataFrame) -> dict[str, dict[str, str]]:
    """``(field_name, code, meaning)`` -> for each field, lower-cased code or meaning -> code. A code list, of fixed size."""
    out: dict[str, dict[str, str]] = {}
    rows = codes.select("field_name", "code", "meaning").dropna(subset=["field_name", "code"]).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a code list has at most 100,000 entries")
    for field, code, meaning in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(field, {})[code.strip().lower()] = code
    for field, code, meaning in rows:
        if meaning:
            out[field].setdefault(meaning.strip().lower(), code)
    return out


def _design(width: list[int]):
    starts = np.concatenate([[1], 1 + np.cumsum(width)]).astype(int)

    def build(levels: np.ndarray) -> np.ndarray:
        """(rows, predictors) level numbers, 0 for none -> indicators with an intercept."""
        x = np.zeros((len(levels), starts[-1]))
        x[:, 0] = 1
        for j in range(levels.shape[1]):
            has = levels[:, j] > 0
            x[np.flatnonzero(has), starts[j] + levels[has, j] - 1] = 1
        return x

    return build, int(starts[-1])


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(df: DataFrame, fn, length: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                total += fn(batch.slice(k, 20_000))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(length)
    for i, v in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def _level_scores(xtx: np.ndarray, xty: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First canonical variate of the levels (the trivial constant one left out); unseen levels score 0."""
    scores = np.zeros(len(counts))
    seen = np.flatnonzero(counts > 0)
    if len(seen) < 2:
        return scores
    explained = xty[:, seen].T @ np.linalg.solve(xtx + 1e-6 * max(1.0, np.trace(xtx) / len(xtx)) * np.eye(len(xtx)), xty[:, seen])
    root = np.sqrt(counts[seen])
    values, vectors = np.linalg.eigh(explained / np.outer(root, root) - np.outer(root, root) / counts.sum())
    z = vectors[:, -1] / root * np.sqrt(counts.sum())
    if not np.isfinite(z).all() or values[-1] < 1e-9 or len(np.unique(z.round(9))) < 2:
        z = np.arange(len(seen), dtype=float)
    z = z - (z * counts[seen]).sum() / counts.sum()
    scores[seen] = z / max(np.sqrt((z**2 * counts[seen]).sum() / counts.sum()), 1e-12)
    return scores


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The range of a task, whose size is bounded."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _pool_of(t: pa.Table, i: int) -> tuple[int, str, int]:
    return t["scope"][i].as_py(), t["key"][i].as_py(), t["f"][i].as_py()


def _segments(t: pa.Table) -> np.ndarray:
    """A number for each row that grows where scope, key or target change."""
    change = np.zeros(t.num_rows, bool)
    for c in ("scope", "key", "f"):
        x = t[c].combine_chunks()
        change[1:] |= np.asarray(pc.not_equal(x[1:], x[:-1]))
    return np.cumsum(change)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first donors of a range's first pool and the last donors of its last pool."""
    t = _held(batches)
    if t is None:
        return
    part, pool, need = TaskContext.get().partitionId(), _segments(t), np.asarray(t["need"])
    head, tail = np.flatnonzero(~need & (pool == pool[0]))[:NEAREST], np.flatnonzero(~need & (pool == pool[-1]))[-NEAREST:]
    kept = t.take(np.concatenate([head, tail]))
    cols = [pa.array(np.full(len(kept), part, np.int32)), pa.array(np.arange(len(kept)) >= len(head)), *[kept[c].combine_chunks() for c in ("scope", "key", "f", "prediction", "id", "value")]]
    yield pa.RecordBatch.from_arrays(cols, names=["part", "tail", "scope", "key", "f", "prediction", "id", "value"])


def _scan(borders: list):
    """Over a sorted range: for each row in need one of the ``NEAREST`` donors of its pool; null where the pool is empty."""
    borders = sorted(borders, key=lambda r: r["part"])  # stable: within a range the donors keep their order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _held(batches)
        if t is None:
            return
        part, pool, need = TaskContext.get().partitionId(), _segments(t), np.asarray(t["need"])
        first, last = _pool_of(t, 0), _pool_of(t, t.num_rows - 1)
        before = [r for r in borders if r["tail"] and r["part"] < part and (r["scope"], r["key"], r["f"]) == first][-NEAREST:]
        after = [r for r in borders if not r["tail"] and r["part"] > part and (r["scope"], r["key"], r["f"]) == last][:NEAREST]
        at, asks = np.flatnonzero(~need), np.flatnonzero(need)
        if not len(asks):
            return
        own = t.take(at)
        of = np.concatenate([np.full(len(before), pool[0]), pool[at], np.full(len(after), pool[-1])])
        prediction = np.concatenate([[r["prediction"] for r in before], own["prediction"].to_numpy(), [r["prediction"] for r in after]])
        donor = np.concatenate([np.array([r["id"] for r in before], np.int64), own["id"].to_numpy(), np.array([r["id"] for r in after], np.int64)])
        value = pa.concat_arrays([pa.array([r["value"] for r in before], pa.string()), own["value"].combine_chunks().cast(pa.string()), pa.array([r["value"] for r in after], pa.string())])
        wanted, mine = t["prediction"].to_numpy()[asks], pool[asks]
        right = len(before) + np.searchsorted(at, asks)
        beside = right[:, None] + np.array([o for k in range(NEAREST) for o in (k, -k - 1)])[None]
        inside = (beside >= 0) & (beside < len(donor))
        beside = np.where(inside, beside, 0)
        if len(donor):
            inside &= of[beside] == mine[:, None]
            distance = np.where(inside, np.abs(prediction[beside] - wanted[:, None]), np.inf)
        else:
            distance = np.full(beside.shape, np.inf)
        order = np.argsort(distance, axis=1, kind="stable")[:, :NEAREST]
        count = np.minimum(inside.sum(1), NEAREST)
        rows, some = np.arange(len(asks)), count > 0
        chosen = order[rows, np.mod(t["pick"].to_numpy()[asks], np.maximum(count, 1))]
        got = pa.array(beside[rows, chosen], mask=~some)
        ask = t.take(asks)
        cols = [ask["id"].combine_chunks(), ask["f"].combine_chunks(), ask["scope"].combine_chunks(), pa.array(donor).take(got), value.take(got), pa.array(distance[rows, chosen], mask=~some)]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "f", "scope", "donor", "value", "distance"])

    return run


def _nearest(donors: DataFrame, need: DataFrame, ranges: int) -> DataFrame:
    """``donors`` and ``need(id, grp, day, f, prediction)``, the former with ``value`` -> a row of ``_FOUND`` for every row of ``need``.

    The pool is the row's group, if that has donors of the target, else its day, else all. Ties in the distance go to the neighbours in the order of id hashes.
    """
    has = [donors.where(f"{c} is not null").select(c, "f").distinct().withColumn(f"has_{c}", F.lit(True)) for c in ("grp", "day")]
    scope = F.when(F.col("has_grp"), 0).when(F.col("has_day"), 1).otherwise(2)
    keys = F.when(F.col("has_grp"), F.col("grp")).when(F.col("has_day"), F.col("day").cast("string")).otherwise("")
    placed = materialize(need.join(has[0], ["grp", "f"], "left").join(has[1], ["day", "f"], "left").select("id", "f", "prediction", scope.alias("scope"), keys.alias("key")))
    asked = placed.select("scope", "key", "f").distinct()
    sources = [donors.where("grp is not null").withColumn("key", F.col("grp")), donors.where("day is not null").withColumn("key", F.col("day").cast("string")), donors.withColumn("key", F.lit(""))]
    parts = [s.join(asked.where(F.col("scope") == i).drop("scope"), ["key", "f"], "left_semi").select("id", "f", "prediction", F.lit(i).alias("scope"), "key", "value", F.lit(False).alias("need")) for i, s in enumerate(sources)]
    both = placed.select("id", "f", "prediction", "scope", "key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("need"))
    for p in parts:
        both = both.unionByName(p)
    rows = both.withColumns({"h": F.xxhash64("id"), "pick": F.xxhash64("id", "f")})
    ordered = materialize(rows.repartitionByRange(ranges, *_ORDER).sortWithinPartitions(*_ORDER))
    borders = ordered.mapInArrow(_borders, _BORDER).collect()  # at most 2 * NEAREST donors a range
    return ordered.mapInArrow(_scan(borders), _FOUND)


def fill_log(df: DataFrame, id_col: str, targets: list[str], predictors: list[str], codes: dict[str, dict[str, str]], group_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """``(id, field, value, donor_id, donor_group, distance)``: one row for every missing value of ``targets``.

    Ids count once. A target named in ``codes`` is categorical, missing if it is no code or meaning of it; another target is numeric, missing if null or
    NaN. ``donor_group`` tells where the donor was found (``group``, ``day`` or ``all``); a target nobody has a value of stays unfilled, with null
    value and donor. A missing or hot group is fine; ties between donors are broken by the order of id hashes.
    """
    level_of = {c: {code: i + 1 for i, code in enumerate(sorted(set(codes.get(c, {}).values())))} for c in dict.fromkeys([*predictors, *targets])}
    categorical = [t in codes for t in targets]

    def level(c: str) -> Column:
        numbers = {k: str(level_of[c][v]) for k, v in codes.get(c, {}).items()}
        return F.coalesce(canonical_code(c, numbers).cast("int"), F.lit(0))

    def target(t: str, cat: bool) -> Column:
        if cat:
            return level(t).cast("double")
        x = F.col(f"`{t}`").cast("double")
        return F.when(~F.isnan(x), x)

    known = [F.when(target(t, c) > 0, target(t, c)) if c else target(t, c) for t, c in zip(targets, categorical, strict=True)]
    base = df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("grp"),
        (F.to_date(time_col) if time_col else F.lit(None).cast("date")).alias("day"),
        F.array(*[level(c) for c in predictors]).alias("x"),
        F.array(*known).alias("y"),
    )
    base = materialize(base.where("id is not null").dropDuplicates(["id"]))
    build, width = _design([len(level_of[c]) for c in predictors])
    levels = [len(level_of[t]) if c else 1 for t, c in zip(targets, categorical, strict=True)]
    size = [width * width + width * n + n + 2 for n in levels]

    def first(batch: pa.RecordBatch) -> np.ndarray:
        x, y, out = build(_matrix(batch, "x").astype(int)), _matrix(batch, "y"), []
        for j, n in enumerate(levels):
            has = ~np.isnan(y[:, j])
            xs, ys = x[has], y[has, j]
            one = np.eye(n)[ys.astype(int) - 1] if categorical[j] else ys[:, None]
            out += [(xs.T @ xs).ravel(), (xs.T @ one).ravel(), one.sum(0), [has.sum(), 0 if categorical[j] else (ys**2).sum()]]
        return np.concatenate(out)

    sums, scores, at = _sums(base, first, sum(size)), [], 0
    for j, n in enumerate(levels):
        s = sums[at : at + size[j]]
        at += size[j]
        xtx, xty, counts = s[: width * width].reshape(width, width), s[width * width : width * width + width * n].reshape(width, n), s[-n - 2 : -2]
        if categorical[j]:
            scores.append(_level_scores(xtx, xty, counts))
        else:
            mean = counts[0] / max(s[-2], 1)
            scores.append(np.array([mean, max(np.sqrt(max(s[-1] / max(s[-2], 1) - mean**2, 0)), 1e-12)]))

    def score(j: int) -> Column:
        y = F.col("y")[j]
        if categorical[j]:
            return F.element_at(F.array(*[F.lit(float(z)) for z in scores[j]]), y.cast("int")) if levels[j] else F.lit(None).cast("double")
        return (y - F.lit(float(scores[j][0]))) / F.lit(float(scores[j][1]))

    scored = base.withColumn("z", F.array(*[score(j) for j in range(len(targets))]))
    sums_of = [e for j in range(len(targets)) for e in (F.sum(F.col("z")[j]).alias(f"s{j}"), F.count(F.col("z")[j]).alias(f"n{j}"))]
    groups = scored.where("grp is not null").groupBy("grp").agg(*sums_of)
    joined = scored.join(groups, "grp", "left")
    own = lambda j: F.coalesce(F.col("z")[j], F.lit(0.0))
    has = lambda j: F.col("z")[j].isNotNull().cast("int")
    mean = F.array(*[F.coalesce((F.col(f"s{j}") - own(j)) / (F.col(f"n{j}") - has(j) + 1), F.lit(0.0)) for j in range(len(targets))])
    ready = materialize(joined.select("id", "grp", "day", "x", "y", "z", mean.alias("g")))
    w = width + 1

    def second(batch: pa.RecordBatch) -> np.ndarray:
        x, z, g, out = build(_matrix(batch, "x").astype(int)), _matrix(batch, "z"), _matrix(batch, "g"), []
        for j in range(len(targets)):
            ok = ~np.isnan(z[:, j])
            xs = np.column_stack([x[ok], g[ok, j]])
            out += [(xs.T @ xs).ravel(), xs.T @ z[ok, j]]
        return np.concatenate(out)

    sums = _sums(ready, second, len(targets) * (w * w + w)).reshape(len(targets), -1)
    betas = [np.linalg.solve(s[: w * w].reshape(w, w) + (1e-6 * max(1.0, np.trace(s[: w * w].reshape(w, w)) / w)) * np.eye(w), s[w * w :]) for s in sums]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, g, n = build(_matrix(batch, "x").astype(int)), _matrix(batch, "g"), batch.num_rows
            p = np.concatenate([np.column_stack([x, g[:, j]]) @ betas[j] for j in range(len(targets))])
            y = _matrix(batch, "y").T.ravel()
            k = len(targets)
            cols = [pa.concat_arrays([batch.column(c)] * k) for c in ("id", "grp", "day")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(np.arange(k, dtype=np.int32), n)), pa.array(y, from_pandas=True), pa.array(p)], names=["id", "grp", "day", "f", "y", "prediction"])

    long = materialize(ready.select("id", "grp", "day", "x", "y", "g").mapInArrow(predict, "id long, grp string, day date, f int, y double, prediction double"))
    names = F.array(*[F.lit(t) for t in targets])
    value = F.lit(None).cast("string")
    for j, t in enumerate(targets):
        shown = F.element_at(F.array(*[F.lit(c) for c in sorted(level_of[t])]), F.col("y").cast("int")) if categorical[j] and level_of[t] else F.col("y").cast("string")
        value = F.when(F.col("f") == j, shown).otherwise(value)
    donors = long.where("y is not null").select("id", "grp", "day", "f", "prediction", value.alias("value"))
    need = long.where("y is null").select("id", "grp", "day", "f", "prediction")
    ranges = max(parallelism(df.sparkSession), -(-len(SCOPES) * long.count() // RANGE_ROWS))
    found = _nearest(donors, need, ranges)
    where = F.when(F.col("donor").isNotNull(), F.get(F.array(*[F.lit(x) for x in SCOPES]), F.col("scope")))
    return found.select("id", F.get(names, F.col("f")).alias("field"), "value", F.col("donor").alias("donor_id"), where.alias("donor_group"), "distance")


def fill_missing(df: DataFrame, id_col: str, targets: list[str], predictors: list[str], codes: dict[str, dict[str, str]], group_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """One row per id: ``id_col``, each target with its values in canonical form and filled, ``<target>_filled`` and ``<target>_donor``."""
    log = materialize(fill_log(df, id_col, targets, predictors, codes, group_col, time_col))
    shown = [(canonical_code(t, codes[t]) if t in codes else F.when(~F.isnan(F.col(f"`{t}`").cast("double")), F.col(f"`{t}`").cast("double"))).alias(t) for t in targets]
    out = df.select(F.col(id_col).cast("long").alias(id_col), *shown).where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    per_field = [F.max(F.when(F.col("field") == t, F.struct("value", "donor_id"))).alias(f"__{i}") for i, t in enumerate(targets)]
    marks = [F.max((F.col("field") == t).cast("int")).alias(f"__m{i}") for i, t in enumerate(targets)]
    wide = log.groupBy(F.col("id").alias(id_col)).agg(*per_field, *marks)
    both = out.join(wide, id_col, "left")
    columns = [F.col(id_col)]
    for i, t in enumerate(targets):
        got = F.col(f"__{i}.value") if t in codes else F.col(f"__{i}.value").cast("double")
        columns += [F.coalesce(F.col(t), got).alias(t), ((F.coalesce(F.col(f"__m{i}"), F.lit(0)) == 1) & got.isNotNull()).alias(f"{t}_filled"), F.col(f"__{i}.donor_id").alias(f"{t}_donor")]
    return both.select(*columns)
