"""How often, and in how many records, every distinct term occurs: external sort and run-length scan.

Each record gives a row (term, record, n) for each of its terms, n being its count there. The rows are range-partitioned and sorted by term and
record, so a term that a third of the corpus holds is spread over as many partitions as its rows fill, none of which must fit in
memory. A scan over each sorted partition counts runs; a term's partial counts are added up at the end, one row per term and partition.

The ranges' borders are quantiles of a bounded sample of the rows, so that texts are cut into words once; borders only decide where a row is sorted.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.sampling import hash_sample
from spanweave.session import materialize, parallelism

_RUN = re.compile(r"[^\W_]+")
_BLOCK_CHARS = 4_000_000
#: Records, about, chosen by id hashes, and rows of theirs that borders are taken from; rows of a range, about; terms whose range a worker remembers.
SAMPLE_RECORDS, SAMPLE_ROWS, RANGE_ROWS, _MEMO = 2_000, 20_000, 4_000_000, 500_000


def record_words(text: str) -> list[str]:
    """Maximal runs of letters or digits, lower-cased. Lower-casing first is faster, and the same if no letter grows and no sigma looks beyond its word."""
    low = text.lower()
    if len(low) == len(text) and "\u03a3" not in text:
        return _RUN.findall(low)
    return [w.lower() for w in _RUN.findall(text)]


class _Ranges(dict):
    """Term -> number of its range; None for a term that borders cut, whose range depends on the record."""

    def __init__(self, borders: list[tuple[str, int]]):
        super().__init__()
        self.borders, self.cut = borders, {t for t, _ in borders}

    def __missing__(self, term: str) -> int | None:
        if len(self) >= _MEMO:
            self.clear()
        found = self[term] = None if term in self.cut else bisect_right(self.borders, (term, 0))
        return found

    def of(self, term: str, record: int) -> int:
        return bisect_right(self.borders, (term, record))


def _blocks(batch: pa.RecordBatch) -> Iterator[list[tuple[int, str]]]:
    """(record, text) by record, in blocks of bounded size."""
    held, size = [], 0
    for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            held.append((record, text))
            size += len(text)
            if size > _BLOCK_CHARS:
                yield sorted(held)
                held, size = [], 0
    if held:
        yield sorted(held)


def _record_terms(borders: list[tuple[str, int]]):
    """(record, text) -> (part, term, record, n), block by block in order of term and record: runs that the sort has only to merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(borders)
        for batch in batches:
            for block in _blocks(batch):
                records, counts = defaultdict(list), defaultdict(list)
                for record, text in block:
                    for term, n in Counter(record_words(text)).items():
                        records[term].append(record)
                        counts[term].append(n)
                terms = sorted(records)
                sizes = np.array([len(records[t]) for t in terms], np.int64)
                at = [ranges[t] for t in terms]
                part = np.repeat(np.array([-1 if p is None else p for p in at], np.int32), sizes)
                record = np.fromiter(chain.from_iterable(records[t] for t in terms), np.int64, sizes.sum())
                start = 0
                for t, p, n in zip(terms, at, sizes.tolist(), strict=True):
                    if p is None:
                        part[start : start + n] = [ranges.of(t, r) for r in records[t]]
                    start += n
                n = np.fromiter(chain.from_iterable(counts[t] for t in terms), np.int32, len(record))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(terms, pa.string()).take(pa.array(np.repeat(np.arange(len(terms)), sizes))), pa.array(record), pa.array(n)], names=["part", "term", "record", "n"])

    return run


_ROWS = "part int, term string, record long, n int"


def _borders(rows: DataFrame, records: int) -> list[tuple[str, int]]:
    """Borders of as many ranges as the rows fill."""
    chosen = hash_sample(rows, F.col("record"), records, SAMPLE_RECORDS).dropDuplicates(["record"])
    sample = materialize(chosen.mapInArrow(_record_terms([]), _ROWS).select(F.substring("term", 1, 100).alias("term"), "record"))
    n, held = sample.agg(F.count(F.lit(1)), F.countDistinct("record")).first()
    ranges = max(parallelism(rows.sparkSession), math.ceil(n / max(held, 1) * records / RANGE_ROWS))
    kept = sorted((r["term"], r["record"]) for r in hash_sample(sample, F.concat("term", F.col("record").cast("string")), n, SAMPLE_ROWS).collect())
    return sorted({kept[len(kept) * k // ranges] for k in range(1, ranges)}) if kept else []


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, record, n descending) -> (term, occurrences, records) per run of a batch; a run may go on in the next batch.

    Only the first row of a (term, record) run counts: the others are deliveries of the same record.
    """
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, record, count = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        new_term, new_record = np.ones(n, bool), np.ones(n, bool)
        new_term[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_record[1:] = new_term[1:] | (record[1:] != record[:-1])
        if last is not None and last[0] == term[0].as_py():
            new_record[0] = last[1] != record[0]
        last = (term[n - 1].as_py(), record[-1])
        starts = np.flatnonzero(new_term)
        occurrences = np.add.reduceat(np.where(new_record, count, 0).astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays([term.take(pa.array(starts)), pa.array(occurrences), pa.array(np.add.reduceat(new_record.astype(np.int64), starts))], names=["term", "occurrences", "records"])


def _count(ranges: DataFrame) -> DataFrame:
    ordered = ranges.select("term", "record", "n").sortWithinPartitions(F.col("term"), F.col("record"), F.desc("n"))
    partial = ordered.mapInArrow(_scan_runs, "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(df: DataFrame, id_col: str, text: Column, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """``(term, occurrences, records, kind)`` for every word of ``text``.

    Records are distinct non-null ids; a record delivered several times counts once, a term as often as in the delivery that has it most. ``kind`` is ``rare`` if fewer than ``rare_below`` records hold the term, else ``common`` if more than ``common_above`` of
    all records do (those without text included), else ``useful``. Null and empty texts have no terms; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("record"), text.cast("string").alias("text")).where("record is not null")
    total = df.select(F.col(id_col).cast("long").alias("r")).where("r is not null").distinct().count()
    borders = _borders(rows, total)
    counted = _count(rows.mapInArrow(_record_terms(borders), _ROWS).repartitionById(len(borders) + 1, "part"))
    kind = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common").otherwise("useful")
    return counted.withColumn("kind", kind)


def value_frequencies(df: DataFrame, id_col: str, columns: list[str], rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """``(field, value, occurrences, records, kind)`` for every distinct value of ``columns``, by the same sort and scan.

    Values are compared as text; nulls are no values. An occurrence is a distinct (record, field), so redelivered rows count once;
    a record whose deliveries differ counts for each of its values.
    """
    ids = df.select(F.col(id_col).cast("long").alias("r")).where("r is not null")
    total = ids.distinct().count()
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(id_col).cast("long").alias("record"), F.explode(pairs).alias("p")).where("record is not null and p.value is not null")
    counted = _count(rows.select(F.concat_ws("\x1f", "p.field", "p.value").alias("term"), "record", F.lit(1).alias("n")).repartitionByRange("term", "record"))
    kind = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common").otherwise("useful")
    parts = F.split("term", "\x1f", 2)
    return counted.select(parts[0].alias("field"), parts[1].alias("value"), "occurrences", "records", kind.alias("kind"))
