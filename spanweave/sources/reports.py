"""Report sinks: tidy parquet and fixed-width text, both appending."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.evaluate import BUCKETS, METRICS

log = logging.getLogger("spanweave")


def write_report(report: DataFrame, path: str) -> None:
    """Append ``(…, bucket, metric, value)``."""
    report.write.mode("append").parquet(path)


def report_lines(report: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(position, line)``: each bucket with its metrics over ``scale``, rounded to 2 digits, names 15 and values 10 wide."""
    cells = [F.max(F.when(F.col("metric") == m, F.round(F.col("value") / scale, 2))) for m in METRICS]
    rows = report.groupBy("bucket").agg(*[c.alias(f"v{i}") for i, c in enumerate(cells)])
    place = F.lit(len(BUCKETS))
    for i, b in enumerate(BUCKETS):
        place = F.when(F.col("bucket") == b, i).otherwise(place)
    return rows.select(place.alias("position"), F.format_string("%15s" + "%10.2f" * len(METRICS), "bucket", *[f"v{i}" for i in range(len(METRICS))]).alias("line"))


def export_text(report: DataFrame, path: str, name: str, scale: float = 1.0, message: str | None = None) -> None:
    """Append a report to a text file on the driver, line by line as they come."""
    header = "".join([" " * 15, *[f"{m:>10}" for m in METRICS]])
    with open(path, "a", encoding="utf-8") as out:
        if message is not None:
            out.write(f"\n{message}")
        out.write(f"\n{name}\n\n{header}\n")
        for r in report_lines(report, scale).orderBy("position", "line").toLocalIterator():
            out.write(f"{r['line']}\n")
    log.info("report %s appended to %s", name, path)


def log_to_file(path: str = "source.log", level: int = logging.DEBUG) -> logging.Handler:
    """Send the package's log to a file."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.addHandler(handler)
    log.setLevel(level)
    return handler
