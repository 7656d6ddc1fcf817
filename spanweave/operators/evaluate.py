"""Classification reports as tidy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1-score", "support")
#: Order of a report's rows and metrics in text.
BUCKETS = ("0", "1", "micro avg", "macro avg", "weighted avg")


def confusion(df: DataFrame, by: list[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    """``(*by, y, predicted, n)``."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, by: list[str] | None = None, y: str = "y", predicted: str = "predicted", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """``(*by, bucket, metric, value)``: precision, recall, F1 and support of each class and their micro, macro and weighted averages.

    One shuffle of the confusion counts; undefined ratios are 0. Rows with a null prediction count as wrong.
    """
    by = by or []
    counts = confusion(df, by, y, predicted)
    sums = []
    for c in classes:
        sums += [
            F.sum(F.when((F.col("y") == c) & (F.col("predicted") == c), F.col("n")).otherwise(0)).alias(f"tp{c}"),
            F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(f"pp{c}"),
            F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"sp{c}"),
        ]
    wide = counts.groupBy(*by).agg(*sums) if by else counts.agg(*[F.coalesce(s, F.lit(0)).alias(f"{k}{c}") for (k, c), s in zip([(k, c) for c in classes for k in ("tp", "pp", "sp")], sums, strict=True)])
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    f1 = lambda p, r: F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0)
    per = {c: (p := ratio(F.col(f"tp{c}"), F.col(f"pp{c}")), r := ratio(F.col(f"tp{c}"), F.col(f"sp{c}")), f1(p, r), F.col(f"sp{c}").cast("double")) for c in classes}
    tp, pp, sp = (sum(F.col(f"{k}{c}") for c in classes) for k in ("tp", "pp", "sp"))
    total = sp.cast("double")
    micro = (p := ratio(tp, pp), r := ratio(tp, sp), f1(p, r), total)
    macro = (*[sum(per[c][m] for c in classes) / len(classes) for m in range(3)], total)
    weighted = (*[ratio(sum(per[c][m] * per[c][3] for c in classes), total) for m in range(3)], total)
    rows = [*((str(c), per[c]) for c in classes), ("micro avg", micro), ("macro avg", macro), ("weighted avg", weighted)]
    cells = [F.struct(F.lit(b).alias("bucket"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for b, values in rows for m, v in zip(METRICS, values, strict=True)]
    return wide.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.bucket", "c.metric", "c.value")


def accuracy(df: DataFrame, by: list[str] | None = None, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """``(*by, accuracy)``; a null prediction is wrong."""
    return df.groupBy(*(by or [])).agg(F.avg(F.coalesce((F.col(y) == F.col(predicted)).cast("double"), F.lit(0.0))).alias("accuracy"))


def accumulate_reports(reports: DataFrame, by: list[str], scale: float) -> DataFrame:
    """Sum reports over what isn't in ``by`` (folds) by bucket and metric, and divide by ``scale``; support too."""
    return reports.groupBy(*by, "bucket", "metric").agg((F.sum("value") / scale).alias("value"))
