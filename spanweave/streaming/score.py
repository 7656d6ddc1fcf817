"""Scoring arriving rows against a static labelled set: the influence rule as a stateless stream-static step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanweave.operators.graph import influence
from spanweave.operators.ranking import with_global_rank


def score_batch(labelled: DataFrame, arriving: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, pos_weight, neg_weight, predicted)`` for ``arriving(id, features)`` against ``labelled(id, features, label)``."""
    new = arriving.select("id", "features", F.lit(-1).alias("label")).dropDuplicates(["id"])
    nodes = with_global_rank(labelled.select("id", "features", "label").unionByName(new), "vid", F.col("label") < 0, F.col("id"))
    found = influence(nodes.select("vid", "features", "label"), metric).where("influence >= 0")
    return nodes.where("label < 0").select("vid", "id").join(found, "vid").select("id", "pos_weight", "neg_weight", F.col("influence").alias("predicted"))


def score_stream(labelled: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "euclidean") -> StreamingQuery:
    """Score every micro-batch and hand it to ``sink(df, batch)``; a replayed batch has the same number, so an idempotent sink makes it exactly once."""
    labelled = labelled.cache()

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(score_batch(labelled, batch, metric), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
