"""Reads as a stream against a static library: a stateless join, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import assign as A


def assign_batch(batch: DataFrame, targets: DataFrame, k: int, start: int, length: int, metric: str = "levenshtein") -> DataFrame:
    return A.assign(batch, targets, k, metric, start=start, length=length)


def stream_assignments(reads: DataFrame, targets: DataFrame, k: int, start: int, length: int, sink, checkpoint: str, metric: str = "levenshtein"):
    """Assign each micro-batch and hand it to ``sink(df, batch_id)``; a batch replayed after a failure
    comes with the same id, so an idempotent sink sees each read once."""
    return reads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(assign_batch(df, targets, k, start, length, metric), i)).start()


def running_window_counts(reads: DataFrame, start: int, length: int, time: str | None = None, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts of (sample, observed) as reads arrive; by time windows under a watermark if there is a time."""
    cut = reads.withColumn("observed", S.window("seq", start, length))
    if time is None:
        return cut.groupBy("sample", "observed").agg(F.count("*").alias("n"))
    return cut.withWatermark(time, late).groupBy(F.window(time, every), "sample", "observed").agg(F.count("*").alias("n"))
