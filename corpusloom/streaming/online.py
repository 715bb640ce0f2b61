"""Streaming forms of two batch operators: running metrics, and duplicates against what came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import label_counts


def running_label_counts(predictions: DataFrame, time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts behind all label metrics by window of a stream of predictions; late rows count until the watermark."""
    timed = predictions.withWatermark(time, delay).withColumn("window", F.window(time, window))
    return label_counts(timed, ["window", "condition", "model"])


def exact_duplicates(texts: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """A stream without texts seen within the watermark; state holds hashes, not texts."""
    return texts.withWatermark(time, delay).withColumn("sha256", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["sha256"])


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start writing scored micro-batches as Parquet, one folder a batch, so a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
