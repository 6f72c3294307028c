"""Scores predictions as they arrive, and reports progress.

The gold table is static; every arriving prediction is scored on its own, so there is no state to bound and
no watermark is needed. A running mean per system is kept by an update-mode aggregation over one row a system.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import sets

PREDICTIONS = "system string, query_id string, answer string, refs array<string>"


def arriving(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """JSON lines of predictions in a folder, as a stream."""
    return spark.readStream.schema(PREDICTIONS).option("maxFilesPerTrigger", files_at_once).json(path)


def scored(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """system, query_id, iou of each prediction against gold's query_id and gold."""
    both = predictions.join(gold.select("query_id", "gold"), "query_id")
    return both.select("system", "query_id", sets.iou_scored(F.col("gold"), F.col("refs")).alias("iou"))


def running_means(detail: DataFrame) -> DataFrame:
    return detail.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("iou"))


def write_batches(detail: DataFrame, path: str, checkpoint: str):
    """Each micro-batch to a folder of its own number: a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return detail.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Tells a callback how many rows each micro-batch took."""

    def __init__(self, tell: Callable[[str, int], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(str(event.progress.id), int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
