"""Settings that arrive as a stream: the latest change of each user wins, batch by batch.

The reference has no streams; this is the store's upsert for a user of Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert


def latest_per_key(changes: DataFrame, key: str, order: str, watermark: str = "1 hour") -> DataFrame:
    """The latest change of each key within a watermark of event time."""
    held = changes.withWatermark(order, watermark)
    return held.groupBy(key, F.window(order, watermark)).agg(F.max_by(F.struct(*changes.columns), order).alias("c")).select("c.*")


def maintain(changes: DataFrame, base_path: str, key: str, columns: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Writes the table anew after each batch, as ``version=N`` below base_path; a batch that is tried again writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{base_path}/version={number - 1}")
        upsert(before, batch, key, columns, order).write.mode("overwrite").parquet(f"{base_path}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
