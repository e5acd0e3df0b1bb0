"""Saved projects that arrive as a stream: each batch is a folder of its own, so a batch that comes again adds no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import inserted_projects


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """Puts the rows of a batch where those of an earlier attempt at it are."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def append_projects(requests: DataFrame, path: str, request_key: str, now: Column, checkpoint: str) -> StreamingQuery:
    """Appends the projects of a stream of requests (user_id, name, data, documents, request_key) to the table at ``path``.

    The table has one more column, ``batch``. Ids follow from user and request, so one that is sent twice in different
    batches can be told by its id.
    """

    def append(batch: DataFrame, number: int) -> None:
        write_batch(inserted_projects(batch, request_key, now), path, number)

    return requests.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
