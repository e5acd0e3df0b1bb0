"""The extraction boundary: raw answers come from a pluggable function over chunks, and are kept for the next run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import js

Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: A request, as a dictionary of its chunk's columns -> the blocks of the answer, each with a type and maybe a text.
Ask = Callable[[dict], list[dict]]
BLOCKS = "array<struct<type: string, text: string>>"
#: What is kept of each attempt: an answer, or why there is none.
ANSWERS = f"key string, attempt int, blocks {BLOCKS}, error string"
MOST_ATTEMPTS = 3


def extract(chunks: DataFrame, extractor: Extractor, schema: str, partitions: int | None = None) -> DataFrame:
    """Runs an extractor over chunks on the executors; a failing one fails its task, and is tried again."""
    return (chunks.repartition(partitions) if partitions else chunks).mapInPandas(extractor, schema)


def replay(chunks: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """The deterministic extractor: recorded answers (on..., raw); a chunk without one gets the empty object."""
    return chunks.join(answers, on, "left").withColumn("raw", F.coalesce("raw", F.lit("{}")))


def request_key(*parts: Column | str) -> Column:
    """The name of a request: equal requests have equal names. NULL differs from the empty text."""
    length = lambda c: F.coalesce(F.length(c).cast("string"), F.lit("-"))
    return F.sha2(F.concat(*(x for part in parts for x in (length(js.col(part)), F.lit(":"), js.text_or_empty(part)))), 256)


def answer_text(blocks: Column | str, single: Column) -> Column:
    """The first block of an answer if it is a text; else nothing of a document that is one request, the empty object of a chunk.

    NULL without an answer.
    """
    first = F.get(js.col(blocks), 0)
    return F.when(first["type"] == "text", js.text_or_empty(first["text"])).when(js.col(blocks).isNotNull(), F.when(single, "").otherwise("{}"))


def latest(answers: DataFrame) -> DataFrame:
    """(key, attempt, blocks, error) of the last attempt at each request."""
    return answers.groupBy("key").agg(F.max("attempt").alias("attempt"), F.max_by(F.struct("blocks", "error"), "attempt").alias("last")).select("key", "attempt", "last.blocks", "last.error")


def due(chunks: DataFrame, answers: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The requests (key, ...) that have no answer and were tried less than ``most`` times, each once, with the ``attempt`` to make.

    Requests are compared by key alone, so of several chunks with one content one is asked.
    """
    tried = latest(answers).select("key", F.col("attempt").alias("_tried"), F.col("error").isNull().alias("_done"))
    rest = chunks.dropDuplicates(["key"]).join(tried, "key", "left").where(F.col("_tried").isNull() | (~F.col("_done") & (F.col("_tried") < most)))
    return rest.withColumn("attempt", F.coalesce("_tried", F.lit(0)) + 1).drop("_tried", "_done")


def attempted(requests: DataFrame, ask: Ask) -> DataFrame:
    """One attempt at each request (key, attempt, ...): what ``ask`` gives for its other columns, or the error that it raises."""

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for request in frame.to_dict("records"):
                key, attempt = request.pop("key"), request.pop("attempt")
                try:
                    rows.append((key, attempt, [{"type": b.get("type"), "text": b.get("text")} for b in ask(request)], None))
                except Exception as error:  # noqa: BLE001  any failure of the service is kept, and tried again by the next run
                    rows.append((key, attempt, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["key", "attempt", "blocks", "error"])

    return requests.mapInPandas(answers, ANSWERS)


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """All attempts kept in a folder; none without it."""
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)


def resume(chunks: DataFrame, ask: Ask, path: str, most: int = MOST_ATTEMPTS, partitions: int | None = None) -> DataFrame:
    """chunks (key, ...) with (attempt, blocks, error) of their last attempt, after one more at those that are due.

    Attempts are appended to the folder when all tasks have ended, so a run that is cut short adds none and the next
    one goes on where the last whole one was. What is answered is never asked again; a task that is tried again asks
    again, as a request can't be taken back. One run at a time writes a folder.
    """
    spark = chunks.sparkSession
    open_ = due(chunks, kept_answers(spark, path), most)
    attempted(open_.repartition(partitions) if partitions else open_, ask).write.mode("append").parquet(path)
    return chunks.join(latest(kept_answers(spark, path)), "key", "left")
