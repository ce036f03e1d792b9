"""Streams: a folder of arriving files or detector answers through the same plans as tables, and job states kept by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANSWERS = "doc_id bigint, page int, width int, height int, response string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_answers(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", per_trigger).json(folder)


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run plan on each micro-batch and write its rows to output/batch=N; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


STATE = "pages bigint, done bigint, failed bigint, total bigint, state string"
STATES = "job string, state string, pages bigint, done bigint, failed bigint"


def job_states(events: DataFrame) -> DataFrame:
    """States of jobs from a stream of events (job, kind, n): queued, page, done, failed, read (n pages in all), cancel.

    A job is processing once it has pages, succeeded when all that were read are done, failed when one failed or none was
    read, cancelled on request; a finished job stays as it is.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, done, failed, total, now = state.get if state.exists else (0, 0, 0, -1, "queued")
        for b in batches:
            for kind, n in zip(b["kind"], b["n"], strict=True):
                if now in ("succeeded", "failed", "cancelled"):
                    continue
                n = 0 if pd.isna(n) else int(n)
                pages += kind == "page"
                done += kind == "done"
                failed += kind == "failed"
                total = n if kind == "read" else total
                if kind == "cancel":
                    now = "cancelled"
                elif failed or total == 0:
                    now = "failed"
                elif total > 0 and done >= total:
                    now = "succeeded"
                elif pages or done:
                    now = "processing"
                elif kind == "queued":
                    now = "queued"
        state.update((pages, done, failed, total, now))
        yield pd.DataFrame([(key[0], now, pages, done, failed)], columns=["job", "state", "pages", "done", "failed"])

    return events.groupBy("job").applyInPandasWithState(update, STATES, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_failures(completions: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Failures and requests by model and window of event time."""
    t = completions.withWatermark("ts", watermark).groupBy(F.window("ts", window), "model")
    return t.agg(F.count("*").alias("requests"), F.count_if("failed").alias("failed_requests")).select(F.col("window.start").alias("start"), "model", "requests", "failed_requests")
