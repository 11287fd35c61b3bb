"""Structured Streaming over event tables: windows with watermarks, sessions, net changes, late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, *, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum by key and window (tumbling, or sliding with ``slide``); runs on tables and on streams.

    On a stream ``late`` is the watermark: rows later than that are dropped, and state is kept no longer.
    """
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.groupBy(w.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, *, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Sessions that end after ``gap`` without an event: start, end (gap included) and number of events."""
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *keys, "n")


def deduplicated(events: DataFrame, *, ts: str, key: str, late: str) -> DataFrame:
    """A stream whose repeated deliveries within the watermark count once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def net_by_batch(stream: DataFrame, keys: list[str], signed: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A compound trigger on a stream: for each micro-batch one row a key with the net quantity, handed to ``write``.

    ``write`` gets the batch number, by which it can make a repeated batch harmless.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(batch.groupBy(*keys).agg(F.sum(F.col(signed).cast("decimal(18,4)")).alias("net"), F.count("*").alias("n_rows")), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(result: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, appending finished rows to parquet files, and waits for its end."""
    result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
