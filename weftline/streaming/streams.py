"""Streaming flows. A flow is the same plan as its batch form, read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.aggregates import throughput
from weftline.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a table as a stream. ``path`` may be a folder or a pattern, not one bare file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def as_pattern(path: str) -> str:
    """A pattern that matches exactly ``path``; a bare file is no valid stream source, a pattern is."""
    head, _, tail = path.rpartition("/")
    return f"{head}/[{tail[0]}]{tail[1:]}"


def start_flow(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Source, transforms, file sink with checkpoint: exactly once over restarts.

    Without an interval all data at hand is processed, in bounded batches, and the query ends.
    """
    writer = (
        transform(stream)
        .writeStream.format("parquet")
        .outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def run_available(
    spark: SparkSession, stream: DataFrame, transform: Callable[[DataFrame], DataFrame], label: str
) -> DataFrame:
    """Run a flow over all data at hand into the shared folder and read what it wrote."""
    target, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = start_flow(stream, transform, target, checkpoint)
    query.awaitTermination()
    return spark.read.schema(transform(stream).schema).parquet(target)


def stream_throughput(
    stream: DataFrame, at: str, service: str, width: str, late: str
) -> DataFrame:
    """Events per service and window; rows later than ``late`` behind the newest are dropped, see ``late_rows``.

    Counts are combined before the shuffle, so the state per window is one row per service.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return throughput(timed, at, service, width)


def start_counts(
    stream: DataFrame, at: str, service: str, width: str, late: str, target: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    return start_flow(stream, lambda s: stream_throughput(s, at, service, width, late), target, checkpoint, "append", interval)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the batches whose progress Spark still holds.

    Spark counts them where they meet the state, so rows of one window that were combined before count once.
    """
    return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])


def keep_latest_counts(
    spark: SparkSession, stream: DataFrame, at: str, service: str, width: str, late: str, label: str
) -> DataFrame:
    """The throughput of all data at hand, open windows included.

    Update mode hands each batch its changed windows; a batch is one folder, written whole, so a
    repeated batch replaces itself. The last count of a window is its largest.
    """
    target, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    counts = stream_throughput(stream, at, service, width, late)
    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    keys: Sequence[str] = ["window_start", "window_end", service]
    written = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
    return written.groupBy(*keys).agg(F.max("events").alias("events"))
