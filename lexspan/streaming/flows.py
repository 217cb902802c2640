"""Streams over requests, messages and incoming documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamped(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def request_metrics(requests: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests, failures and durations per window and path.

    `requests`: ts, path, status, seconds. Partial sums are made before the
    shuffle, so one busy path does not pile up in one task.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stamped(requests, "ts", delay).groupBy(window.alias("w"), "path").agg(
        F.count("*").alias("requests"), F.count(F.when(F.col("status") >= 500, 1)).alias("failures"),
        F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "path", "requests", "failures", "avg_seconds", "max_seconds")


def without_redelivery(messages: DataFrame, key: str, delay: str) -> DataFrame:
    """Each message id once within the watermark."""
    return stamped(messages, "ts", delay).dropDuplicatesWithinWatermark([key])


def sessions(messages: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Runs of messages with no pause longer than `gap`."""
    return stamped(messages, "ts", delay).groupBy(F.session_window("ts", gap).alias("s"), key).agg(
        F.count("*").alias("messages")
    ).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "messages")


def continuous_ingest(stream: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "doc_id"):
    """New documents to chunks to a table, replacing a document's old chunks.

    Every micro-batch writes its own version folder named by the batch id, so a
    repeated batch overwrites itself and nothing is written twice. Readers use
    `latest_chunks`.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = build(batch).withColumn("_batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")
        batch.select(F.col(key), F.lit(number).cast("long").alias("_batch")).distinct().write.mode("overwrite").parquet(
            f"{target}_documents/batch={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """Chunks of each document's newest batch, also when it shrank to none."""
    rows = spark.read.option("basePath", target).parquet(target)
    newest = spark.read.parquet(f"{target}_documents").groupBy(key).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [key, "_batch"], "left_semi").drop("_batch", "batch")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into parquet and return what was written."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        folder = path if mode == "complete" else f"{path}/batch={number:012d}"
        batch.write.mode("overwrite").parquet(folder)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(path).drop("batch")
