"""Structured Streaming jobs over scans, requests, feedback and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vulnlake.operators.history import COUNTS
from vulnlake.operators.scan import scan_code, scan_secrets

TREND_WINDOWS = {"hour": "1 hour", "day": "1 day"}


def trend_stream(scans: DataFrame, bucket: str = "hour", delay: str = "1 hour") -> DataFrame:
    """Six measures per tumbling window; a window is final when the watermark has passed it."""
    return (scans.withWatermark("ts", delay).groupBy(F.window("ts", TREND_WINDOWS[bucket]))
            .agg(F.count("*").alias("total_scans"), F.sum("vulnerability_count").alias("total_vulnerabilities"),
                 *[F.sum(c).alias(c) for c in COUNTS])
            .select(F.col("window.start").alias("bucket"), "total_scans", "total_vulnerabilities", *COUNTS))


def request_rates(requests: DataFrame, keys: list[str], limit: int, window: str = "60 seconds", slide: str = "10 seconds",
                  delay: str = "1 minute") -> DataFrame:
    """Requests per key and sliding window, and whether they exceed the limit."""
    return (requests.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), *keys)
            .agg(F.count("*").alias("requests"))
            .select(F.col("window.start").alias("window_start"), *keys, "requests", (F.col("requests") > limit).alias("over_limit")))


def feedback_stream(feedback: DataFrame) -> DataFrame:
    """Running counts per CWE, for complete or update mode; state is one row per CWE."""
    confirmed = F.coalesce(F.col("feedback_type") == "confirmed", F.lit(False))
    return feedback.groupBy(F.coalesce("cwe_id", F.lit("UNKNOWN")).alias("cwe_id")).agg(
        F.count("*").alias("total_feedback"), F.count_if(confirmed).alias("confirmed_count"),
        F.count_if(~confirmed).alias("false_positive_count"))


def new_files(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Arriving files without repeats of the same path and content within the watermark."""
    return (files.withColumn("digest", F.sha2("text", 256)).withWatermark("arrived", delay)
            .dropDuplicatesWithinWatermark(["path", "digest"]).drop("digest"))


def file_findings(files: DataFrame, delay: str = "1 day", **options) -> DataFrame:
    return scan_code(new_files(files, delay), **options)


def file_secrets(files: DataFrame, delay: str = "1 day", **options) -> DataFrame:
    return scan_secrets(new_files(files, delay), **options)


def progress_stream(updates: DataFrame) -> DataFrame:
    """Latest status per scan, for update or complete mode."""
    last = F.max_by(F.struct("status", "files_scanned", "total_files"), F.struct("ts", "seq"))
    return updates.groupBy("scan_id").agg(last.alias("_u")).select("scan_id", "_u.*").withColumn(
        "percentage", F.bround(F.col("files_scanned") / F.greatest(F.col("total_files"), F.lit(1)) * 100, 1))


def start(frame: DataFrame, sink: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> StreamingQuery:
    """Runs over what has arrived and stops; progress is kept in the checkpoint."""
    return (frame.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint)
            .option("path", sink).trigger(availableNow=True).start())


def retention_stream(ticks: DataFrame, checkpoint: str, prune) -> StreamingQuery:
    """Calls ``prune(latest timestamp)`` once per batch of ticks.

    The callback gets a single value, the newest time of the batch.
    """
    def run(batch: DataFrame, _batch_id: int) -> None:
        newest = batch.agg(F.max("ts")).first()[0]
        if newest is not None:
            prune(newest)

    return (ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
