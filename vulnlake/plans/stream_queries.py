"""Streaming jobs run to the end over the events, written out as an arriving source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vulnlake.plans import tables as t
from vulnlake.plans.registry import query
from vulnlake.plans.report_queries import ADMISSION_SQL
from vulnlake.plans.scan_queries import W1_SQL
from vulnlake.plans.tables import with_tables
from vulnlake.session import ensure_checkpoint_dir
from vulnlake.streaming import admission, jobs


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark, frame, folder):
    """The rows as a stream of several files."""
    frame.write.mode("overwrite").parquet(f"{folder}/in")
    return spark.readStream.schema(frame.schema).parquet(f"{folder}/in")


def _drained(spark, build, frame, mode="append"):
    folder = _folder(spark)
    stream = build(_source(spark, frame, folder))
    if mode == "append":
        jobs.start(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    out = f"{folder}/out"
    (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
     .foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


@query("t1_trend_stream", with_tables(t.SCANS, body="""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS total_scans, CAST(sum(vulnerability_count) AS BIGINT) AS total_vulnerabilities FROM scans
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM scans) - INTERVAL 1 HOUR GROUP BY 1"""))
def trend_stream(spark, sf):
    """Daily windows that are final at the end of the stream."""
    rows = _drained(spark, lambda s: jobs.trend_stream(s, "day"), t.scans(spark, sf))
    return rows.select("bucket", "total_scans", "total_vulnerabilities")


@query("t3_admission_stream", ADMISSION_SQL + """
WHERE floor(epoch_us(ts) / 1e6) + 1 < (SELECT epoch_us(max(ts)) / 1e6 FROM requests) - 60""")
def admission_stream(spark, sf):
    """Decisions on all requests whose second the watermark has passed at the end of the stream."""
    requests = t.requests(spark, sf)
    return _drained(spark, lambda s: admission.decide_stream(s.withWatermark("ts", "1 minute"), ["client", "path"], 10, 60, "request_id"), requests)


@query("t5_feedback_stream", with_tables(t.FEEDBACK, body="""SELECT coalesce(cwe_id, 'UNKNOWN') AS cwe_id, count(*) AS total_feedback, count(*) FILTER (feedback_type = 'confirmed') AS confirmed_count,
  count(*) FILTER (feedback_type <> 'confirmed') AS false_positive_count FROM feedback GROUP BY 1"""))
def feedback_stream(spark, sf):
    return _drained(spark, jobs.feedback_stream, t.feedback(spark, sf), "complete")


@query("t6_file_findings_stream", with_tables(t.CODE_FILES, body=f"SELECT file_id, start_line, rule_id, severity FROM ({W1_SQL})"))
def file_findings_stream(spark, sf):
    """Every file arrives twice and is scanned once."""
    files = t.code_files(spark, sf).select("file_id", "path", "language", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("file_id")).alias("arrived"))
    return _drained(spark, lambda s: jobs.file_findings(s, "30 days"), files.unionByName(files)).select(
        "file_id", "start_line", "rule_id", "severity")


@query("t7_progress_stream", with_tables(t.PROGRESS, body="""SELECT scan_id, status, files_scanned, total_files, round_even(files_scanned / CAST(greatest(total_files, 1) AS DOUBLE) * 100, 1) AS percentage
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, seq DESC) AS n FROM progress) WHERE n = 1"""))
def progress_stream(spark, sf):
    return _drained(spark, jobs.progress_stream, t.progress(spark, sf), "complete")
