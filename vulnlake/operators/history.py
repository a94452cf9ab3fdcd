"""Scan history: totals, trends, top lists, progress, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days covered by a range and the bucket it is cut into.
RANGES = {"day": (1, "hour"), "week": (7, "day"), "month": (30, "day"), "quarter": (90, "week"), "year": (365, "month")}
COUNTS = ("critical_count", "high_count", "medium_count", "low_count")
SEVERITY_DEFAULT = "low"


def scan_record(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Scan rows with their severity counts; a finding without severity counts as low."""
    level = F.lower(F.coalesce("severity", F.lit(SEVERITY_DEFAULT)))
    counted = findings.groupBy("scan_id").agg(
        F.count("*").alias("vulnerability_count"), *[F.count_if(level == c[:-6]).alias(c) for c in COUNTS])
    joined = scans.join(counted, "scan_id", "left")
    return joined.na.fill(0, ["vulnerability_count", *COUNTS])


def history_totals(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.count("*").alias("total_scans"), F.sum("vulnerability_count").alias("total_vulns"),
        F.sum("critical_count").alias("critical"), F.sum("high_count").alias("high"),
        F.sum("medium_count").alias("medium"), F.sum("low_count").alias("low"),
        F.avg("scan_time_ms").alias("avg_scan_time"))


def counts_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("vulnerability_type").agg(F.count("*").alias("count"))


def top_types(findings: DataFrame, limit: int = 10) -> DataFrame:
    return counts_by_type(findings).orderBy(F.desc("count"), "vulnerability_type").limit(limit)


def findings_by_language(scans: DataFrame) -> DataFrame:
    return scans.groupBy("language").agg(F.sum("vulnerability_count").alias("count"))


def week_label(ts: Column) -> Column:
    """Year and week of the year, weeks starting on Monday, days before the first one in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def bucket_label(ts: Column, bucket: str) -> Column:
    if bucket == "week":
        return week_label(ts)
    shape = {"hour": "yyyy-MM-dd HH':00'", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[bucket]
    return F.date_format(ts, shape)


def trend(scans: DataFrame, span: str, as_of: Column) -> DataFrame:
    """Six measures per time bucket of the range that ends at ``as_of``."""
    days, bucket = RANGES[span]
    recent = scans.filter(F.col("ts") >= as_of - F.expr(f"interval {days} days"))
    return recent.groupBy(bucket_label(F.col("ts"), bucket).alias("date")).agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.sum("vulnerability_count"), F.lit(0)).alias("total_vulnerabilities"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def half_over_half(trends: DataFrame) -> DataFrame:
    """Change of the later half of the trend rows against the earlier one.

    A trend has at most a few hundred buckets, so its one window is small by construction.
    """
    numbered = trends.withColumn("_n", F.row_number().over(Window.orderBy("date"))).withColumn(
        "_all", F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    early = F.col("_n") <= F.floor(F.col("_all") / 2)
    sums = numbered.agg(
        F.count("*").alias("_rows"),
        F.coalesce(F.sum(F.when(early, F.col("total_vulnerabilities"))), F.lit(0)).alias("previous"),
        F.coalesce(F.sum(F.when(~early, F.col("total_vulnerabilities"))), F.lit(0)).alias("current"))
    change = F.when(F.col("_rows") < 2, F.lit(0.0)).otherwise(
        (F.col("current") - F.col("previous")) / F.greatest(F.col("previous"), F.lit(1)) * 100)
    return sums.withColumn("_c", change).select(
        "previous", "current", F.bround("_c", 1).alias("week_change_percent"),
        F.when(F.col("_c") > 0, "up").when(F.col("_c") < 0, "down").otherwise("stable").alias("trend_direction"))


def recent_scans(scans: DataFrame, limit: int = 50) -> DataFrame:
    return scans.orderBy(F.desc("ts"), F.desc("scan_id")).limit(limit)


def file_history(scans: DataFrame, filename: str, limit: int = 100) -> DataFrame:
    return recent_scans(scans.filter(F.col("filename") == filename), limit)


def scan_by_id(scans: DataFrame, scan_id) -> DataFrame:
    return scans.filter(F.col("scan_id") == scan_id)


def project_records(scans: DataFrame) -> DataFrame:
    """Per project the first and last scan, their number and the latest finding count."""
    return scans.groupBy("project_name").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_scan_at"), F.count("*").alias("total_scans"),
        F.max_by("vulnerability_count", F.struct("ts", "scan_id")).alias("current_vuln_count"))


def top_files(files: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """Files with most findings per project. Spark limits each group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("total"), "file_path")
    return files.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def scan_progress(updates: DataFrame) -> DataFrame:
    """Latest status per scan with percent done; ``updates``: scan_id, ts, seq, status, files_scanned, total_files."""
    last = F.max_by(F.struct("status", "files_scanned", "total_files"), F.struct("ts", "seq"))
    return updates.groupBy("scan_id").agg(last.alias("_u")).select("scan_id", "_u.*").withColumn(
        "percentage", F.bround(F.col("files_scanned") / F.greatest(F.col("total_files"), F.lit(1)) * 100, 1))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Confirmed and other feedback per CWE; whatever is not confirmed is a false positive."""
    confirmed = F.coalesce(F.col("feedback_type") == "confirmed", F.lit(False))
    return feedback.groupBy(F.coalesce("cwe_id", F.lit("UNKNOWN")).alias("cwe_id")).agg(
        F.count("*").alias("total_feedback"), F.count_if(confirmed).alias("confirmed_count"),
        F.count_if(~confirmed).alias("false_positive_count"))


def feedback_label(kind: Column) -> Column:
    return F.when(kind == "confirmed", 1).otherwise(0)
