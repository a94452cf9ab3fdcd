"""Physical plans: what must not be shuffled, gathered or read."""

import os

import pytest
from pyspark.sql import functions as F

from vulnlake.functions.text import explode_lines
from vulnlake.operators import corpus, findings, history, lookups, reports, scan
from vulnlake.operators.scale import bounded_broadcast


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    rows = spark.range(2000).select(
        F.col("id").alias("file_id"), F.lit("python").alias("language"), F.concat(F.lit("eval(x)\ny = "), F.col("id")).alias("text"),
        (F.col("id") % 7).alias("scan_id"), F.lit("XSS").alias("type"), F.lit("CWE-79").alias("cwe"), F.lit("HIGH").alias("severity"),
        F.current_timestamp().alias("ts"), F.lit("a.py").alias("filename"), (F.col("id") % 50).alias("total"), F.lit("f").alias("file_path"))
    rows.repartition(6).write.parquet(f"{path}/t")
    return f"{path}/t"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_do_not_shuffle(spark, folder):
    files = spark.read.parquet(folder)
    text = files.select("file_id", "language", "text")
    for frame in (scan.scan_code(text), scan.match_code(text), scan.scan_secrets(text), explode_lines(text),
                  corpus.split_by_hash(files.select("file_id", F.col("text").alias("fingerprint")))):
        assert "Exchange" not in plan(frame)


def test_scan_reads_only_its_columns(spark, folder):
    shown = plan(scan.scan_code(spark.read.parquet(folder).select("file_id", "language", "text")))
    schema = shown.split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<file_id:bigint,language:string,text:string"


def test_filters_reach_the_reader(spark, folder):
    shown = plan(history.scan_by_id(spark.read.parquet(folder), 3).select("scan_id", "total"))
    assert "EqualTo(scan_id,3)" in shown and "ReadSchema: struct<scan_id:bigint,total:bigint>" in shown


def test_lookups_broadcast_the_small_side(spark, folder):
    f = spark.read.parquet(folder)
    for frame in (lookups.with_asvs(f), lookups.with_owasp_2021(f), lookups.match_advisories(f.select(F.col("type").alias("name"), F.col("cwe").alias("version")))):
        shown = plan(frame)
        assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and "CartesianProduct" not in shown


def test_top_rows_are_not_sorted_whole(spark, folder):
    f = spark.read.parquet(folder)
    assert "TakeOrderedAndProject" in plan(history.recent_scans(f))
    assert plan(history.top_files(f, ["scan_id"])).count("WindowGroupLimit") == 2


def test_counts_reduce_before_the_shuffle(spark, folder):
    shown = plan(reports.severity_counts(spark.read.parquet(folder), ["scan_id"]))
    assert "partial_count" in shown and shown.count("Exchange") == 1


def test_near_line_merge_is_spread_by_anchor(spark, folder):
    """Lines and their pieces are shuffled before the written table; only anchors are afterwards, never files."""
    f = spark.read.parquet(folder).select(
        F.col("file_path").alias("file_id"), F.lit(0).alias("tool_no"), F.col("file_id").alias("position"), F.col("total").cast("int").alias("line"),
        F.col("type").alias("vulnerability_type"), "severity", F.lit(0.5).alias("confidence"), F.array(F.lit("semgrep")).alias("sources"),
        F.lit("").alias("code_snippet"), F.lit("").alias("explanation"), F.lit("r").alias("semgrep_rule"), F.lit(None).cast("string").alias("bandit_test"),
        F.lit(None).cast("double").alias("ml_probability"), F.lit("").alias("cwe_id"), F.lit("").alias("owasp_category"))
    shown = plan(findings.merge_near_lines(f))
    assert shown.count("Exchange hashpartitioning(file_id") == 1 and "Exchange hashpartitioning(file_id" in shown and ", anchor#" in shown


def test_broadcast_needs_a_bound(spark, folder):
    f = spark.read.parquet(folder).select("file_id")
    assert "BroadcastHint" not in bounded_broadcast(f)._jdf.queryExecution().logical().toString() and bounded_broadcast(f) is f
    assert bounded_broadcast(f.limit(10)) is not f
