"""Dependency manifests, advisories, risk and bill of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import explode_lines
from vulnlake.functions.versions import package_entries, package_url, requirement
from vulnlake.operators.reports import DEPENDENCY_WEIGHTS


def parse_requirements(files: DataFrame) -> DataFrame:
    """(name, version) rows of requirement files, with the line number."""
    kept = [c for c in files.columns if c != "text"]
    rows = explode_lines(files).withColumn("_d", requirement(F.col("line"))).filter(F.col("_d").isNotNull())
    return rows.select(*kept, "line_no", "_d.name", "_d.version")


def parse_packages(files: DataFrame) -> DataFrame:
    kept = [c for c in files.columns if c != "text"]
    return files.select(*kept, F.inline(package_entries(F.col("text"))))


def audit_summary(dependencies: DataFrame, vulnerabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Dependencies, distinct vulnerable packages, findings and risk per manifest."""
    points = F.lit(0)
    for name, weight in DEPENDENCY_WEIGHTS.items():
        points = F.when(F.col("severity") == name, weight).otherwise(points)
    totals = dependencies.groupBy(*keys).agg(F.count("*").alias("total_dependencies"))
    hits = vulnerabilities.groupBy(*keys).agg(
        F.count_distinct("name").alias("vulnerable_count"), F.count("*").alias("vulnerabilities"),
        F.least(F.lit(100), F.sum(points)).alias("risk_score"))
    return totals.join(hits, keys, "left").na.fill(0, ["vulnerable_count", "vulnerabilities", "risk_score"])


def advisory_stats(advisories: DataFrame) -> DataFrame:
    return advisories.agg(
        F.count_distinct("package").alias("total_packages_tracked"), F.count("*").alias("total_vulnerabilities"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in DEPENDENCY_WEIGHTS])


def components(dependencies: DataFrame, ecosystem: str = "python") -> DataFrame:
    kept = [c for c in dependencies.columns if c not in ("name", "version", "license")]
    license_col = F.col("license") if "license" in dependencies.columns else F.lit(None).cast("string")
    return dependencies.select(
        *kept, F.lit("library").alias("type"), "name", "version",
        package_url(F.col("name"), F.col("version"), ecosystem).alias("purl"),
        F.when(license_col != "", F.array(license_col)).otherwise(F.array().cast("array<string>")).alias("licenses"))
