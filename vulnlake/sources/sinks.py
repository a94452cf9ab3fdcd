"""History tables, feedback, documents and corpus output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators.corpus import class_weights
from vulnlake.operators.history import feedback_label, scan_record
from vulnlake.operators.reports import (
    csv_rows,
    framework_compliance,
    recommendations,
    sarif_results,
    sarif_rules,
    with_requirements,
)
from vulnlake.operators.scale import BROADCAST_ROWS, kept
from vulnlake.sources import documents

# Names and versions that the document formats ask for.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
SBOM_FORMAT, SBOM_VERSION = "CycloneDX", "1.5"
#: The findings of a compliance export are written before its report, so that their lines are not on disk twice at once.
COMPLIANCE_PASSES = (4,)


def record_scans(scans: DataFrame, findings: DataFrame, path: str) -> None:
    """Appends scans (with counts) and findings, both partitioned by scan date."""
    rows = scan_record(findings, scans).withColumn("scan_date", F.to_date("ts"))
    dated = findings.join(scans.select("scan_id", F.to_date("ts").alias("scan_date")), "scan_id")
    # Rows of a date meet before they are written, so a date gets few files; a date with very many rows is split.
    rows.hint("rebalance", "scan_date").write.mode("append").partitionBy("scan_date").parquet(f"{path}/scans")
    dated.hint("rebalance", "scan_date").write.mode("append").partitionBy("scan_date").parquet(f"{path}/findings")


def remove_old_scans(spark: SparkSession, path: str, cutoff_date: str, target: str) -> None:
    """Writes the history without scan dates before the cutoff to a new folder.

    Both tables are partitioned by date, so old partitions are not even read.
    """
    for name in ("scans", "findings"):
        kept = spark.read.parquet(f"{path}/{name}").filter(F.col("scan_date") >= F.lit(cutoff_date).cast("date"))
        kept.hint("rebalance", "scan_date").write.mode("overwrite").partitionBy("scan_date").parquet(f"{target}/{name}")


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.withColumn("label", feedback_label(F.col("feedback_type"))).write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "feedback_id string, timestamp string, cwe_id string, severity string, line_number int, code_snippet string, "
        "description string, feedback_type string, language string, is_vulnerable boolean, label int").json(path)


def identifiers(prefix: str, ts: Column) -> Column:
    """``prefix_YYYYmmddHHMMSS``."""
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMddHHmmss"))


def sarif_lines(findings: DataFrame, key: str, order: str, tool: str = "vulnlake", version: str = "1.0.0") -> DataFrame:
    """Lines of one SARIF document per key, for `documents.write_documents`."""
    rule = F.struct(
        "id", "name", F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.struct(F.col("help_text").alias("text"), F.col("help_markdown").alias("markdown")).alias("help"),
        F.struct("tags", F.col("security_severity").alias("security-severity")).alias("properties"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct("text").alias("message"),
        F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(
            F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")).alias("region"))
            .alias("physicalLocation"))).alias("locations"),
        F.struct("confidence", "cwe", "owasp").alias("properties"),
        F.when(F.col("fix").isNotNull(), F.array(F.struct(F.struct(F.col("fix").alias("text")).alias("description")))).alias("fixes"))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    fixed = documents.frame_lines(findings.select(key).distinct(), key, {
        0: head, 2: ']}},"results":[', 4: '],"invocations":[{"executionSuccessful":true}]}]}'})
    rules = documents.lines(sarif_rules(findings, [key], order), key, 1, F.to_json(rule), F.col("first_position"))
    results = documents.lines(sarif_results(findings, [key], order), key, 3, F.to_json(result), F.col("position"))
    return fixed.unionByName(rules).unionByName(results)


def sbom_lines(components: DataFrame, key: str, created: str) -> DataFrame:
    """Lines of one bill of materials per project, components in the order of their names and versions."""
    about = F.to_json(F.struct(F.lit(created).alias("timestamp"), F.struct(
        F.col(key).cast("string").alias("name"), F.lit("application").alias("type")).alias("component")))
    head = F.concat(F.lit(f'{{"bomFormat":"{SBOM_FORMAT}","specVersion":"{SBOM_VERSION}","version":1,"metadata":'), about, F.lit(',"components":['))
    fixed = documents.frame_lines(components.select(key).distinct(), key, {0: head, 2: "]}"})
    row = F.to_json(F.struct("type", "name", "version", "purl", "licenses"))
    order = F.concat_ws("\x00", "name", "version")
    return fixed.unionByName(documents.lines(components, key, 1, row, F.lit(0), order))


def compliance_lines(findings: DataFrame, key: str, order: str, frameworks: tuple[str, ...] = ("OWASP_ASVS", "PCI_DSS"), generated: str = "",
                     tool: str = "vulnlake", version: str = "1.0.0") -> DataFrame:
    """Lines of one compliance export per scan: metadata, summary, findings, the report by requirement, and recommendations."""
    scores = framework_compliance(findings, [key], frameworks)
    checked = F.array(*[F.lit(f) for f in frameworks])
    scan = F.col(key).cast("string").alias("scan_id")
    figures = [F.col("total_findings"), F.col("compliance_score"), checked.alias("frameworks_checked")]
    metadata = F.to_json(F.struct(F.lit(generated).alias("generated_at"), scan, F.lit(tool).alias("tool"), F.lit(version).alias("version")))
    report = F.to_json(F.struct(scan, F.lit(generated).alias("generated_at"), *figures))
    fixed = documents.frame_lines(scores, key, {
        0: F.concat(F.lit('{"report_metadata":'), metadata, F.lit(",")), 1: F.concat(F.lit('"summary":'), F.to_json(F.struct(*figures)), F.lit(",")),
        2: '"findings":[', 4: "],", 5: F.concat(F.lit('"compliance_report":'), F.regexp_replace(report, r"\}$", ""), F.lit(',"findings_by_requirement":{')),
        7: '},"gaps":[],"recommendations":[', 9: ']},"recommendations":[', 11: "]}"})
    own = F.to_json(F.struct(*[c for c in findings.columns if c != key]))
    listed = documents.lines(findings, key, 3, own, F.col(order))
    mapped = with_requirements(findings, frameworks)
    item = F.to_json(F.struct("type", "severity", "line", "message", "compliance"))
    firsts = mapped.groupBy(key, "requirement").agg(F.min(order).alias("first"), F.min("framework_no").alias("framework_no"))
    # Requirements come in the order in which findings first name them.
    place = F.lpad(F.hex(F.col("first").cast("bigint").bitwiseXOR(F.lit(-1 << 63))), 16, "0")
    part = F.concat(place, F.lit(" "), F.col("framework_no").cast("string"), F.lit(" "), F.col("requirement"))
    parts = kept(firsts.select(F.col(key).alias("_key"), F.col("requirement").alias("_requirement"), part.alias("part")), "requirements")
    # A few requirements per document: findings with their messages are not shuffled to find theirs, unless there are very many documents.
    sent = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts.hint("merge")
    items = mapped.join(sent, F.col(key).eqNullSafe(F.col("_key")) & (F.col("requirement") == F.col("_requirement")))
    edges = F.array(F.struct(F.lit(-1 << 63).alias("place"), F.concat(F.to_json(F.array("_requirement")), F.lit(":[")).alias("text"), F.lit(True).alias("opens"), F.lit(False).alias("closes")),
                    F.struct(F.lit((1 << 63) - 1).alias("place"), F.lit("]").alias("text"), F.lit(False).alias("opens"), F.lit(True).alias("closes")))
    framed = parts.select(F.col("_key").alias("key"), "part", F.inline(edges)).withColumn("text", F.regexp_replace("text", r"^\[(.*)\]:\[$", "$1:["))
    by_requirement = documents.lines(items, key, 6, item, F.col(order), F.col("part")).unionByName(
        documents.lines(framed, "key", 6, F.col("text"), F.col("place"), F.col("part"), F.col("opens"), F.col("closes")))
    advice = recommendations(findings, [key], order)
    quoted = F.regexp_replace(F.to_json(F.array("recommendation")), r"^\[(.*)\]$", "$1")
    said = [documents.lines(advice, key, section, quoted, F.col("place")) for section in (8, 10)]
    return reduce(DataFrame.unionByName, [fixed, listed, by_requirement, *said])


def write_findings_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).csv(path)


def write_splits(samples: DataFrame, path: str) -> None:
    """Samples partitioned by split, class weights and totals beside them."""
    samples.write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")
    class_weights(samples.filter(F.col("split") == "train")).write.mode("overwrite").json(f"{path}/class_weights")
    samples.groupBy("split").agg(F.count("*").alias("samples")).write.mode("overwrite").json(f"{path}/metadata")
