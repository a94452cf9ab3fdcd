"""Findings of several tools: conversion, near-line merge, confidence, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import severity as sev
from vulnlake.functions.text import capitalize_words, line_excerpt, title_of_rule_id
from vulnlake.operators.filters import is_plain_import
from vulnlake.operators.lookups import owasp_of_rule_id, owasp_of_test, owasp_of_type
from vulnlake.operators.near_lines import with_anchors

AI_TYPE = "AI-Detected Vulnerability"
TOOL_ORDER = {"semgrep": 0, "bandit": 1, "ml": 2}


def unify_semgrep(results: DataFrame) -> DataFrame:
    """(file_id, position, check_id, line, severity, message, cwe_id, text) to unified findings."""
    return _unified(
        results, "semgrep", line="line", kind=title_of_rule_id(F.col("check_id")),
        severity=sev.from_semgrep(F.coalesce("severity", F.lit("INFO"))), confidence=F.lit(sev.SEMGREP_CONFIDENCE),
        snippet=line_excerpt(F.col("text"), F.col("line")), explanation=F.col("message"),
        semgrep_rule=F.col("check_id"), cwe=F.col("cwe_id"), owasp=owasp_of_rule_id(F.col("check_id")))


def unify_bandit(results: DataFrame) -> DataFrame:
    """(file_id, position, test_id, test_name, line, severity, confidence, message, cwe_id, text)."""
    return _unified(
        results, "bandit", line="line", kind=F.coalesce("test_name", F.lit("Unknown")),
        severity=sev.from_bandit(F.coalesce("severity", F.lit("LOW"))),
        confidence=sev.bandit_confidence(F.coalesce("confidence", F.lit("LOW"))),
        snippet=line_excerpt(F.col("text"), F.col("line")), explanation=F.col("message"),
        bandit_test=F.col("test_id"), cwe=F.col("cwe_id"), owasp=owasp_of_test(F.col("test_id")))


def unify_model(predictions: DataFrame) -> DataFrame:
    """(file_id, position, vulnerable, confidence, probability, text); plain imports are left out."""
    kept = predictions.filter(F.col("vulnerable") & ~is_plain_import(F.col("text"))).withColumn("line", F.lit(1))
    text = F.concat(F.lit("AI model detected potential vulnerability with "),
                    F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("% confidence"))
    return _unified(
        kept, "ml", line="line", kind=F.lit(AI_TYPE), severity=sev.from_probability(F.col("confidence")),
        confidence=F.col("confidence"), snippet=F.substring("text", 1, 200), explanation=text,
        probability=F.col("probability"), owasp=owasp_of_type(F.lit(AI_TYPE)))


def _unified(frame: DataFrame, tool: str, *, line, kind, severity, confidence, snippet, explanation,
             semgrep_rule=None, bandit_test=None, probability=None, cwe=None, owasp=None) -> DataFrame:
    def opt(value, kind="string"):
        return (F.lit(None) if value is None else value).cast(kind)

    return frame.select(
        "file_id", F.lit(TOOL_ORDER[tool]).alias("tool_no"), F.col("position").cast("bigint").alias("position"),
        F.col(line).cast("int").alias("line"), kind.alias("vulnerability_type"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), F.array(F.lit(tool)).alias("sources"),
        snippet.alias("code_snippet"), explanation.alias("explanation"),
        opt(semgrep_rule).alias("semgrep_rule"), opt(bandit_test).alias("bandit_test"),
        opt(probability, "double").alias("ml_probability"), opt(cwe).alias("cwe_id"),
        opt(owasp).alias("owasp_category"))


def merge_near_lines(findings: DataFrame) -> DataFrame:
    """Near findings as one: sources joined, highest severity and confidence, last details.

    In arrival order a finding joins the earliest anchor within two lines, else it becomes an
    anchor itself; anchors do not move. All findings of a line go to the same anchor, so they
    are aggregated per line first; `near_lines` then finds the anchors, in pieces of a file.
    """
    arrival = F.struct("tool_no", "position")
    keep = ["vulnerability_type", "code_snippet", "explanation", "cwe_id", "owasp_category"]
    details = ["semgrep_rule", "bandit_test", "ml_probability"]
    per_line = findings.groupBy("file_id", "line").agg(
        F.min(F.struct("tool_no", "position", "line", *keep)).alias("first"),
        F.min(sev.severity_rank(F.col("severity"))).alias("rank"), F.max("confidence").alias("confidence"),
        F.collect_set(F.element_at("sources", 1)).alias("sources"),
        *[F.max(F.when(F.col(d).isNotNull(), F.struct(arrival.alias("at"), F.col(d).alias("value")))).alias(d) for d in details])
    placed = with_anchors(per_line, F.struct("first.tool_no", "first.position"))
    merged = placed.groupBy("file_id", "anchor").agg(
        F.min("first").alias("first"), F.min("rank").alias("rank"), F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        *[F.max(d).alias(d) for d in details])
    return merged.select(
        "file_id", "first.line", *[f"first.{c}" for c in keep], sev.severity_of_rank(F.col("rank")).alias("severity"),
        "confidence", "sources", *[F.col(f"{d}.value").alias(d) for d in details], "first.tool_no", "first.position")


def agreed_confidence(confidence: Column, sources: Column) -> Column:
    """More sources, more confidence; a model among several adds a little more."""
    n = F.size(sources)
    several = F.when(n == 2, F.least(confidence + 0.10, F.lit(1.0))).when(
        n >= 3, F.least(confidence + 0.15, F.lit(1.0))).otherwise(confidence)
    return F.when(F.array_contains(sources, "ml") & (n > 1), F.least(several + 0.05, F.lit(1.0))).otherwise(several)


def with_agreement(findings: DataFrame) -> DataFrame:
    sources = F.col("sources")
    return findings.withColumn("confidence", agreed_confidence(F.col("confidence"), sources)).withColumn(
        "sources", F.when(F.size(sources) >= 3, F.array_union(sources, F.array(F.lit("hybrid")))).otherwise(sources))


def combine_tools(*unified: DataFrame) -> DataFrame:
    """Union, near-line merge, confidence; ordered by severity and confidence within a file."""
    merged = with_agreement(merge_near_lines(reduce(DataFrame.unionByName, unified)))
    return order_findings(merged, by=["file_id"])


def order_findings(findings: DataFrame, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Most severe first, then most confident."""
    ties = ties if ties is not None else [c for c in ("tool_no", "position") if c in findings.columns]
    return findings.orderBy(*(by or []), sev.severity_rank(F.col("severity")), F.desc("confidence"), *ties)


def combine_verdicts(files: DataFrame, findings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per file the verdict from pattern findings and a model probability.

    ``files``: file_id, probability, is_safe; ``findings``: one row per pattern finding.
    The model adds a finding only where no pattern fired and the text is not safe.
    """
    counts = findings.groupBy("file_id").agg(F.count("*").alias("pattern_count"))
    joined = files.join(counts, "file_id", "left").withColumn("pattern_count", F.coalesce("pattern_count", F.lit(0)))
    none = F.col("pattern_count") == 0
    by_model = none & (F.col("probability") >= threshold) & ~F.col("is_safe")
    return joined.withColumn("model_finding", by_model).withColumn(
        "model_severity", F.when(by_model, F.when(F.col("probability") > 0.8, "HIGH").otherwise("MEDIUM"))).withColumn(
        "finding_count", F.col("pattern_count") + by_model.cast("int")).withColumn(
        "is_vulnerable", ~none | by_model).withColumn(
        "confidence", F.when(none, F.col("probability")).otherwise(F.greatest(F.lit(0.95), F.col("probability"))))


def verdict_text(verdicts: DataFrame) -> DataFrame:
    """Adds ``explanation``. Wants pattern_count, is_vulnerable, probability, structure and sequence share."""
    percent = F.bround(F.col("probability") * 100, 0).cast("int").cast("string")
    found = F.concat(F.lit("Found "), F.col("pattern_count").cast("string"), F.lit(" vulnerability pattern(s) in code. "),
                     F.when(F.col("model_agrees"), F.concat(F.lit("AI model confirms with "), percent, F.lit("% confidence.")))
                     .otherwise(""))
    return verdicts.withColumn("explanation", F.when(
        ~F.col("is_vulnerable"), "No vulnerability patterns detected. Code appears safe.").when(
        F.col("pattern_count") > 0, found).when(
        F.col("structure_share") > 0.6,
        "Structural vulnerability detected: Dangerous API calls or control flow patterns.").when(
        F.col("sequence_share") > 0.6, "Sequential vulnerability detected: Unsafe data flow patterns.").otherwise(
        "Hybrid vulnerability detected: Both structural and sequential risk factors."))


def display_findings(findings: DataFrame) -> DataFrame:
    """Display columns: title-cased rule, lower-case severity, defaults for what is missing."""
    words = capitalize_words(F.replace("rule_id", F.lit("_"), F.lit(" ")))
    return findings.select(
        "file_path", F.coalesce(F.lower("severity"), F.lit("medium")).alias("severity"),
        F.coalesce("start_line", F.lit(1)).alias("line_number"),
        F.coalesce(words, F.lit("Security Issue")).alias("vulnerability_type"),
        F.coalesce("cwe_id", F.lit("CWE-UNKNOWN")).alias("cwe_id"),
        F.coalesce("message", F.lit("Potential security vulnerability detected")).alias("description"),
        F.lit(0.85).alias("confidence"))


_FINDING = ("struct<sources:array<string>,vulnerability_type:string,semgrep_rule:string,severity:string,"
            "explanation:string,line:int,code_snippet:string,cwe_id:string,owasp_category:string,message:string,"
            "tool:string,rule_id:string,start_line:int,end_line:int>")
RESPONSE_SCHEMA = (
    f"findings array<{_FINDING}>, vulnerabilities array<{_FINDING}>, code_language string, language string, "
    f"file_results array<struct<file_path:string,language:string,findings:array<{_FINDING}>>>, "
    f"file_result struct<file_path:string,language:string,findings:array<{_FINDING}>>, "
    f"results array<struct<file_path:string,language:string,findings:array<{_FINDING}>>>")


def unify_responses(responses: DataFrame, column: str = "body") -> DataFrame:
    """Scan responses in five shapes as one finding table; the first shape present wins."""
    kept = [c for c in responses.columns if c != column]
    parsed = responses.select(*kept, F.from_json(column, RESPONSE_SCHEMA).alias("r"))
    language = F.coalesce("r.code_language", "r.language", F.lit("unknown"))
    flat = F.array(F.struct(F.lit("code_input").alias("file_path"), language.alias("language"),
                            F.coalesce("r.findings", "r.vulnerabilities").alias("findings")))
    shape = (F.when(F.col("r.findings").isNotNull(), "findings")
             .when(F.col("r.vulnerabilities").isNotNull(), "vulnerabilities").otherwise("files"))
    files = F.coalesce("r.file_results", F.when(F.col("r.file_result").isNotNull(), F.array("r.file_result")), "r.results")
    rows = parsed.select(*kept, shape.alias("shape"),
                         F.explode(F.when(shape == "files", files).otherwise(flat)).alias("file"))
    rows = rows.select(*kept, "shape", F.col("file.file_path").alias("file_path"),
                       F.col("file.language").alias("language"), F.explode("file.findings").alias("f"))
    hybrid, model = F.col("shape") == "findings", F.col("shape") == "vulnerabilities"
    line = F.coalesce(F.when(hybrid | model, F.col("f.line")).otherwise(F.col("f.start_line")), F.lit(1))
    return rows.select(
        *kept, "file_path", "language",
        F.when(hybrid, F.coalesce(F.array_join("f.sources", ","), F.lit("hybrid"))).when(model, "ml")
        .otherwise(F.col("f.tool")).alias("tool"),
        F.when(hybrid, F.coalesce("f.vulnerability_type", "f.semgrep_rule", F.lit("security-issue")))
        .when(model, F.coalesce("f.cwe_id", F.lit("security-issue"))).otherwise(F.col("f.rule_id")).alias("rule_id"),
        F.coalesce("f.severity", F.lit("MEDIUM")).alias("severity"),
        F.when(hybrid, F.coalesce("f.explanation", F.lit("Potential vulnerability detected")))
        .when(model, F.coalesce("f.message", F.lit("Potential vulnerability detected"))).otherwise(F.col("f.message")).alias("message"),
        line.alias("start_line"), F.when(hybrid | model, line).otherwise(F.col("f.end_line")).alias("end_line"),
        F.col("f.code_snippet").alias("code_snippet"), F.col("f.cwe_id").alias("cwe_id"))


