"""Severity counts, risk and compliance scores, coverage and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.dimensions import ASVS, OWASP_CATEGORIES, PCI_DSS
from vulnlake.functions import severity as sev
from vulnlake.functions.text import abbreviate, slug
from vulnlake.operators.lookups import with_asvs, with_owasp_2021, with_pci
from vulnlake.operators.scale import first_per_group, number_rows

# Points per finding of a severity.
PROJECT_WEIGHTS = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 3, "LOW": 1}
DEPENDENCY_WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 5, "LOW": 1}
COMPLIANCE_WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 5, "LOW": 1}
REPORT_WEIGHTS = {"CRITICAL": 35, "HIGH": 18, "MEDIUM": 4, "LOW": 1.5, "INFO": 0.5}
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))


def severity_counts(findings: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """One count column per severity, zero filled, and the total; other severities count in the total."""
    counts = [F.count_if(F.upper(severity) == s).alias(f"{s.lower()}_count") for s in sev.SEVERITIES]
    return findings.groupBy(*keys).agg(F.count("*").alias("total"), *counts)


def _points(weights: dict) -> Column:
    total = None
    for name, weight in weights.items():
        term = F.coalesce(F.col(f"{name.lower()}_count"), F.lit(0)) * weight
        total = term if total is None else total + term
    return total


def project_risk() -> Column:
    return F.least(F.lit(100), _points(PROJECT_WEIGHTS))


def dependency_risk() -> Column:
    return F.least(F.lit(100), _points(DEPENDENCY_WEIGHTS))


def report_risk() -> Column:
    """Halves round up."""
    return F.least(F.lit(100), F.floor(_points(REPORT_WEIGHTS) + 0.5))


def compliance_score(counts: DataFrame) -> DataFrame:
    """Adds score, grade and the deduction of each severity."""
    score = F.greatest(F.lit(0), F.lit(100) - _points(COMPLIANCE_WEIGHTS))
    grade = F.when(score >= GRADES[0][1], GRADES[0][0])
    for name, least in GRADES[1:]:
        grade = grade.when(score >= least, name)
    return counts.select("*", score.alias("score"), grade.otherwise("F").alias("grade"), *[
        (F.col(f"{s.lower()}_count") * w).alias(f"{s.lower()}_deduction") for s, w in COMPLIANCE_WEIGHTS.items()])


def project_summary(files: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per project from one row per file (language, total, severity counts)."""
    names = [f"{s.lower()}_count" for s in PROJECT_WEIGHTS]
    totals = files.groupBy(*keys).agg(
        F.count("*").alias("total_files"), F.count_if(F.col("total") > 0).alias("files_with_vulnerabilities"),
        F.sum("total").alias("total_vulnerabilities"), *[F.sum(n).alias(n) for n in names])
    return totals.withColumn("risk_score", project_risk())


def language_breakdown(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files per language; as a map column use ``language_map``."""
    return files.groupBy(*keys, "language").agg(F.count("*").alias("files"))


def language_map(files: DataFrame, keys: list[str]) -> DataFrame:
    counted = language_breakdown(files, keys)
    return counted.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("language", "files")))).alias("language_breakdown"))


def owasp_coverage(findings: DataFrame, keys: list[str], column: str = "owasp_category") -> DataFrame:
    covered = F.count_distinct(column)
    total = len(OWASP_CATEGORIES)
    return findings.groupBy(*keys).agg(
        F.lit(total).alias("total_categories"), covered.alias("covered_categories"),
        (covered / total * 100).alias("coverage_percentage"))


def owasp_counts(findings: DataFrame, keys: list[str], column: str = "owasp_category") -> DataFrame:
    return findings.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("findings"))


def source_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per detection source; a finding of several sources counts for each."""
    return (findings.select(*keys, F.explode(F.array_distinct("sources")).alias("source"))
            .groupBy(*keys, "source").agg(F.count("*").alias("findings")))


def secret_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count("*").alias("secrets_found"), F.array_sort(F.collect_set("type")).alias("types"))


def requirement_violations(findings: DataFrame, keys: list[str], frameworks=("OWASP_ASVS", "PCI_DSS")) -> DataFrame:
    """Findings per framework requirement."""
    known = {"OWASP_ASVS": (with_asvs, "asvs_requirement"), "PCI_DSS": (with_pci, "pci_requirement"),
             "OWASP_TOP_10": (with_owasp_2021, "owasp_id")}
    cols = {name: known[name] for name in frameworks}
    frame = findings
    for add, _ in cols.values():
        frame = add(frame)
    requirements = F.array_compact(F.array(*[
        F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}:"), F.col(column))) for name, (_, column) in cols.items()]))
    return (frame.select(*keys, F.explode(requirements).alias("requirement"))
            .groupBy(*keys, "requirement").agg(F.count("*").alias("findings")))


def with_requirements(findings: DataFrame, frameworks=("OWASP_ASVS", "PCI_DSS")) -> DataFrame:
    """A row for each requirement a finding maps to: ``requirement`` as framework:id, ``framework_no``, and ``compliance`` with its details."""
    def entry(number, name, title, requirement, section, description, level=None):
        return F.when(F.col(requirement).isNotNull(), F.struct(
            F.lit(number).alias("framework_no"), F.concat(F.lit(f"{name}:"), F.col(requirement)).alias("requirement"),
            F.struct(F.lit(title).alias("framework"), F.col(requirement).alias("requirement_id"), F.col(section).alias("section"), description.alias("description"),
                     (F.lit(None) if level is None else F.col(level)).cast("string").alias("level")).alias("compliance")))

    known = {
        "OWASP_ASVS": (with_asvs, lambda i: entry(i, "OWASP_ASVS", "OWASP ASVS 4.0", "asvs_requirement", "asvs_section", F.col("asvs_description"), "asvs_level")),
        "PCI_DSS": (with_pci, lambda i: entry(i, "PCI_DSS", "PCI-DSS 4.0", "pci_requirement", "pci_category", F.col("pci_description"))),
        "OWASP_TOP_10": (with_owasp_2021, lambda i: entry(i, "OWASP_TOP_10", "OWASP Top 10 2021", "owasp_id", "owasp_2021",
                                                          F.concat(F.lit("Maps to "), F.col("owasp_2021"))))}
    frame = findings
    for name in frameworks:
        frame = known[name][0](frame)
    entries = F.array_compact(F.array(*[known[name][1](i) for i, name in enumerate(frameworks)]))
    return frame.select(*findings.columns, F.inline(entries))


def framework_compliance(findings: DataFrame, keys: list[str], frameworks=("OWASP_ASVS", "PCI_DSS")) -> DataFrame:
    """Share of the frameworks' listed types without a violated requirement, in percent.

    The number of listed types is the sum over the frameworks, which is the evident intent.
    """
    total = (len(ASVS) if "OWASP_ASVS" in frameworks else 0) + (len(PCI_DSS) if "PCI_DSS" in frameworks else 0)
    violated = requirement_violations(findings, keys, frameworks).groupBy(*keys).agg(F.count("*").alias("violations"))
    counted = findings.groupBy(*keys).agg(F.count("*").alias("total_findings"))
    joined = counted.join(violated, keys, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    score = F.greatest(F.lit(0.0), (F.lit(total) - F.col("violations")) / F.lit(max(total, 1)) * 100)
    return joined.withColumn("compliance_score", F.bround(score, 1))


def recommendations(findings: DataFrame, keys: list[str], order: str, limit: int = 10) -> DataFrame:
    """Advice for the first types (in order) that have an ASVS entry, at most ten per key."""
    firsts = findings.groupBy(*keys, "type").agg(F.min(order).alias("_first"))
    known = with_asvs(firsts).filter(F.col("asvs_requirement").isNotNull())
    text = F.concat(F.lit("Implement "), F.col("asvs_description"), F.lit(" (ASVS "), F.col("asvs_requirement"), F.lit(")"))
    # at most as many rows per key as the ASVS table has types
    ranked = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", text.alias("text")))).alias("_r"))
    return ranked.select(*keys, F.posexplode(F.slice("_r", 1, limit)).alias("_p", "_x")).select(
        *keys, (F.col("_p") + 1).alias("place"), F.col("_x.text").alias("recommendation"))


# ------------------------------------------------------------------- exports


def sarif_rules(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One rule per finding type, described by the type's first finding."""
    first = first_per_group(findings.withColumn("type", F.coalesce("type", F.lit("unknown"))), [*keys, "type"], F.col(order))
    rows = with_owasp_2021(first)
    kind, cwe = F.col("type"), F.coalesce("cwe", F.lit(""))
    owasp = F.coalesce("owasp_2021", "owasp", F.lit(""))
    return rows.select(
        *keys, F.col(order).alias("first_position"), slug(kind).alias("id"), kind.alias("name"),
        F.concat(kind, F.lit(" vulnerability")).alias("short_description"),
        F.coalesce("message", F.concat(F.lit("Potential "), kind, F.lit(" vulnerability detected"))).alias("full_description"),
        F.coalesce("suggestion", F.concat(F.lit("Review and fix "), kind, F.lit(" vulnerability"))).alias("help_text"),
        F.concat(F.lit("### "), kind, F.lit("\n\n**CWE**: "), cwe, F.lit("\n\n**OWASP**: "), owasp,
                 F.lit("\n\n**Remediation**: "), F.coalesce("suggestion", F.lit("Review the flagged code"))).alias("help_markdown"),
        F.when(cwe != "", F.array(cwe, owasp)).otherwise(F.array().cast("array<string>")).alias("tags"),
        sev.security_severity(F.col("severity")).alias("security_severity"))


def sarif_results(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    return findings.select(
        *keys, F.col(order).alias("position"),
        slug(F.coalesce("type", F.lit("unknown"))).alias("rule_id"),
        sev.sarif_level(F.col("severity")).alias("level"),
        F.coalesce("message", F.lit("Security vulnerability detected")).alias("text"),
        F.coalesce("file", F.lit("unknown")).alias("uri"),
        F.coalesce("line", F.lit(1)).alias("start_line"),
        F.coalesce("column", F.lit(1)).alias("start_column"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("cwe", F.lit("")).alias("cwe"), F.coalesce("owasp", F.lit("")).alias("owasp"),
        F.when(F.col("suggestion") != "", F.col("suggestion")).alias("fix"))


def csv_rows(findings: DataFrame) -> DataFrame:
    """Rows of the findings CSV, blanks for what is missing."""
    rows = with_pci(with_asvs(findings))

    def blank(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return rows.select(
        blank("line").alias("Line"), blank("type").alias("Type"), blank("severity").alias("Severity"),
        blank("cwe").alias("CWE"), blank("owasp").alias("OWASP"), blank("message").alias("Message"),
        blank("asvs_requirement").alias("ASVS Requirement"), blank("pci_requirement").alias("PCI-DSS Requirement"))


def flat_rows(findings: DataFrame, *keep: str) -> DataFrame:
    """Columns of the flat report, and those to keep beside them."""
    message = F.col("message")
    head = F.element_at(F.split(message, "\n"), 1)
    name = F.when(F.coalesce(message, F.lit("")) != "", head).otherwise(F.col("rule_id"))
    return findings.select(
        *keep, "file_path", "start_line", sev.report_severity(F.col("severity")).alias("severity"),
        abbreviate(name, 70, 67).alias("title"),
        F.coalesce(F.when(F.col("cwe_id") != "", F.col("cwe_id")), F.lit("N/A")).alias("cwe"),
        F.coalesce(F.when(F.col("owasp_category") != "", F.col("owasp_category")), F.lit("N/A")).alias("owasp"),
        F.coalesce(abbreviate(message, 300, 300), F.lit("")).alias("description"), "rule_id")


def flat_report(findings: DataFrame, order=("file_path", "start_line", "rule_id"), by: list[str] | None = None) -> DataFrame:
    """Adds ``finding_num``, a running number from 1, per ``by`` group or over all rows."""
    return number_rows(findings, [F.col(c) for c in order], "finding_num", by)
