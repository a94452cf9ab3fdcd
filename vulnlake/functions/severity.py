"""Severity scales and the mappings between them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
UNKNOWN_RANK = 99

# Scales of the tools and of the report formats.
SEMGREP_SCALE = {
    "CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW",
    "INFO": "INFO", "ERROR": "HIGH", "WARNING": "MEDIUM",
}
SEMGREP_REPORT_SCALE = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
BANDIT_SCALE = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW", "INFO": "INFO"}
BANDIT_REPORT_SCALE = {"LOW": "LOW", "MEDIUM": "MEDIUM", "HIGH": "HIGH"}
BANDIT_CONFIDENCE = {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECURITY_SEVERITY = {"critical": "9.0", "high": "7.0", "medium": "4.0", "low": "1.0", "info": "0.0"}
SEMGREP_CONFIDENCE = 0.85


def severity_rank_of(severity: str) -> int:
    return SEVERITIES.index(severity) if severity in SEVERITIES else UNKNOWN_RANK


def mapped(col: Column, values: dict, default=None) -> Column:
    """Lookup in a small literal map; a missing key gives ``default``."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    found = F.try_element_at(literal, col)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(col: Column) -> Column:
    """CRITICAL 0 to INFO 4, anything else 99."""
    return mapped(col, {s: i for i, s in enumerate(SEVERITIES)}, UNKNOWN_RANK)


def severity_of_rank(col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), col + 1)


def from_semgrep(col: Column) -> Column:
    """Unified severity of a Semgrep or pattern severity; unknown gives MEDIUM."""
    return mapped(F.upper(col), SEMGREP_SCALE, "MEDIUM")


def from_bandit(col: Column) -> Column:
    return mapped(F.upper(col), BANDIT_SCALE, "MEDIUM")


def bandit_confidence(col: Column) -> Column:
    return mapped(F.upper(col), BANDIT_CONFIDENCE, 0.5)


def from_probability(col: Column) -> Column:
    """Severity of a model finding."""
    return F.when(col >= 0.9, "HIGH").when(col >= 0.7, "MEDIUM").otherwise("LOW")


def sarif_level(col: Column) -> Column:
    return mapped(F.lower(F.coalesce(col, F.lit("medium"))), SARIF_LEVEL, "warning")


def security_severity(col: Column) -> Column:
    return mapped(F.lower(F.coalesce(col, F.lit("medium"))), SECURITY_SEVERITY, "4.0")


def risk_level(score: Column) -> Column:
    return (F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH")
            .when(score >= 25, "MEDIUM").otherwise("LOW"))


def score_label(percent: Column) -> Column:
    return (F.when(percent >= 80, "Excellent").when(percent >= 60, "Good")
            .when(percent >= 40, "Fair").otherwise("Poor"))


def report_severity(col: Column) -> Column:
    """Severity column of the flat report, from any tool's wording."""
    text = F.upper(col)
    return (F.when(text.contains("CRITICAL"), "CRITICAL")
            .when(text.contains("ERROR"), "HIGH")
            .when(text.contains("WARNING"), "MEDIUM")
            .when(text.contains("INFO") | text.contains("LOW"), "LOW")
            .otherwise("MEDIUM"))
