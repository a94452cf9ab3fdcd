"""JSON reports of external scanners as finding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.severity import BANDIT_REPORT_SCALE, SEMGREP_REPORT_SCALE, mapped
from vulnlake.functions.text import strip

BANDIT_REPORT = ("results array<struct<test_id:string,test_name:string,issue_severity:string,issue_confidence:string,"
                 "issue_text:string,line_number:int,code:string,cwe:struct<id:string>>>")
SEMGREP_REPORT = ("results array<struct<check_id:string,start:struct<line:int>,end:struct<line:int>,"
                  "extra:struct<severity:string,message:string,lines:string,metadata:struct<cwe:array<string>>>>>")


def _results(reports: DataFrame, column: str, schema: str):
    kept = [c for c in reports.columns if c != column]
    return kept, reports.select(*kept, F.explode(F.from_json(column, schema)["results"]).alias("r"))


def parse_bandit(reports: DataFrame, column: str = "report") -> DataFrame:
    """Findings of Bandit reports; a broken report gives none."""
    kept, rows = _results(reports, column, BANDIT_REPORT)
    line = F.coalesce("r.line_number", F.lit(1))
    return rows.select(
        *kept, F.lit("bandit").alias("tool"), F.coalesce("r.test_id", F.lit("")).alias("rule_id"),
        mapped(F.col("r.issue_severity"), BANDIT_REPORT_SCALE, "MEDIUM").alias("severity"),
        F.coalesce("r.issue_text", F.lit("")).alias("message"), line.alias("start_line"), line.alias("end_line"),
        strip(F.coalesce("r.code", F.lit(""))).alias("code_snippet"), F.col("r.cwe.id").alias("cwe_id"))


def parse_semgrep(reports: DataFrame, column: str = "report") -> DataFrame:
    """Findings of Semgrep reports; the first CWE of the list counts."""
    kept, rows = _results(reports, column, SEMGREP_REPORT)
    return rows.select(
        *kept, F.lit("semgrep").alias("tool"), F.coalesce("r.check_id", F.lit("")).alias("rule_id"),
        mapped(F.upper(F.coalesce("r.extra.severity", F.lit("WARNING"))), SEMGREP_REPORT_SCALE, "MEDIUM").alias("severity"),
        F.coalesce("r.extra.message", F.lit("")).alias("message"),
        F.coalesce("r.start.line", F.lit(1)).alias("start_line"), F.coalesce("r.end.line", F.lit(1)).alias("end_line"),
        strip(F.coalesce("r.extra.lines", F.lit(""))).alias("code_snippet"),
        F.try_element_at("r.extra.metadata.cwe", F.lit(1)).alias("cwe_id"))
