"""Queries of lookups, reports, history, dependencies and request limits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vulnlake import dimensions as dim
from vulnlake.functions import severity as sev
from vulnlake.functions import versions
from vulnlake.functions.text import abbreviate
from vulnlake.operators import dependencies as deps
from vulnlake.operators import findings as fnd
from vulnlake.operators import history, lookups, reports, scan
from vulnlake.operators.filters import filter_findings
from vulnlake.operators.scale import kept
from vulnlake.plans import tables as t
from vulnlake.plans.registry import query
from vulnlake.plans.scan_queries import PORTABLE, W1_SQL
from vulnlake.plans.tables import q, read, sql_list, whole_quotient, with_tables
from vulnlake.session import ensure_checkpoint_dir
from vulnlake.sources import documents, sinks, tool_reports
from vulnlake.streaming import admission


def sql_values(rows, name):
    def cell(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else sql_list(v) if isinstance(v, list) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS {name}"


SQL_ASVS = sql_values([(k, s, ", ".join(r), lvl, d) for k, (s, r, lvl, d) in dim.ASVS.items()], "a(type, asvs_section, asvs_requirement, asvs_level, asvs_description)")
SQL_PCI = sql_values([(k, *v) for k, v in dim.PCI_DSS.items()], "p(type, pci_requirement, pci_category, pci_description)")
SQL_CWE = sql_values(list(dim.CWE_OWASP_2021.items()), "c(cwe, owasp_2021)")


def with_findings(body):
    return with_tables(t.FINDINGS, body=body)


# --------------------------------------------------------------------- lookups


@query("x1_asvs", with_findings(f"SELECT f.position, f.type, a.asvs_section, a.asvs_requirement, coalesce(a.asvs_level, 0) AS asvs_level FROM findings f LEFT JOIN {SQL_ASVS} ON f.type = a.type"))
def asvs(spark, sf):
    return lookups.with_asvs(t.findings(spark, sf)).select("position", "type", "asvs_section", "asvs_requirement", F.coalesce("asvs_level", F.lit(0)).alias("asvs_level"))


@query("x2_pci", with_findings(f"SELECT f.position, f.type, p.pci_requirement, p.pci_category FROM findings f LEFT JOIN {SQL_PCI} ON f.type = p.type"))
def pci(spark, sf):
    return lookups.with_pci(t.findings(spark, sf)).select("position", "type", "pci_requirement", "pci_category")


@query("x3_owasp_2021", with_findings(f"SELECT f.position, f.cwe, c.owasp_2021, string_split(c.owasp_2021, ' - ')[1] AS owasp_id FROM findings f LEFT JOIN {SQL_CWE} ON f.cwe = c.cwe"))
def owasp_2021(spark, sf):
    return lookups.with_owasp_2021(t.findings(spark, sf)).select("position", "cwe", "owasp_2021", "owasp_id")


def sql_contained(text, index, fallbacks):
    parts = {}
    for category, row in dim.OWASP_CATEGORIES.items():
        for part in row[index]:
            parts[part.lower()] = category
    cases = " ".join(f"WHEN contains(lower({text}), {q(p)}) THEN {q(c)}" for p, c in parts.items())
    rest = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), {q(w)})" for w in words) + f" THEN {q(c)}" for words, c in fallbacks)
    return f"(CASE {cases} {rest} END)"


SQL_RULE_OWASP = sql_contained("rule_id", 2, dim.RULE_ID_FALLBACKS)
SQL_TYPE_OWASP = sql_contained("type", 4, dim.TYPE_FALLBACKS)
BANDIT = {test: category for category, row in dim.OWASP_CATEGORIES.items() for test in row[3]}
SQL_TEST_OWASP = "(CASE test_id " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in BANDIT.items()) + " END)"


@query("x4_x5_x6_owasp_of_finding", with_findings(f"SELECT position, {SQL_RULE_OWASP} AS by_rule, {SQL_TYPE_OWASP} AS by_type, {SQL_TEST_OWASP} AS by_test FROM findings"))
def owasp_of_finding(spark, sf):
    return t.findings(spark, sf).select("position", lookups.owasp_of_rule_id(F.col("rule_id")).alias("by_rule"),
                                        lookups.owasp_of_type(F.col("type")).alias("by_type"), lookups.owasp_of_test(F.col("test_id")).alias("by_test"))


# A catalogue that grows with the parts: number k stands at a scattered place and is found in messages about parts that begin with it.
CATALOGUE_SQL = "catalogue AS (SELECT p_partkey * 7919 % 1000003 AS place, 'Issue ' || CAST(p_partkey AS VARCHAR) AS part, 'C' || CAST(p_partkey % 97 AS VARCHAR) AS category FROM part)"


@query("x4_x5_large_catalogue", f"""WITH {t.FINDINGS}, {CATALOGUE_SQL}, texts AS (SELECT DISTINCT lower(message) AS m FROM findings),
  found AS (SELECT m, arg_min(category, place) AS category FROM texts JOIN catalogue ON contains(m, lower(part)) GROUP BY m)
  SELECT position, category FROM findings LEFT JOIN found ON m = lower(message)""")
def large_catalogue(spark, sf):
    """First part of a large catalogue that each message holds."""
    k = F.col("p_partkey")
    catalogue = read(spark, sf, "part").select((k * 7919 % 1000003).alias("place"), F.concat(F.lit("Issue "), k.cast("string")).alias("part"),
                                               F.concat(F.lit("C"), (k % 97).cast("string")).alias("category"))
    return lookups.first_contained(t.findings(spark, sf).select("position", "message"), "message", catalogue).select("position", "category")


SQL_GROUPS = sql_values([(n, g) for g, ns in reversed(list(dim.CWE_GROUPS.items())) for n in ns], "g(cwe_id, owasp_category)")


@query("x7_cwe_group", with_tables(t.SAMPLES, body=f"""SELECT s.sample_id, s.cwe_id, g.owasp_category, coalesce(g.owasp_category, 'A05') AS with_default
  FROM samples s LEFT JOIN {SQL_GROUPS} ON s.cwe_id = g.cwe_id"""))
def cwe_group(spark, sf):
    rows = lookups.with_cwe_group(t.samples(spark, sf).select("sample_id", "cwe_id"), keep_unmapped=True)
    return rows.select("sample_id", "cwe_id", "owasp_category", F.coalesce("owasp_category", F.lit(dim.DEFAULT_CWE_GROUP)).alias("with_default"))


@query("p24_owasp_categories", with_findings(f"""SELECT o.id, o.name, o.description, count(f.position) AS findings FROM
  {sql_values([(k, v[0], v[1]) for k, v in dim.OWASP_CATEGORIES.items()], 'o(id, name, description)')} LEFT JOIN (SELECT position, {SQL_TYPE_OWASP} AS c FROM findings) f ON f.c = o.id GROUP BY ALL"""))
def owasp_categories(spark, sf):
    counts = t.findings(spark, sf).groupBy(lookups.owasp_of_type(F.col("type")).alias("id")).agg(F.count("*").alias("n"))
    return dim.owasp_table(spark).join(counts, "id", "left").select("id", "name", "description", F.coalesce("n", F.lit(0)).alias("findings"))


SQL_REMEDY = sql_values([(k, dim.CWE_DISPLAY_OWASP.get(k), dim.CWE_REMEDIATION.get(k)) for k in dict.fromkeys([*dim.CWE_DISPLAY_OWASP, *dim.CWE_REMEDIATION])],
                        "r(cwe_id, owasp_label, recommendation)")


@query("x10_remediation", with_findings(f"""SELECT f.position, f.cwe AS cwe_id, coalesce(r.owasp_label, 'Unknown Category') AS owasp_label,
  coalesce(r.recommendation, 'Review and fix the security issue at line ' || CAST(f.line AS VARCHAR) || '. Consult the CWE database for more information.') AS recommendation
  FROM findings f LEFT JOIN {SQL_REMEDY} ON f.cwe = r.cwe_id"""))
def remediation(spark, sf):
    rows = t.findings(spark, sf).select("position", F.col("cwe").alias("cwe_id"), F.col("line").alias("start_line"))
    return lookups.with_remediation(rows).select("position", "cwe_id", "owasp_label", "recommendation")


# ------------------------------------------------------------ merge, confidence

BASE = "(position // 1000) % 2 = 0"


@query("x9_merge_tools", with_findings(f"""SELECT position, file, line, cwe FROM findings WHERE {BASE} UNION ALL
  SELECT position, file, line, cwe FROM (SELECT e.position, e.file, e.line, e.cwe, row_number() OVER (PARTITION BY e.file, e.line, e.cwe ORDER BY e.position) AS n
    FROM findings e WHERE NOT {BASE} AND NOT EXISTS (SELECT 1 FROM findings b WHERE (b.position // 1000) % 2 = 0 AND b.file = e.file AND b.line = e.line AND b.cwe IS NOT DISTINCT FROM e.cwe)) WHERE n = 1"""))
def merge_tools(spark, sf):
    rows = t.findings(spark, sf).select("position", "file", "line", "cwe")
    first = whole_quotient(F.col("position"), 1000) % 2 == 0
    return lookups.merge_findings(rows.filter(first), rows.filter(~first), ("file", "line", "cwe"), "position")


@query("u2_union_of_scanners", with_tables(t.CODE_FILES, t.FINDINGS, body=f"""SELECT 'pattern' AS tool, rule_id, severity, cwe_id FROM ({W1_SQL})
  UNION ALL SELECT 'report' AS tool, rule_id, severity, cwe AS cwe_id FROM findings"""))
def union_of_scanners(spark, sf):
    own = scan.scan_code(t.code_files(spark, sf).select("file_id", "language", "text"), PORTABLE, unicode=False)
    other = t.findings(spark, sf).select(F.lit("report").alias("tool"), "rule_id", "severity", F.col("cwe").alias("cwe_id"))
    return own.select("tool", "rule_id", "severity", "cwe_id").unionByName(other)


@query("z14_severity_maps", with_findings("""SELECT position, CASE lower(severity) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' WHEN 'info' THEN 'note' ELSE 'warning' END AS sarif_level,
  CASE lower(severity) WHEN 'critical' THEN '9.0' WHEN 'high' THEN '7.0' WHEN 'medium' THEN '4.0' WHEN 'low' THEN '1.0' WHEN 'info' THEN '0.0' ELSE '4.0' END AS security_severity,
  CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') THEN severity ELSE 'MEDIUM' END AS unified,
  CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS by_probability,
  CASE WHEN confidence * 100 >= 75 THEN 'CRITICAL' WHEN confidence * 100 >= 50 THEN 'HIGH' WHEN confidence * 100 >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN confidence * 100 >= 80 THEN 'Excellent' WHEN confidence * 100 >= 60 THEN 'Good' WHEN confidence * 100 >= 40 THEN 'Fair' ELSE 'Poor' END AS score_label,
  CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' WHEN severity IN ('INFO', 'LOW') THEN 'LOW' ELSE 'MEDIUM' END AS report_severity FROM findings"""))
def severity_maps(spark, sf):
    s, c = F.col("severity"), F.col("confidence")
    return t.findings(spark, sf).select(
        "position", sev.sarif_level(s).alias("sarif_level"), sev.security_severity(s).alias("security_severity"), sev.from_bandit(s).alias("unified"),
        sev.from_probability(c).alias("by_probability"), sev.risk_level(c * 100).alias("risk_level"), sev.score_label(c * 100).alias("score_label"),
        sev.report_severity(s).alias("report_severity"))


SOURCE_SETS = [["semgrep"], ["bandit"], ["ml"], ["bandit", "semgrep"], ["ml", "semgrep"], ["bandit", "ml", "semgrep"]]


@query("z15_z16_confidence", with_findings(f"""SELECT position, round(CASE WHEN ml AND n > 1 THEN least(b + 0.05, 1.0) ELSE b END, 6) AS confidence, tool_confidence
  FROM (SELECT position, n, ml, tool_confidence, CASE WHEN n = 2 THEN least(confidence + 0.10, 1.0) WHEN n >= 3 THEN least(confidence + 0.15, 1.0) ELSE confidence END AS b
  FROM (SELECT position, CAST(confidence AS DOUBLE) AS confidence, {sql_list([len(s) for s in SOURCE_SETS])}[1 + position % 6] AS n,
  {sql_list([1 if "ml" in s else 0 for s in SOURCE_SETS])}[1 + position % 6] = 1 AS ml,
  CAST(CASE severity WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.5 ELSE 0.5 END AS DOUBLE) AS tool_confidence FROM findings))"""))
def confidences(spark, sf):
    sets = F.array(*[F.array(*[F.lit(x) for x in s]) for s in SOURCE_SETS])
    sources = F.element_at(sets, (F.col("position") % 6).cast("int") + 1)
    return t.findings(spark, sf).select("position", F.round(fnd.agreed_confidence(F.col("confidence"), sources), 6).alias("confidence"),
                                        sev.bandit_confidence(F.col("severity")).alias("tool_confidence"))


def _tool_findings(spark, sf):
    """Unified findings of three tools per file, some files crowded."""
    f = t.findings(spark, sf)
    tool = F.when(F.col("position") % 5 == 0, 1).when(F.col("position") % 7 == 0, 2).otherwise(0)
    names = F.array(F.lit("semgrep"), F.lit("bandit"), F.lit("ml"))
    return f.select(
        F.col("file").alias("file_id"), tool.alias("tool_no"), "position", "line", F.col("type").alias("vulnerability_type"),
        sev.from_bandit(F.col("severity")).alias("severity"), "confidence", F.array(F.element_at(names, tool + 1)).alias("sources"),
        F.lit("").alias("code_snippet"), F.col("message").alias("explanation"), F.when(tool == 0, F.col("rule_id")).alias("semgrep_rule"),
        F.when(tool == 1, F.col("test_id")).alias("bandit_test"), F.when(tool == 2, F.col("confidence")).alias("ml_probability"),
        F.col("cwe").alias("cwe_id"), lookups.owasp_of_type(F.col("type")).alias("owasp_category"))


# The serial fold: lines of a file one after the other in order of arrival, with the anchors so far as state.
NEAR_LINES_SQL = f"""WITH RECURSIVE {t.FINDINGS},
unified AS (SELECT *, file AS file_id, CASE WHEN position % 5 = 0 THEN 1 WHEN position % 7 = 0 THEN 2 ELSE 0 END AS tool_no,
  CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') THEN severity ELSE 'MEDIUM' END AS unified_severity, {SQL_TYPE_OWASP} AS owasp_category FROM findings),
ordered AS (SELECT file_id, line, row_number() OVER (PARTITION BY file_id ORDER BY arrival, line) AS n
  FROM (SELECT file_id, line, min((tool_no, position)) AS arrival FROM unified GROUP BY file_id, line)),
fold AS (SELECT file_id, line, n, [line] AS anchors, line AS anchor FROM ordered WHERE n = 1
  UNION ALL SELECT file_id, line, n, CASE WHEN near IS NULL THEN list_append(anchors, line) ELSE anchors END, coalesce(near, line)
  FROM (SELECT o.file_id, o.line, o.n, f.anchors, list_filter(f.anchors, lambda a: abs(a - o.line) <= 2)[1] AS near
    FROM fold f JOIN ordered o ON o.file_id = f.file_id AND o.n = f.n + 1)),
merged AS (SELECT u.file_id, min((tool_no, position)) AS arrival,
  arg_min(u.line, (tool_no, position)) AS line, arg_min(type, (tool_no, position)) AS vulnerability_type, '' AS code_snippet,
  arg_min((message, 1), (tool_no, position))[1] AS explanation, arg_min((cwe, 1), (tool_no, position))[1] AS cwe_id,
  arg_min((owasp_category, 1), (tool_no, position))[1] AS owasp_category, min(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], unified_severity)) AS rank,
  max(CAST(confidence AS DOUBLE)) AS confidence, list_sort(list_distinct(list(CASE tool_no WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'ml' END))) AS sources,
  arg_max(rule_id, (tool_no, position)) FILTER (tool_no = 0) AS semgrep_rule, arg_max(test_id, (tool_no, position)) FILTER (tool_no = 1) AS bandit_test,
  arg_max(CAST(confidence AS DOUBLE), (tool_no, position)) FILTER (tool_no = 2) AS ml_probability
  FROM unified u JOIN fold f ON u.file_id = f.file_id AND u.line = f.line GROUP BY u.file_id, f.anchor)
SELECT file_id, line, vulnerability_type, code_snippet, explanation, cwe_id, owasp_category, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][rank] AS severity,
  confidence, sources, semgrep_rule, bandit_test, ml_probability, arrival[1] AS tool_no, arrival[2] AS position FROM merged"""


@query("w5_near_line_merge", NEAR_LINES_SQL)
def near_line_merge(spark, sf):
    return fnd.merge_near_lines(_tool_findings(spark, sf))


@query("m5_combined_tools", f"""SELECT * EXCLUDE (several) REPLACE (CASE WHEN len(sources) > 1 AND list_contains(sources, 'ml') THEN least(several + 0.05, 1.0) ELSE several END AS confidence,
  CASE WHEN len(sources) >= 3 THEN list_append(sources, 'hybrid') ELSE sources END AS sources)
  FROM (SELECT *, CASE WHEN len(sources) = 2 THEN least(confidence + 0.10, 1.0) WHEN len(sources) >= 3 THEN least(confidence + 0.15, 1.0) ELSE confidence END AS several
    FROM ({NEAR_LINES_SQL}))""")
def combined_tools(spark, sf):
    return fnd.combine_tools(_tool_findings(spark, sf))


@query("l1_ordered_findings", with_findings("""SELECT position, severity, confidence FROM (SELECT position, severity, CAST(confidence AS DOUBLE) AS confidence,
  list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity) AS r FROM findings) ORDER BY r NULLS LAST, confidence DESC, position"""))
def ordered_findings(spark, sf):
    rows = t.findings(spark, sf).select("position", "severity", "confidence")
    return fnd.order_findings(rows, ties=["position"])


@query("p22_display", with_findings("""SELECT file AS file_path, lower(severity) AS severity, line AS line_number,
  array_to_string(list_transform(regexp_extract_all(replace(rule_id, '_', ' '), '\\w+|\\W+'), lambda w: upper(w[1]) || w[2:]), '') AS vulnerability_type,
  cwe AS cwe_id, coalesce(message, 'Potential security vulnerability detected') AS description, CAST(0.85 AS DOUBLE) AS confidence FROM findings"""))
def display(spark, sf):
    f = t.findings(spark, sf)
    return fnd.display_findings(f.select(F.col("file").alias("file_path"), "severity", F.col("line").alias("start_line"), "rule_id", F.col("cwe").alias("cwe_id"), "message"))


@query("p19_filtered_findings", with_findings("SELECT position, file AS file_path, severity FROM findings WHERE file = 'src/f7.py' AND severity = 'HIGH'"))
def filtered_findings(spark, sf):
    rows = t.findings(spark, sf).select("position", F.col("file").alias("file_path"), "severity")
    return filter_findings(rows, "src/f7.py", "high")


@query("p21_unified_responses", with_findings("""SELECT response_id, CASE WHEN shape < 2 THEN 'code_input' ELSE 'a.py' END AS file_path, CASE WHEN shape < 2 THEN 'unknown' ELSE 'python' END AS language,
  ['bandit,semgrep', 'ml', 'pattern', 'pattern'][1 + shape] AS tool, CASE shape WHEN 0 THEN type WHEN 1 THEN cwe ELSE rule_id END AS rule_id, severity,
  CASE WHEN shape < 2 THEN coalesce(message, 'Potential vulnerability detected') ELSE message END AS message, line AS start_line, line AS end_line, cwe AS cwe_id
  FROM (SELECT *, position // 1000000000 AS response_id, (position // 1000000000) % 4 AS shape FROM findings)"""))
def unified_responses(spark, sf):
    """Finding rows out of responses of four shapes, built from the findings."""
    f = t.findings(spark, sf)
    item = F.struct("severity", "message", F.col("line").alias("line"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), "rule_id",
                    F.col("type").alias("vulnerability_type"), F.col("message").alias("explanation"), F.array(F.lit("bandit"), F.lit("semgrep")).alias("sources"),
                    F.col("cwe").alias("cwe_id"), F.lit("pattern").alias("tool"))
    key = whole_quotient(F.col("position"), 1_000_000_000)
    grouped = f.groupBy(key.alias("response_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    shape = F.col("response_id") % 4
    file = F.struct(F.lit("a.py").alias("file_path"), F.lit("python").alias("language"), F.col("items").alias("findings"))
    body = (F.when(shape == 0, F.to_json(F.struct(F.col("items").alias("findings"))))
            .when(shape == 1, F.to_json(F.struct(F.col("items").alias("vulnerabilities"))))
            .when(shape == 2, F.to_json(F.struct(F.array(file).alias("file_results"))))
            .otherwise(F.to_json(F.struct(file.alias("file_result")))))
    return fnd.unify_responses(grouped.select("response_id", body.alias("body"))).drop("code_snippet")


P23_SQL = f"""WITH base AS (SELECT event_id AS file_id, (event_id * 31 % 100) / 100.0 AS probability, event_id % 4 = 0 AS is_safe FROM events),
  counts AS (SELECT l_orderkey AS file_id, count(*) AS n FROM lineitem GROUP BY l_orderkey),
  j AS (SELECT b.*, coalesce(c.n, 0) AS pattern_count FROM base b LEFT JOIN counts c ON b.file_id = c.file_id)
  SELECT file_id, pattern_count, (pattern_count = 0 AND probability >= 0.5 AND NOT is_safe) AS model_finding,
  CASE WHEN pattern_count = 0 AND probability >= 0.5 AND NOT is_safe THEN CASE WHEN probability > 0.8 THEN 'HIGH' ELSE 'MEDIUM' END END AS model_severity,
  pattern_count > 0 OR (probability >= 0.5 AND NOT is_safe) AS is_vulnerable,
  CAST(CASE WHEN pattern_count = 0 THEN probability ELSE greatest(0.95, probability) END AS DOUBLE) AS confidence FROM j"""


@query("p23_verdicts", P23_SQL)
def verdicts(spark, sf):
    i = F.col("event_id")
    files = read(spark, sf, "events").select(i.alias("file_id"), (i * 31 % 100 / 100.0).alias("probability"), (i % 4 == 0).alias("is_safe"))
    hits = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    return fnd.combine_verdicts(files, hits).select("file_id", "pattern_count", "model_finding", "model_severity", "is_vulnerable", "confidence")


@query("z23_verdict_text", f"""SELECT file_id, CASE WHEN NOT is_vulnerable THEN 'No vulnerability patterns detected. Code appears safe.'
  WHEN pattern_count > 0 THEN 'Found ' || CAST(pattern_count AS VARCHAR) || ' vulnerability pattern(s) in code. ' || CASE WHEN agrees THEN 'AI model confirms with ' || CAST(CAST(round_even(probability * 100, 0) AS INTEGER) AS VARCHAR) || '% confidence.' ELSE '' END
  WHEN file_id % 10 > 6 THEN 'Structural vulnerability detected: Dangerous API calls or control flow patterns.' WHEN file_id % 10 < 4 THEN 'Sequential vulnerability detected: Unsafe data flow patterns.'
  ELSE 'Hybrid vulnerability detected: Both structural and sequential risk factors.' END AS explanation
  FROM (SELECT v.*, p.probability, p.probability >= 0.5 AND NOT p.is_safe AS agrees FROM ({P23_SQL}) v JOIN (SELECT event_id AS file_id, CAST((event_id * 31 % 100) / 100.0 AS DOUBLE) AS probability, event_id % 4 = 0 AS is_safe FROM events) p ON p.file_id = v.file_id)""")
def verdict_texts(spark, sf):
    i = F.col("event_id")
    files = read(spark, sf, "events").select(i.alias("file_id"), (i * 31 % 100 / 100.0).alias("probability"), (i % 4 == 0).alias("is_safe"))
    hits = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    share = F.col("file_id") % 10 / 10.0
    rows = fnd.combine_verdicts(files, hits).withColumn("structure_share", share).withColumn("sequence_share", 1 - share).withColumn(
        "model_agrees", (F.col("probability") >= 0.5) & ~F.col("is_safe"))
    return fnd.verdict_text(rows).select("file_id", "explanation")


# --------------------------------------------------------------------- reports

SQL_COUNTS = ", ".join(f"count(*) FILTER (upper(severity) = {q(s)}) AS {s.lower()}_count" for s in sev.SEVERITIES)


@query("a1_severity_counts", with_findings(f"SELECT scan_id, count(*) AS total, {SQL_COUNTS} FROM findings GROUP BY scan_id"))
def counts_by_severity(spark, sf):
    return reports.severity_counts(t.findings(spark, sf), ["scan_id"])


COUNTED = with_tables(t.FINDINGS, f"counted AS (SELECT position // 16000000000000 AS file_id, count(*) AS total, {SQL_COUNTS} FROM findings GROUP BY 1)", body="")


def _counted(spark, sf):
    f = t.findings(spark, sf).withColumn("file_id", whole_quotient(F.col("position"), 16_000_000_000_000))
    return reports.severity_counts(f, ["file_id"])


@query("a7_a8_a9_risk_scores", COUNTED + """SELECT file_id, least(100, 25 * critical_count + 10 * high_count + 3 * medium_count + low_count) AS project_risk,
  least(100, 25 * critical_count + 15 * high_count + 5 * medium_count + low_count) AS dependency_risk,
  CAST(least(100, floor(35 * critical_count + 18 * high_count + 4 * medium_count + 1.5 * low_count + 0.5 * info_count + 0.5)) AS BIGINT) AS report_risk FROM counted""")
def risk_scores(spark, sf):
    return _counted(spark, sf).select("file_id", reports.project_risk().alias("project_risk"), reports.dependency_risk().alias("dependency_risk"),
                                      reports.report_risk().cast("bigint").alias("report_risk"))


@query("a10_compliance_score", COUNTED + """SELECT file_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
  critical_count * 25 AS critical_deduction, high_count * 15 AS high_deduction, medium_count * 5 AS medium_deduction, low_count AS low_deduction
  FROM (SELECT *, greatest(0, 100 - 25 * critical_count - 15 * high_count - 5 * medium_count - low_count) AS score FROM counted)""")
def compliance_scores(spark, sf):
    names = ["score", "grade", "critical_deduction", "high_deduction", "medium_deduction", "low_deduction"]
    return reports.compliance_score(_counted(spark, sf)).select("file_id", *names)


SQL_REQUIREMENTS = f"""SELECT scan_id, 'OWASP_ASVS:' || a.asvs_requirement AS requirement FROM findings f JOIN {SQL_ASVS} ON f.type = a.type
  UNION ALL SELECT scan_id, 'PCI_DSS:' || p.pci_requirement FROM findings f JOIN {SQL_PCI} ON f.type = p.type"""


@query("a11_requirement_violations", with_findings(f"SELECT scan_id, requirement, count(*) AS findings FROM ({SQL_REQUIREMENTS}) GROUP BY ALL"))
def requirement_violations(spark, sf):
    return reports.requirement_violations(t.findings(spark, sf), ["scan_id"])


@query("a11_framework_compliance", with_findings(f"""SELECT t.scan_id, t.n AS total_findings, coalesce(v.n, 0) AS violations,
  round_even(greatest(0.0, (22 - coalesce(v.n, 0)) / CAST(22 AS DOUBLE) * 100), 1) AS compliance_score FROM (SELECT scan_id, count(*) AS n FROM findings GROUP BY 1) t
  LEFT JOIN (SELECT scan_id, count(DISTINCT requirement) AS n FROM ({SQL_REQUIREMENTS}) GROUP BY 1) v ON v.scan_id = t.scan_id"""))
def framework_compliance(spark, sf):
    return reports.framework_compliance(t.findings(spark, sf), ["scan_id"])


@query("a12_owasp_coverage", with_findings(f"""SELECT scan_id, 10 AS total_categories, count(DISTINCT c) AS covered_categories, round(count(DISTINCT c) / 10 * 100, 6) AS coverage_percentage
  FROM (SELECT scan_id, {SQL_TYPE_OWASP} AS c FROM findings) GROUP BY scan_id"""))
def owasp_coverage(spark, sf):
    rows = t.findings(spark, sf).withColumn("owasp_category", lookups.owasp_of_type(F.col("type")))
    return reports.owasp_coverage(rows, ["scan_id"]).withColumn("coverage_percentage", F.round("coverage_percentage", 6))


@query("a12_a13_owasp_counts", with_findings(f"""SELECT scan_id, owasp_category, count(*) AS findings FROM (SELECT scan_id, {SQL_TYPE_OWASP} AS owasp_category FROM findings)
  WHERE owasp_category IS NOT NULL GROUP BY ALL"""))
def owasp_counts(spark, sf):
    return reports.owasp_counts(t.findings(spark, sf).withColumn("owasp_category", lookups.owasp_of_type(F.col("type"))), ["scan_id"])


@query("a13_source_counts", with_findings(f"""SELECT scan_id, source, count(*) AS findings FROM (SELECT scan_id, unnest(string_split({sql_list([",".join(s) for s in SOURCE_SETS])}[1 + position % 6], ',')) AS source FROM findings) GROUP BY ALL"""))
def source_counts(spark, sf):
    sets = F.array(*[F.array(*[F.lit(x) for x in s]) for s in SOURCE_SETS])
    rows = t.findings(spark, sf).withColumn("sources", F.element_at(sets, (F.col("position") % 6).cast("int") + 1))
    return reports.source_counts(rows, ["scan_id"])


def _project_files(spark, sf):
    """One row per code file: project, path, language and severity counts."""
    files = t.code_files(spark, sf)
    hits = scan.scan_code(files.select("file_id", "language", "text"), PORTABLE, unicode=False)
    counted = reports.severity_counts(hits, ["file_id"])
    names = ["total", *[f"{s.lower()}_count" for s in sev.SEVERITIES]]
    return files.select("file_id", "project", F.col("path").alias("file_path"), "language").join(counted, "file_id", "left").na.fill(0, names)


PROJECT_FILES = f"""hits AS (SELECT file_id, count(*) AS total, {SQL_COUNTS} FROM ({W1_SQL}) GROUP BY file_id),
  project_files AS (SELECT c.file_id, c.project, c.path AS file_path, c.language, coalesce(h.total, 0) AS total, {", ".join(f"coalesce(h.{s.lower()}_count, 0) AS {s.lower()}_count" for s in sev.SEVERITIES)}
  FROM code_files c LEFT JOIN hits h ON h.file_id = c.file_id)"""


@query("a6_project_summary", with_tables(t.CODE_FILES, PROJECT_FILES, body="""SELECT *, least(100, 25 * critical_count + 10 * high_count + 3 * medium_count + low_count) AS risk_score FROM (
  SELECT project, count(*) AS total_files, count(*) FILTER (total > 0) AS files_with_vulnerabilities, CAST(sum(total) AS BIGINT) AS total_vulnerabilities, CAST(sum(critical_count) AS BIGINT) AS critical_count,
  CAST(sum(high_count) AS BIGINT) AS high_count, CAST(sum(medium_count) AS BIGINT) AS medium_count, CAST(sum(low_count) AS BIGINT) AS low_count FROM project_files GROUP BY project)"""))
def project_summary(spark, sf):
    return reports.project_summary(_project_files(spark, sf), ["project"])


@query("a6_language_breakdown", with_tables(t.CODE_FILES, body="SELECT project, language, count(*) AS files FROM code_files GROUP BY ALL"))
def language_breakdown(spark, sf):
    return reports.language_breakdown(t.code_files(spark, sf), ["project"])


@query("l5_top_files", with_tables(t.CODE_FILES, PROJECT_FILES, body="""SELECT project, file_path, total, place FROM (SELECT project, file_path, total,
  row_number() OVER (PARTITION BY project ORDER BY total DESC, file_path) AS place FROM project_files) WHERE place <= 10"""))
def top_files(spark, sf):
    return history.top_files(_project_files(spark, sf), ["project"]).select("project", "file_path", "total", "place")


@query("l6_a36_files_by_findings", with_tables(t.CODE_FILES, PROJECT_FILES, body="""SELECT file_path, total, (SELECT count(*) FROM project_files) AS files, CAST((SELECT sum(total) FROM project_files) AS BIGINT) AS findings
  FROM project_files ORDER BY total DESC, file_path"""))
def files_by_findings(spark, sf):
    files = kept(_project_files(spark, sf).select("file_path", "total"), "files")  # read for the totals, the bounds of the sort and the sort
    totals = files.agg(F.count("*").alias("files"), F.sum("total").alias("findings"))
    return files.orderBy(F.desc("total"), "file_path").select(
        "*", totals.select("files").scalar().alias("files"), totals.select("findings").scalar().alias("findings"))


# ---------------------------------------------------------------- report exports


@query("s14_w2_sarif_rules", with_findings(f"""SELECT scan_id, position AS first_position, lower(replace(type, ' ', '_')) AS id, type AS name,
  coalesce(message, 'Potential ' || type || ' vulnerability detected') AS full_description, coalesce(suggestion, 'Review and fix ' || type || ' vulnerability') AS help_text,
  '### ' || type || chr(10) || chr(10) || '**CWE**: ' || f.cwe || chr(10) || chr(10) || '**OWASP**: ' || coalesce(c.owasp_2021, owasp, '') || chr(10) || chr(10) || '**Remediation**: ' || coalesce(suggestion, 'Review the flagged code') AS help_markdown,
  f.cwe || '|' || coalesce(c.owasp_2021, owasp, '') AS tags, CASE severity WHEN 'CRITICAL' THEN '9.0' WHEN 'HIGH' THEN '7.0' WHEN 'LOW' THEN '1.0' WHEN 'INFO' THEN '0.0' ELSE '4.0' END AS security_severity
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, type ORDER BY position) AS n FROM findings) f LEFT JOIN {SQL_CWE} ON f.cwe = c.cwe WHERE n = 1"""))
def sarif_rules(spark, sf):
    return reports.sarif_rules(t.findings(spark, sf), ["scan_id"], "position").drop("short_description").withColumn("tags", F.array_join("tags", "|"))


@query("s14_sarif_results", with_findings("""SELECT scan_id, position, lower(replace(type, ' ', '_')) AS rule_id,
  CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'note' ELSE 'warning' END AS level,
  coalesce(message, 'Security vulnerability detected') AS text, file AS uri, line AS start_line, "column" AS start_column, CAST(confidence AS DOUBLE) AS confidence,
  cwe, coalesce(owasp, '') AS owasp, suggestion AS fix FROM findings"""))
def sarif_results(spark, sf):
    return reports.sarif_results(t.findings(spark, sf), ["scan_id"], "position")


def _read_back(spark, table, **steps):
    """(key, text) of the lines of documents that are written and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_documents(table, folder, compressed=True, **steps)
    return documents.read_lines(spark, folder, compressed=True)


@query("s14_sarif_documents", with_findings("""SELECT CAST(scan_id AS VARCHAR) AS scan_id, lower(replace(type, ' ', '_')) AS rule_id,
  CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'note' ELSE 'warning' END AS level,
  coalesce(message, 'Security vulnerability detected') AS text, file AS uri, line AS start_line, "column" AS start_column, CAST(confidence AS DOUBLE) AS confidence,
  cwe, coalesce(owasp, '') AS owasp, suggestion AS fix FROM findings"""))
def sarif_documents(spark, sf):
    """The results in the documents of all scans; scan 0 holds a third of them."""
    back = _read_back(spark, sinks.sarif_lines(t.findings(spark, sf), "scan_id", "position"))
    result = F.from_json("text", """ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<
      artifactLocation:struct<uri:string>, region:struct<startLine:int,startColumn:int>>>>, properties struct<confidence:double,cwe:string,owasp:string>,
      fixes array<struct<description:struct<text:string>>>""")
    rows = back.filter(F.col("text").startswith('{"ruleId"')).select(F.col("key").alias("scan_id"), result.alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(
        "scan_id", F.col("r.ruleId").alias("rule_id"), "r.level", "r.message.text", place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("start_line"), place["region"]["startColumn"].alias("start_column"), "r.properties.confidence",
        "r.properties.cwe", "r.properties.owasp", F.get("r.fixes", F.lit(0))["description"]["text"].alias("fix"))


@query("s15_findings_csv", with_findings(f"""SELECT CAST(line AS VARCHAR) AS "Line", f.type AS "Type", severity AS "Severity", cwe AS "CWE", coalesce(owasp, '') AS "OWASP", coalesce(message, '') AS "Message",
  coalesce(a.asvs_requirement, '') AS "ASVS Requirement", coalesce(p.pci_requirement, '') AS "PCI-DSS Requirement" FROM findings f LEFT JOIN {SQL_ASVS} ON f.type = a.type LEFT JOIN {SQL_PCI} ON f.type = p.type"""))
def findings_csv(spark, sf):
    return reports.csv_rows(t.findings(spark, sf))


@query("s16_compliance_documents", with_findings(f"""SELECT CAST(f.scan_id AS VARCHAR) AS scan_id, f.n AS total_findings, f.n AS findings,
  round_even(greatest(0.0, (22 - coalesce(r.requirements, 0)) / CAST(22 AS DOUBLE) * 100), 1) AS compliance_score,
  coalesce(r.requirements, 0) AS requirements, coalesce(r.mapped, 0) AS mapped, 2 * least(10, coalesce(a.n, 0)) AS recommendations
  FROM (SELECT scan_id, count(*) AS n FROM findings GROUP BY scan_id) f
  LEFT JOIN (SELECT scan_id, count(DISTINCT requirement) AS requirements, count(*) AS mapped FROM ({SQL_REQUIREMENTS}) GROUP BY scan_id) r ON r.scan_id = f.scan_id
  LEFT JOIN (SELECT scan_id, count(DISTINCT f.type) AS n FROM findings f JOIN {SQL_ASVS} ON a.type = f.type GROUP BY scan_id) a ON a.scan_id = f.scan_id"""))
def compliance_documents(spark, sf):
    """What the exports of all scans hold, counted from the written documents."""
    text = F.col("text")
    summary = F.from_json(F.regexp_replace(text, '^"summary":', ""), "total_findings bigint, compliance_score double")
    is_summary = text.startswith('"summary":')
    return _read_back(spark, sinks.compliance_lines(t.findings(spark, sf), "scan_id", "position"), passes=sinks.COMPLIANCE_PASSES, shares=3).groupBy(F.col("key").alias("scan_id")).agg(
        F.max(F.when(is_summary, summary["total_findings"])).alias("total_findings"), F.max(F.when(is_summary, summary["compliance_score"])).alias("compliance_score"),
        F.count_if(text.startswith('{"position"')).alias("findings"), F.count_if(text.rlike(r'^"[A-Z_]+:.*":\[$')).alias("requirements"),
        F.count_if(text.startswith('{"type"')).alias("mapped"), F.count_if(text.startswith('"Implement ')).alias("recommendations"))


@query("s17_w8_flat_report", with_findings("""SELECT file AS file_path, line AS start_line, CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' WHEN severity IN ('INFO', 'LOW') THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  CASE WHEN length(name) > 70 THEN name[1:67] || '...' ELSE name END AS title, cwe, coalesce(owasp, 'N/A') AS owasp,
  coalesce(CASE WHEN length(message) > 300 THEN message[1:300] || '...' ELSE message END, '') AS description, position,
  row_number() OVER (ORDER BY file, line, position) AS finding_num FROM (SELECT *, coalesce(string_split(message, chr(10))[1], rule_id) AS name FROM findings)"""))
def flat_report(spark, sf):
    f = t.findings(spark, sf).select("position", F.col("file").alias("file_path"), F.col("line").alias("start_line"), "severity", "message", "rule_id",
                                     F.col("cwe").alias("cwe_id"), F.col("owasp").alias("owasp_category"))
    numbered = reports.flat_report(f, ("file_path", "start_line", "position"))
    return reports.flat_rows(numbered, "position", "finding_num").drop("rule_id")


@query("w3_recommendations", with_findings(f"""SELECT scan_id, place, 'Implement ' || d || ' (ASVS ' || r || ')' AS recommendation FROM (SELECT scan_id, a.asvs_description AS d, a.asvs_requirement AS r,
  row_number() OVER (PARTITION BY scan_id ORDER BY first) AS place FROM (SELECT scan_id, type, min(position) AS first FROM findings GROUP BY ALL) f JOIN {SQL_ASVS} ON a.type = f.type) WHERE place <= 10"""))
def advice(spark, sf):
    return reports.recommendations(t.findings(spark, sf), ["scan_id"], "position")


@query("z21_truncations", """SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:100] ELSE text END AS line, text[1:200] AS snippet,
  CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS description, CASE WHEN length(text) > 70 THEN text[1:67] || '...' ELSE text END AS title FROM documents""")
def truncations(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.substring(text, 1, 100).alias("line"), F.substring(text, 1, 200).alias("snippet"),
                                               abbreviate(text, 300, 300).alias("description"), abbreviate(text, 70, 67).alias("title"))


# --------------------------------------------------------------------- history


def with_scans(body):
    return with_tables(t.SCANS, body=body)


@query("a2_history_totals", with_scans("""SELECT count(*) AS total_scans, CAST(sum(vulnerability_count) AS BIGINT) AS total_vulns, CAST(sum(critical_count) AS BIGINT) AS critical, CAST(sum(high_count) AS BIGINT) AS high,
  CAST(sum(medium_count) AS BIGINT) AS medium, CAST(sum(low_count) AS BIGINT) AS low, round(avg(scan_time_ms), 6) AS avg_scan_time FROM scans"""))
def totals(spark, sf):
    return history.history_totals(t.scans(spark, sf)).withColumn("avg_scan_time", F.round("avg_scan_time", 6))


@query("a3_counts_by_type", with_tables(t.SCAN_FINDINGS, body="SELECT vulnerability_type, count(*) AS count FROM scan_findings GROUP BY ALL"))
def counts_by_type(spark, sf):
    return history.counts_by_type(t.scan_findings(spark, sf))


@query("l4_top_types", with_tables(t.SCAN_FINDINGS, body="SELECT vulnerability_type, count(*) AS count FROM scan_findings GROUP BY ALL ORDER BY count DESC, vulnerability_type LIMIT 10"))
def top_types(spark, sf):
    return history.top_types(t.scan_findings(spark, sf))


@query("a4_by_language", with_scans("SELECT language, CAST(sum(vulnerability_count) AS BIGINT) AS count FROM scans GROUP BY language"))
def by_language(spark, sf):
    return history.findings_by_language(t.scans(spark, sf))


SQL_BUCKETS = {"hour": "strftime(ts, '%Y-%m-%d %H:00')", "day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(ts, '%Y-%W')", "month": "strftime(ts, '%Y-%m')"}


def sql_trend(span):
    days, bucket = history.RANGES[span]
    return f"""SELECT {SQL_BUCKETS[bucket]} AS date, count(*) AS total_scans, CAST(sum(vulnerability_count) AS BIGINT) AS total_vulnerabilities, CAST(sum(critical_count) AS BIGINT) AS critical_count,
      CAST(sum(high_count) AS BIGINT) AS high_count, CAST(sum(medium_count) AS BIGINT) AS medium_count, CAST(sum(low_count) AS BIGINT) AS low_count
      FROM scans WHERE ts >= (SELECT max(ts) FROM scans) - to_days({days}) GROUP BY 1"""


def _trend(spark, sf, span):
    rows = t.scans(spark, sf)
    return history.trend(rows, span, rows.agg(F.max("ts")).scalar())


def _register_trend(span):
    @query(f"a5_trend_{span}", with_scans(sql_trend(span)))
    def trend(spark, sf):
        return _trend(spark, sf, span)


for _span in history.RANGES:
    _register_trend(_span)


@query("a5_week_labels", "SELECT l_shipdate, strftime(l_shipdate, '%Y-%W') AS week, count(*) AS n FROM lineitem GROUP BY ALL")
def week_labels(spark, sf):
    ts = F.col("l_shipdate").cast("timestamp")
    return read(spark, sf, "lineitem").groupBy(ts.alias("l_shipdate")).agg(F.count("*").alias("n")).withColumn("week", history.week_label(F.col("l_shipdate")))


@query("w4_half_over_half", with_scans(f"""SELECT previous, current, round_even(c, 1) AS week_change_percent, CASE WHEN c > 0 THEN 'up' WHEN c < 0 THEN 'down' ELSE 'stable' END AS trend_direction FROM (
  SELECT previous, current, (current - previous) / CAST(greatest(previous, 1) AS DOUBLE) * 100 AS c FROM (SELECT CAST(sum(v) FILTER (n <= m // 2) AS BIGINT) AS previous, CAST(sum(v) FILTER (n > m // 2) AS BIGINT) AS current
  FROM (SELECT total_vulnerabilities AS v, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS m FROM ({sql_trend('week')}))))"""))
def half_over_half(spark, sf):
    return history.half_over_half(_trend(spark, sf, "week"))


@query("l2_recent_scans", with_scans("SELECT scan_id, ts, filename, language, vulnerability_count FROM scans ORDER BY ts DESC, scan_id DESC LIMIT 50"))
def recent(spark, sf):
    return history.recent_scans(t.scans(spark, sf)).select("scan_id", "ts", "filename", "language", "vulnerability_count")


@query("l3_p20_file_history", with_scans("SELECT scan_id, ts, filename, vulnerability_count FROM scans WHERE filename = 'f11.py' ORDER BY ts DESC, scan_id DESC LIMIT 100"))
def file_history(spark, sf):
    return history.file_history(t.scans(spark, sf), "f11.py").select("scan_id", "ts", "filename", "vulnerability_count")


@query("p20_scan_by_id", with_scans("SELECT scan_id, filename, language, vulnerability_count FROM scans WHERE scan_id = 77"))
def scan_by_id(spark, sf):
    return history.scan_by_id(t.scans(spark, sf), 77).select("scan_id", "filename", "language", "vulnerability_count")


@query("s11_scan_records", with_tables(t.SCANS, t.SCAN_FINDINGS, body="""SELECT s.scan_id, s.filename, s.language, s.code_size, count(f.scan_id) AS vulnerability_count,
  count(*) FILTER (f.scan_id IS NOT NULL AND lower(coalesce(severity, 'low')) = 'critical') AS critical_count, count(*) FILTER (f.scan_id IS NOT NULL AND lower(coalesce(severity, 'low')) = 'high') AS high_count,
  count(*) FILTER (f.scan_id IS NOT NULL AND lower(coalesce(severity, 'low')) = 'medium') AS medium_count, count(*) FILTER (f.scan_id IS NOT NULL AND lower(coalesce(severity, 'low')) = 'low') AS low_count
  FROM scans s LEFT JOIN scan_findings f ON f.scan_id = s.scan_id GROUP BY ALL"""))
def scan_records(spark, sf):
    return history.scan_record(t.scan_findings(spark, sf), t.scans(spark, sf).select("scan_id", "filename", "language", "code_size"))


@query("project_records", with_scans("""SELECT project_name, min(ts) AS created_at, max(ts) AS last_scan_at, count(*) AS total_scans, arg_max(vulnerability_count, (ts, scan_id)) AS current_vuln_count FROM scans GROUP BY 1"""))
def project_records(spark, sf):
    return history.project_records(t.scans(spark, sf))


@query("x11_retention", with_tables(t.SCANS, t.SCAN_FINDINGS, body="""SELECT f.scan_id, f.line_number, f.vulnerability_type FROM scan_findings f
  WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.scan_id = f.scan_id AND s.ts < (SELECT max(ts) FROM scans) - to_days(90))"""))
def retention(spark, sf):
    rows = t.scans(spark, sf)
    cutoff = rows.agg(F.max("ts")).scalar() - F.expr("interval 90 days")
    return lookups.drop_expired(rows, t.scan_findings(spark, sf), cutoff)[1].select("scan_id", "line_number", "vulnerability_type")


@query("t7_scan_progress", with_tables(t.PROGRESS, body="""SELECT scan_id, status, files_scanned, total_files, round_even(files_scanned / CAST(greatest(total_files, 1) AS DOUBLE) * 100, 1) AS percentage
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, seq DESC) AS n FROM progress) WHERE n = 1"""))
def scan_progress(spark, sf):
    return history.scan_progress(t.progress(spark, sf))


@query("a16_feedback_stats", with_tables(t.FEEDBACK, body="""SELECT coalesce(cwe_id, 'UNKNOWN') AS cwe_id, count(*) AS total_feedback, count(*) FILTER (feedback_type = 'confirmed') AS confirmed_count,
  count(*) FILTER (feedback_type <> 'confirmed') AS false_positive_count FROM feedback GROUP BY 1"""))
def feedback_stats(spark, sf):
    return history.feedback_stats(t.feedback(spark, sf))


@query("s12_feedback_labels", with_tables(t.FEEDBACK, body="SELECT feedback_id, CASE WHEN feedback_type = 'confirmed' THEN 1 ELSE 0 END AS label, 'fb_' || strftime(ts, '%Y%m%d%H%M%S') AS name FROM feedback"))
def feedback_labels(spark, sf):
    return t.feedback(spark, sf).select("feedback_id", history.feedback_label(F.col("feedback_type")).alias("label"), sinks.identifiers("fb", F.col("ts")).alias("name"))


# ----------------------------------------------------------------- dependencies

SQL_VERSION = r"list_transform(list_filter(regexp_split_to_array(regexp_replace({v}, '^[~^>=<]+', ''), '[.a-zA-Z]+'), lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: CAST(x AS BIGINT))"
SQL_ADVISORIES = sql_values(dim.ADVISORIES, "a(package, affected, cve_id, severity, description)")


def sql_version(v):
    return SQL_VERSION.replace("{v}", v)


@query("z1_versions", with_tables(t.DEPENDENCIES, body=f"SELECT DISTINCT version, array_to_string({sql_version('version')}, '.') AS numbers FROM dependencies"))
def version_numbers(spark, sf):
    return t.dependencies(spark, sf).select("version").distinct().select("version", F.array_join(versions.parse_version(F.col("version")).cast("array<string>"), ".").alias("numbers"))


RANGES = ["<2.5", "<=2.5.1", ">=1.0,<3", ">2.20.3", "2.3.1", ">=2,<=3.7"]


@query("z2_version_ranges", with_tables(t.DEPENDENCIES, body="SELECT version, " + ", ".join(
    "(" + " AND ".join(f"{sql_version('version')} {op} {list(num)}" for op, num in bounds) + f") AS r{i}" for i, bounds in enumerate([
        [("<", (2, 5))], [("<=", (2, 5, 1))], [(">=", (1, 0)), ("<", (3,))], [(">", (2, 20, 3))], [("=", (2, 3, 1))], [(">=", (2,)), ("<=", (3, 7))]])) + " FROM (SELECT DISTINCT version FROM dependencies)"))
def version_ranges(spark, sf):
    rows = t.dependencies(spark, sf).select("version").distinct()
    return rows.select("version", *[versions.in_range(versions.parse_version(F.col("version")), F.lit(r)).alias(f"r{i}") for i, r in enumerate(RANGES)])


SQL_HITS = f"""SELECT d.project, d.name, d.version, a.cve_id, a.severity, replace(a.affected, '<', '') AS fixed_version FROM dependencies d JOIN {SQL_ADVISORIES} ON lower(d.name) = a.package
  WHERE {sql_version('d.version')} < {sql_version('a.affected')}"""


@query("x8_advisory_hits", with_tables(t.DEPENDENCIES, body=SQL_HITS))
def advisory_hits(spark, sf):
    return lookups.match_advisories(t.dependencies(spark, sf)).select("project", "name", "version", "cve_id", "severity", "fixed_version")


# Ranges that grow with the parts; every third is about one package. Low and high limits, and what meets "*" and "latest", are among them.
RANGES_SQL = f"""ranges AS (SELECT 'CVE-' || CAST(p_partkey AS VARCHAR) AS cve_id, CASE WHEN p_partkey % 3 = 0 THEN {q(t.PACKAGES[0])} ELSE {t.sql_pick(t.PACKAGES, 'p_partkey')} END AS package,
  [CAST(p_partkey % 5 AS BIGINT), p_partkey % 37] AS low, [CAST(p_partkey % 5 AS BIGINT), p_partkey % 37 + 1, 3] AS high, p_partkey % 4 AS kind FROM part)"""


@query("x8_advisory_ranges", f"""WITH {t.DEPENDENCIES}, {RANGES_SQL},
  versions AS (SELECT DISTINCT lower(name) AS name, version, {SQL_VERSION.replace("{v}", "version")} AS v FROM dependencies)
  SELECT name, version, count(*) AS hits, min(cve_id) AS first_cve FROM versions JOIN ranges ON name = package AND
  CASE kind WHEN 0 THEN v < low WHEN 1 THEN v >= low AND v < high WHEN 2 THEN v > low AND v <= high ELSE v = high END GROUP BY name, version""")
def advisory_ranges(spark, sf):
    """Hits of many ranges of one package, without comparing each of them with each dependency."""
    k = F.col("p_partkey")
    low = F.concat_ws(".", (k % 5).cast("string"), (k % 37).cast("string"))
    high = F.concat_ws(".", (k % 5).cast("string"), (k % 37 + 1).cast("string"), F.lit("3"))
    affected = F.when(k % 4 == 0, F.concat(F.lit("<"), low)).when(k % 4 == 1, F.concat(F.lit(">="), low, F.lit(",<"), high)).when(
        k % 4 == 2, F.concat(F.lit(">"), low, F.lit(",<="), high)).otherwise(F.concat(F.lit("="), high))
    package = F.when(k % 3 == 0, t.PACKAGES[0]).otherwise(t.pick(t.PACKAGES, k))
    ranges = read(spark, sf, "part").select(F.concat(F.lit("CVE-"), k.cast("string")).alias("cve_id"), package.alias("package"), affected.alias("affected"))
    names = t.dependencies(spark, sf).select(F.lower("name").alias("name"), "version").distinct()
    ranges = ranges.groupBy("package", "affected").agg(F.count("*").alias("n"), F.min("cve_id").alias("first"))  # equal ranges are met once
    return lookups.match_advisory_ranges(names, ranges).groupBy("name", "version").agg(F.sum("n").alias("hits"), F.min("first").alias("first_cve"))


@query("a9_a14_audit_summary", with_tables(t.DEPENDENCIES, body=f"""SELECT t.project, t.n AS total_dependencies, coalesce(h.p, 0) AS vulnerable_count, coalesce(h.n, 0) AS vulnerabilities, coalesce(h.risk, 0) AS risk_score
  FROM (SELECT project, count(*) AS n FROM dependencies GROUP BY 1) t LEFT JOIN (SELECT project, count(DISTINCT name) AS p, count(*) AS n,
  CAST(least(100, sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 1 ELSE 0 END)) AS BIGINT) AS risk FROM ({SQL_HITS}) GROUP BY 1) h ON h.project = t.project"""))
def audit_summary(spark, sf):
    rows = t.dependencies(spark, sf)
    return deps.audit_summary(rows, lookups.match_advisories(rows), ["project"])


@query("a15_advisory_stats", with_tables(t.DEPENDENCIES, body=f"""SELECT count(DISTINCT package) AS total_packages_tracked, count(*) AS total_vulnerabilities, {", ".join(f"count(*) FILTER (severity = {q(s)}) AS {s.lower()}" for s in reports.DEPENDENCY_WEIGHTS)}
  FROM {SQL_ADVISORIES} WHERE package IN (SELECT name FROM dependencies)"""))
def advisory_stats(spark, sf):
    """Statistics of the advisories whose package is in use."""
    used = t.dependencies(spark, sf).select(F.col("name").alias("package")).distinct()
    return deps.advisory_stats(dim.advisory_table(spark).join(used, "package", "left_semi"))


@query("z3_requirement_lines", with_tables(t.REQUIREMENT_FILES, body=f"""SELECT file_id, line_no, lower(CASE WHEN pinned THEN regexp_extract(s, {q(versions.PINNED)}, 1) ELSE s END) AS name,
  CASE WHEN pinned THEN regexp_extract(s, {q(versions.PINNED)}, 3) ELSE '*' END AS version FROM (SELECT *, regexp_matches(s, {q(versions.PINNED)}) AS pinned FROM (SELECT file_id, line_no, trim(line) AS s
  FROM {t.sql_lines('requirement_files', 'file_id')})) WHERE s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, '-') AND (pinned OR regexp_matches(s, {q(versions.BARE)}))"""))
def requirement_lines(spark, sf):
    return deps.parse_requirements(t.requirement_files(spark, sf))


@query("z4_package_manifests", with_tables(t.DEPENDENCIES, body="""SELECT project, name, regexp_replace(CASE WHEN length(name) % 2 = 0 THEN max(version) ELSE min(version) END, '^[~^>=<]+', '') AS version
  FROM dependencies GROUP BY project, name"""))
def package_manifests(spark, sf):
    """Entries of manifests built from the dependencies of each project."""
    d = t.dependencies(spark, sf).select("project", "name", "version").distinct()
    one = d.groupBy("project", "name").agg(F.min("version").alias("version"), F.max("version").alias("dev"))
    maps = one.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("name", "version"))).alias("dependencies"),
                                      F.map_from_entries(F.collect_list(F.struct("name", "dev"))).alias("devDependencies"))
    files = maps.select("project", F.to_json(F.struct("dependencies", F.map_filter("devDependencies", lambda k, v: F.length(k) % 2 == 0).alias("devDependencies"))).alias("text"))
    return deps.parse_packages(files)


@query("z5_license_classes", with_tables(t.DEPENDENCIES, body="SELECT project, license, CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(upper(license), {q(x.upper())})" for x in names) + f" THEN {q(c)}" for c, names in dim.LICENSE_CLASSES.items()) + " ELSE 'unknown' END AS license_type, count(*) AS n FROM dependencies GROUP BY ALL"))
def license_classes(spark, sf):
    return t.dependencies(spark, sf).groupBy("project", "license").agg(F.count("*").alias("n")).withColumn("license_type", versions.license_class(F.col("license")))


@query("z6_package_urls", with_tables(t.DEPENDENCIES, body="SELECT DISTINCT name, version, 'pkg:pypi/' || name || '@' || version AS python_url, 'pkg:npm/' || name || '@' || version AS node_url FROM dependencies"))
def package_urls(spark, sf):
    n, v = F.col("name"), F.col("version")
    return t.dependencies(spark, sf).select("name", "version").distinct().select("name", "version", versions.package_url(n, v).alias("python_url"), versions.package_url(n, v, "node").alias("node_url"))


@query("s19_bill_of_materials", with_tables(t.DEPENDENCIES, body="""SELECT DISTINCT CAST(project AS VARCHAR) AS project, 'library' AS type, name, version,
  'pkg:pypi/' || name || '@' || version AS purl, CASE WHEN license <> '' THEN [license] ELSE [] END AS licenses FROM dependencies"""))
def bill_of_materials(spark, sf):
    """The components in the written bills of all projects; project 0 holds a third of them."""
    d = t.dependencies(spark, sf).distinct()
    back = _read_back(spark, sinks.sbom_lines(deps.components(d), "project", "2024-01-01T00:00:00Z"))
    row = F.from_json("text", "type string, name string, version string, purl string, licenses array<string>")
    return back.filter(F.col("text").startswith('{"type"')).select(F.col("key").alias("project"), row.alias("r")).select("project", "r.*")


# ----------------------------------------------------------------- request limits


@query("w11_t2_request_rates", with_tables(t.REQUESTS, body="""SELECT request_id, client, path, count(*) OVER (PARTITION BY client, path ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS requests FROM requests"""))
def request_rates(spark, sf):
    return admission.requests_in_window(t.requests(spark, sf), ["client", "path"], 60).select("request_id", "client", "path", "requests")


@query("t2_sliding_rates", with_tables(t.REQUESTS, body="""SELECT window_start, client, count(*) AS requests, count(*) > 10 AS over_limit FROM (SELECT client, unnest(generate_series(
  time_bucket(INTERVAL 10 SECONDS, ts) - INTERVAL 50 SECONDS, time_bucket(INTERVAL 10 SECONDS, ts), INTERVAL 10 SECONDS)) AS window_start FROM requests) GROUP BY ALL"""))
def sliding_rates(spark, sf):
    from vulnlake.streaming.jobs import request_rates as rates
    return rates(t.requests(spark, sf), ["client"], 10)


# The serial fold over each key, row after row; the accepted times of the last minute are the state.
ADMISSION_SQL = f"""WITH RECURSIVE {t.REQUESTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY client, path ORDER BY ts, request_id) AS n, epoch_us(ts) / 1e6 AS s FROM requests),
run AS (SELECT request_id, client, path, ts, n, [s] AS accepted, true AS allowed, 9 AS remaining, 0 AS retry_after FROM numbered WHERE n = 1
  UNION ALL SELECT request_id, client, path, ts, n, CASE WHEN len(live) < 10 THEN list_append(live, s) ELSE live END, len(live) < 10,
    CASE WHEN len(live) < 10 THEN 9 - len(live) ELSE 0 END, CASE WHEN len(live) < 10 THEN 0 ELSE greatest(1, trunc(live[1] + 60 - s)) END
  FROM (SELECT x.*, list_filter(r.accepted, lambda a: a > x.s - 60) AS live FROM run r JOIN numbered x ON x.client = r.client AND x.path = r.path AND x.n = r.n + 1))
SELECT request_id, ts, client, path, allowed, CAST(remaining AS INTEGER) AS remaining, CAST(retry_after AS INTEGER) AS retry_after FROM run"""


@query("w11_t3_admission", ADMISSION_SQL)
def exact_admission(spark, sf):
    return admission.decide(t.requests(spark, sf), ["client", "path"], 10, 60, "request_id")


@query("z25_rate_limits", with_tables(t.REQUESTS, body="""SELECT request_id, CASE WHEN starts_with(path, '/api/v1/ml-scan') THEN 10 WHEN starts_with(path, '/api/v1/scan') THEN 10 WHEN starts_with(path, '/api/v1/feedback') THEN 30
  WHEN starts_with(path, '/api/v1/health') THEN 60 ELSE 30 END AS max_requests, 60 AS window_seconds, CASE WHEN request_id % 4 = 0 THEN '10.1.' || CAST(client AS VARCHAR) WHEN request_id % 4 = 1 THEN 'real' WHEN request_id % 4 = 2 THEN 'host' ELSE 'unknown' END AS key FROM requests"""))
def rate_limits(spark, sf):
    n, s = admission.rate_limit(F.col("path"))
    i = F.col("request_id") % 4
    forwarded = F.when(i == 0, F.concat(F.lit(" 10.1."), F.col("client").cast("string"), F.lit(" , 10.9.9.9")))
    return t.requests(spark, sf).select("request_id", n.alias("max_requests"), s.alias("window_seconds"),
                                        admission.client_key(forwarded, F.when(i == 1, "real"), F.when(i == 2, "host")).alias("key"))


# ------------------------------------------------------- reports of other tools

@query("s7_bandit_reports", with_findings("""SELECT position, 'bandit' AS tool, test_id AS rule_id, CASE WHEN severity IN ('HIGH', 'LOW') THEN severity ELSE 'MEDIUM' END AS severity,
  coalesce(message, '') AS message, coalesce(CASE WHEN line % 10 > 0 THEN line END, 1) AS start_line, coalesce(CASE WHEN line % 10 > 0 THEN line END, 1) AS end_line,
  coalesce(suggestion, '') AS code_snippet, cwe AS cwe_id FROM findings WHERE position % 17 > 0"""))
def bandit_reports(spark, sf):
    """Reports written as JSON and read back; every 17th is broken and gives no finding."""
    f = t.findings(spark, sf)
    result = F.struct(F.col("test_id"), F.col("severity").alias("issue_severity"), F.col("message").alias("issue_text"), F.when(F.col("line") % 10 > 0, F.col("line")).alias("line_number"),
                      F.concat(F.lit("  "), "suggestion", F.lit("\n")).alias("code"), F.struct(F.col("cwe").alias("id")).alias("cwe"))
    report = F.to_json(F.struct(F.array(result).alias("results")))
    return tool_reports.parse_bandit(f.select("position", F.when(F.col("position") % 17 > 0, report).otherwise("not json").alias("report")))


@query("s8_semgrep_reports", with_findings("""SELECT position, 'semgrep' AS tool, rule_id, CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'LOW' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  coalesce(message, '') AS message, line AS start_line, coalesce(CASE WHEN line % 10 > 0 THEN line + 1 END, 1) AS end_line, coalesce(suggestion, '') AS code_snippet,
  CASE WHEN position % 3 > 0 THEN cwe END AS cwe_id FROM findings"""))
def semgrep_reports(spark, sf):
    f = t.findings(spark, sf)
    level = F.when(F.col("severity") == "CRITICAL", "error").when(F.col("severity") == "LOW", "info").when(F.col("severity") == "HIGH", "other")
    cwes = F.when(F.col("position") % 3 > 0, F.array(F.col("cwe"), F.lit("CWE-0"))).otherwise(F.array().cast("array<string>"))
    extra = F.struct(level.alias("severity"), F.col("message"), F.col("suggestion").alias("lines"), F.struct(cwes.alias("cwe")).alias("metadata"))
    end = F.struct(F.when(F.col("line") % 10 > 0, F.col("line") + 1).alias("line"))
    result = F.struct(F.col("rule_id").alias("check_id"), F.struct("line").alias("start"), end.alias("end"), extra.alias("extra"))
    return tool_reports.parse_semgrep(f.select("position", F.to_json(F.struct(F.array(result).alias("results"))).alias("report")))
