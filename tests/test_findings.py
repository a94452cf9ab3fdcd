"""Merge, confidence and reports, against brute force where the order matters."""

import random

from pyspark.sql import functions as F

from vulnlake.operators import findings as fnd
from vulnlake.operators import history, lookups, reports

SCHEMA = ("file_id int, tool_no int, position bigint, line int, vulnerability_type string, severity string, confidence double, "
          "sources array<string>, code_snippet string, explanation string, semgrep_rule string, bandit_test string, "
          "ml_probability double, cwe_id string, owasp_category string")
TOOLS = ("semgrep", "bandit", "ml")
RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def finding(file, tool, position, line, severity="LOW", confidence=0.5):
    return (file, tool, position, line, f"t{position}", severity, confidence, [TOOLS[tool]], "", "",
            f"r{position}" if tool == 0 else None, f"b{position}" if tool == 1 else None, confidence if tool == 2 else None, None, None)


def brute_merge(rows):
    """Findings in arrival order, each joined to the first anchor within two lines."""
    anchors = []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        near = next((a for a in anchors if abs(a["line"] - r[3]) <= 2), None)
        if near is None:
            near = {"line": r[3], "type": r[4], "sources": set(), "rank": 9, "confidence": 0.0, "rule": None, "test": None, "p": None}
            anchors.append(near)
        near["sources"] |= set(r[7])
        near["rank"] = min(near["rank"], RANK[r[5]])
        near["confidence"] = max(near["confidence"], r[6])
        near["rule"], near["test"], near["p"] = r[10] or near["rule"], r[11] or near["test"], r[12] or near["p"]
    return {(a["line"], a["type"], tuple(sorted(a["sources"])), a["rank"], a["confidence"], a["rule"], a["test"], a["p"]) for a in anchors}


def test_near_line_merge_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [finding(f, rng.randrange(3), p, rng.randrange(1, 25 + 20 * f), rng.choice(list(RANK)), round(rng.random(), 3) + 0.001)
            for f in range(5) for p in range(30)]
    merged = fnd.merge_near_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    for f in range(5):
        got = {(r.line, r.vulnerability_type, tuple(r.sources), RANK[r.severity], r.confidence, r.semgrep_rule, r.bandit_test, r.ml_probability)
               for r in merged if r.file_id == f}
        assert got == brute_merge([r for r in rows if r[0] == f])


def test_anchors_do_not_move(spark):
    rows = [finding(1, 0, i, line) for i, line in enumerate((10, 12, 14))]
    assert sorted(r.line for r in fnd.merge_near_lines(spark.createDataFrame(rows, SCHEMA)).collect()) == [10, 14]


def test_later_arrival_lower_line(spark):
    rows = [finding(1, 0, 0, 10), finding(1, 0, 1, 13), finding(1, 1, 0, 12)]
    got = {r.line: tuple(r.sources) for r in fnd.merge_near_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {10: ("bandit", "semgrep"), 13: ("semgrep",)}


def test_agreement_of_three_sources(spark):
    rows = [finding(1, 0, 0, 1, confidence=0.85), finding(1, 1, 0, 1, confidence=0.5), finding(1, 2, 0, 1, confidence=0.89)]
    row = fnd.combine_tools(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert row.confidence == 1.0 and sorted(row.sources) == ["bandit", "hybrid", "ml", "semgrep"]


def test_conversions_of_tools(spark):
    text = "a\nb\nc\nd"
    sem = spark.createDataFrame([(1, 0, "x.y.sql-injection", 2, "ERROR", "m", "CWE-89", text)],
                                "file_id int, position int, check_id string, line int, severity string, message string, cwe_id string, text string")
    ban = spark.createDataFrame([(1, 0, "B301", "pickle", 4, "odd", "HIGH", "m", None, text)],
                                "file_id int, position int, test_id string, test_name string, line int, severity string, confidence string, message string, cwe_id string, text string")
    ml = spark.createDataFrame([(1, 0, True, 0.915, 0.7, "import os"), (2, 0, True, 0.915, 0.7, "import os; eval(x)")],
                               "file_id int, position int, vulnerable boolean, confidence double, probability double, text string")
    s, b = fnd.unify_semgrep(sem).collect()[0], fnd.unify_bandit(ban).collect()[0]
    assert (s.vulnerability_type, s.severity, s.confidence, s.code_snippet, s.owasp_category) == ("Sql Injection", "HIGH", 0.85, "a\nb\nc", "A03-Injection")
    assert (b.severity, b.confidence, b.code_snippet, b.owasp_category) == ("MEDIUM", 0.9, "c\nd", "A08-SoftwareDataIntegrityFailures")
    models = fnd.unify_model(ml).collect()
    assert [(m.file_id, m.severity, m.line) for m in models] == [(2, "HIGH", 1)]
    assert models[0].explanation.endswith("92% confidence")


def counts(spark, c=0, h=0, m=0, low=0, i=0):
    return spark.createDataFrame([(c, h, m, low, i)], "critical_count int, high_count int, medium_count int, low_count int, info_count int")


def test_risk_scores(spark):
    row = counts(spark, 1, 2, 3, 4).select(reports.project_risk().alias("p"), reports.dependency_risk().alias("d"), reports.report_risk().alias("r")).collect()[0]
    assert tuple(row) == (58, 74, 89)


def test_grade(spark):
    row = reports.compliance_score(counts(spark, 0, 1, 1, 1)).collect()[0]
    assert (row.score, row.grade, row.high_deduction) == (79, "C", 15)


def test_framework_total_is_a_sum(spark):
    """22 listed types in both frameworks together; one type violates one requirement in each."""
    f = spark.createDataFrame([("s", "XSS"), ("s", "XSS")], "scan_id string, type string")
    row = reports.framework_compliance(f, ["scan_id"]).collect()[0]
    assert (row.violations, row.compliance_score) == (2, 90.9)


def test_coverage(spark):
    f = spark.createDataFrame([("s", "A03"), ("s", "A03"), ("s", "A02"), ("s", None)], "scan_id string, owasp_category string")
    row = reports.owasp_coverage(f, ["scan_id"]).collect()[0]
    assert (row.covered_categories, row.coverage_percentage) == (2, 20.0)


def test_merge_keeps_base_and_adds_new_keys_once(spark):
    base = spark.createDataFrame([("a", 1, None, 0), ("a", 1, None, 1)], "file_path string, start_line int, cwe_id string, rule_no int")
    extra = spark.createDataFrame([("a", 1, None, 5), ("a", 2, "C", 7), ("a", 2, "C", 6)], "file_path string, start_line int, cwe_id string, rule_no int")
    got = lookups.merge_findings(base, extra).select("start_line", "rule_no").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (2, 6)]


def test_half_over_half(spark):
    t = spark.createDataFrame([("a", 10), ("b", 10), ("c", 20), ("d", 5), ("e", 5)], "date string, total_vulnerabilities int")
    assert tuple(history.half_over_half(t).collect()[0]) == (20, 30, 50.0, "up")
    assert history.half_over_half(t.limit(1)).collect()[0].trend_direction == "stable"


def test_lookup_order(spark):
    f = spark.createDataFrame([("weak-hash-injection", "SQL_INJ auth"), ("x.auth", "AUTHORIZATION"), ("insufficient-logging", "plain")], "r string, t string")
    got = [tuple(x) for x in f.select(lookups.owasp_of_rule_id(F.col("r")), lookups.owasp_of_type(F.col("t"))).collect()]
    assert got == [("A02-CryptographicFailures", "A03-Injection"), ("A07-IdentificationAuthenticationFailures", "A01-BrokenAccessControl"),
                   ("A09-SecurityLoggingMonitoringFailures", None)]


def test_unified_responses(spark):
    body = '{"code_language": "python", "findings": [{"sources": ["a", "b"], "vulnerability_type": "X", "line": null}]}'
    other = '{"results": [{"file_path": "f", "language": "go", "findings": [{"tool": "t", "rule_id": "r", "start_line": 3, "end_line": 4}]}]}'
    rows = fnd.unify_responses(spark.createDataFrame([(1, body), (2, other)], "id int, body string")).orderBy("id").collect()
    assert (rows[0].tool, rows[0].rule_id, rows[0].severity, rows[0].start_line, rows[0].language) == ("a,b", "X", "MEDIUM", 1, "python")
    assert (rows[1].tool, rows[1].start_line, rows[1].end_line, rows[1].severity) == ("t", 3, 4, "MEDIUM")


def test_keys_beyond_53_bits_are_divided_exactly(spark):
    from vulnlake.plans.tables import whole_quotient

    numbers = [12467830118003999, 10241063096124999, 576000000019999999, 15999999999999999]
    frame = spark.createDataFrame([(n,) for n in numbers], "position long")
    got = frame.select("position", *[whole_quotient(F.col("position"), by).alias(f"by{by}") for by in (1000, 1_000_000_000, 16_000_000_000_000)]).collect()
    assert [tuple(r) for r in got] == [(n, n // 1000, n // 1_000_000_000, n // 16_000_000_000_000) for n in numbers]


def test_thousands_of_large_positions_keep_their_parity(spark, tmp_path):
    """Both rows have one key and odd thousands, so none is a base finding and only the earlier one is added."""
    from vulnlake.plans import catalog

    rows = [(779239, 118003, 999, 6), (779239, 118023, 999, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.position for r in catalog.QUERIES["x9_merge_tools"](spark, str(tmp_path)).collect()] == [12467830118003999]


def test_responses_hold_the_findings_of_their_whole_number(spark, tmp_path):
    """Position 576000000999999999 is of response 576000000, whose double quotient would be 576000001."""
    from vulnlake.plans import catalog

    rows = [(36000000, 999999, 999, 0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r.response_id, r.tool) for r in catalog.QUERIES["p21_unified_responses"](spark, str(tmp_path)).collect()] == [(576000000, "bandit,semgrep")]


def test_files_are_scanned_once_for_their_order_and_totals(spark):
    from vulnlake.plans import catalog

    plan = catalog.QUERIES["l6_a36_files_by_findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "files-" in plan and "lineitem" not in plan
