"""Readers and writers on small files."""

import gzip
import json
import zipfile

from pyspark.sql import functions as F

from vulnlake.operators import corpus, history
from vulnlake.sources import corpora, documents, files, sinks, tool_reports

GOOD = "def f(x):\n    return x + 1\nprint(f(2))"


def test_source_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "deep").mkdir(parents=True)
    for name, body in {"src/a.py": "x", "src/deep/b.TS": "y", "node_modules/c.js": "z", "src/d.txt": "n", "src/big.py": "b" * 50, "e.go": "é"}.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    got = files.read_tree(spark, str(tmp_path), max_bytes=20).collect()
    assert sorted((r.path, r.language, r.text) for r in got) == [("e.go", "go", "é"), ("src/a.py", "python", "x"), ("src/deep/b.TS", "typescript", "y")]
    assert [r.path for r in files.read_tree(spark, str(tmp_path), max_bytes=20, max_files=1).collect()] == ["e.go"]
    assert files.read_tree(spark, str(tmp_path), max_files=None).count() == 4


def test_archives(spark, tmp_path):
    def zipped(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, body in members.items():
                z.writestr(member, body)

    zipped("ok.zip", {"a/x.py": "eval(x)", "build/y.py": "no", "z.bin": "b"})
    zipped("slip.zip", {"../evil.py": "x", "fine.py": "y"})
    zipped("many.zip", {f"f{i}.py": "x" for i in range(6)})
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    members = files.read_archives(spark, str(tmp_path), max_files=5)
    status = {(r.archive.split("/")[-1], r.status) for r in members.collect()}
    assert status == {("ok.zip", "ok"), ("slip.zip", "path outside archive"), ("many.zip", "too many files"), ("broken.zip", "invalid archive")}
    assert [(r.path, r.text) for r in files.files_of_archives(members).collect()] == [("a/x.py", "eval(x)")]
    tiny = files.read_archives(spark, str(tmp_path), max_bytes=20)
    assert {r.status for r in tiny.collect()} == {"archive too large", "invalid archive"}


def test_json_corpus_in_three_shapes(spark, tmp_path):
    sample = {"code": "a", "label": 1, "language": "python", "metadata": {"k": "v"}}
    (tmp_path / "list.json").write_text(json.dumps([sample, {**sample, "code": "b", "label": "0"}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"version": 2, "samples": [{"code": "c", "vulnerabilities": [{"cwe_id": "CWE-1", "confidence": 0.5}]}]}))
    (tmp_path / "data.json").write_text(json.dumps({"data": [{"code": "d", "vuln_type": "none"}]}))
    (tmp_path / "single.json").write_text(json.dumps({"code": "e", "vulnerable": True}, indent=1))
    (tmp_path / "empty.json").write_text("")
    got = corpora.with_label(corpora.read_json_corpus(spark, str(tmp_path))).select("code", "label").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 0), ("c", 1), ("d", 0), ("e", 1)]


def test_jsonl_with_bad_lines(spark, tmp_path):
    lines = [json.dumps({"func": GOOD, "target": 1, "project": "p"}), "{broken", json.dumps({"func": "import os\nimport re\nimport sys", "target": 0})]
    (tmp_path / "train.jsonl").write_text("\n".join(lines))
    good, bad = corpora.read_jsonl(spark, str(tmp_path / "train.jsonl"))
    row = good.collect()
    assert [(r.label, r.language, r.vulnerability_type, r.metadata["project"]) for r in row] == [(1, "python", "defect", "p")]
    assert bad.count() == 1


def test_function_csv(spark, tmp_path):
    body = 'code,target,cwe_id,project\n"def f(a):\n  return ""x"" + a  # padding padding padding padding",1,22,p\nshort,1,22,p\n' + "z" * 60 + ",0,,q\n"
    (tmp_path / "big.csv").write_text(body)
    rows = corpora.read_function_csv(spark, str(tmp_path / "big.csv")).collect()
    assert [(r.language, r.cwe_id, r.owasp_category, r.is_vulnerable) for r in rows] == [("python", 22, "A01", True)]
    assert '"x"' in rows[0].code


def test_xml_manifest(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("eval(x)")
    (tmp_path / "src" / "b.js").write_text("y")
    cases = [("src/a.py", "CWE-89", "<bad>true</bad>"), ("src/b.js", "79", ""), ("src/b.js", "798", "<bad>true</bad>"), ("src/none.py", "89", ""), ("src/c.txt", "89", "")]
    xml = "".join(f"<testcase><file>{f}</file><cwe>{c}</cwe>{b}</testcase>" for f, c, b in cases)
    (tmp_path / "manifest.xml").write_text(f"<testcases>{xml}</testcases>")
    got = corpora.read_test_manifest(spark, str(tmp_path / "manifest.xml"), str(tmp_path)).collect()
    assert sorted((r.source_file, r.language, r.cwe_id, r.owasp_category, r.is_vulnerable, r.code) for r in got) == [
        ("src/a.py", "python", 89, "A03", True, "eval(x)"), ("src/b.js", "javascript", 79, "A03", False, "y")]


def test_fix_pairs(spark):
    fixes = spark.createDataFrame([("b" * 21, "a" * 30, "CWE-1", "py"), ("short", "c" * 21, None, None), (None, None, "x", "js")],
                                  "func_before string, func_after string, cwe_id string, extension string")
    got = corpus.fix_pairs(fixes, "s").select("label", "vulnerability_type", "language").collect()
    assert sorted(map(tuple, got)) == [(0, "none", "javascript"), (0, "none", "python"), (1, "CWE-1", "python")]


def test_tool_reports(spark):
    bandit = {"results": [{"test_id": "B1", "issue_severity": "LOW", "issue_text": "t", "line_number": 4, "code": " x \n", "cwe": {"id": "78"}}, {"issue_severity": "ODD"}]}
    semgrep = {"results": [{"check_id": "r", "start": {"line": 2}, "end": {"line": 3}, "extra": {"severity": "error", "message": "m", "lines": " l ", "metadata": {"cwe": ["CWE-1", "CWE-2"]}}},
                           {"check_id": "q", "extra": {"severity": "INFO", "metadata": {"cwe": []}}}]}
    frame = spark.createDataFrame([(1, json.dumps(bandit), json.dumps(semgrep)), (2, "broken", "broken")], "id int, b string, s string")
    b = tool_reports.parse_bandit(frame.select("id", "b"), "b").collect()
    s = tool_reports.parse_semgrep(frame.select("id", "s"), "s").collect()
    assert [(r.rule_id, r.severity, r.start_line, r.code_snippet, r.cwe_id) for r in b] == [("B1", "LOW", 4, "x", "78"), ("", "MEDIUM", 1, "", None)]
    assert [(r.rule_id, r.severity, r.start_line, r.end_line, r.cwe_id) for r in s] == [("r", "HIGH", 2, 3, "CWE-1"), ("q", "LOW", 1, 1, None)]


def scans(spark):
    return spark.sql("SELECT * FROM VALUES ('s1', timestamp'2024-01-01 10:00:00'), ('s2', timestamp'2024-03-01 10:00:00'), ('s3', timestamp'2024-03-02 10:00:00') AS t(scan_id, ts)")


def test_history_write_and_retention(spark, tmp_path):
    found = spark.createDataFrame([("s1", "high"), ("s1", None), ("s2", "CRITICAL")], "scan_id string, severity string")
    path, kept = str(tmp_path / "h"), str(tmp_path / "kept")
    sinks.record_scans(scans(spark), found, path)
    rows = {r.scan_id: r for r in spark.read.parquet(f"{path}/scans").collect()}
    assert (rows["s1"].vulnerability_count, rows["s1"].high_count, rows["s1"].low_count, rows["s3"].vulnerability_count) == (2, 1, 1, 0)
    sinks.remove_old_scans(spark, path, "2024-02-01", kept)
    assert sorted(r.scan_id for r in spark.read.parquet(f"{kept}/scans").collect()) == ["s2", "s3"]
    assert [r.scan_id for r in spark.read.parquet(f"{kept}/findings").collect()] == ["s2"]


def test_feedback_log(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "CWE-1", "confirmed"), ("f2", "CWE-1", "other"), ("f3", None, "confirmed")], "feedback_id string, cwe_id string, feedback_type string")
    for _ in range(2):
        sinks.append_feedback(rows, str(tmp_path / "log"))
    log = sinks.read_feedback(spark, str(tmp_path / "log"))
    assert log.count() == 6 and log.agg(F.sum("label")).first()[0] == 4
    stats = {r.cwe_id: (r.total_feedback, r.confirmed_count, r.false_positive_count) for r in history.feedback_stats(log).collect()}
    assert stats == {"CWE-1": (4, 2, 2), "UNKNOWN": (2, 2, 0)}


def test_documents(spark, tmp_path):
    f = spark.createDataFrame([("s", 1, "SQL Injection", "HIGH", "CWE-89", None, "m", None, "a.py", 3, 1, 0.5), ("s", 2, "SQL Injection", None, "", None, None, "fix it", None, None, None, None),
                               ("s", 3, "XSS", "INFO", None, "o", "n", None, "b.py", 9, 2, 0.25)],
                              "scan_id string, position int, type string, severity string, cwe string, owasp string, message string, suggestion string, file string, line int, column int, confidence double")
    doc = written_documents(sinks.sarif_lines(f, "scan_id", "position"), tmp_path / "sarif")["s"]
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["sql_injection", "xss"]
    assert run["tool"]["driver"]["rules"][0]["properties"] == {"tags": ["CWE-89", "A03:2021 - Injection"], "security-severity": "7.0"}
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note"]
    assert run["results"][1]["fixes"][0]["description"]["text"] == "fix it" and "fixes" not in run["results"][0]
    assert run["results"][1]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "unknown"}, "region": {"startLine": 1, "startColumn": 1}}
    export = written_documents(sinks.compliance_lines(f, "scan_id", "position", generated="now"), tmp_path / "compliance")["s"]
    assert list(export) == ["report_metadata", "summary", "findings", "compliance_report", "recommendations"]
    assert export["report_metadata"]["scan_id"] == "s" and export["summary"]["total_findings"] == 3
    assert export["summary"]["frameworks_checked"] == ["OWASP_ASVS", "PCI_DSS"] and 0 < export["summary"]["compliance_score"] < 100
    assert [x["position"] for x in export["findings"]] == [1, 2, 3] and export["findings"][1]["suggestion"] == "fix it"
    report = export["compliance_report"]
    assert [r.split(":")[0] for r in report["findings_by_requirement"]] == ["OWASP_ASVS", "PCI_DSS", "OWASP_ASVS"]
    assert [len(x) for x in report["findings_by_requirement"].values()] == [2, 3, 1]
    assert [x["type"] for x in list(report["findings_by_requirement"].values())[1]] == ["SQL Injection", "SQL Injection", "XSS"]
    assert report["gaps"] == [] and report["recommendations"] == export["recommendations"] and len(export["recommendations"]) == 2
    sinks.write_findings_csv(f, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["Line", "Type", "Severity", "CWE", "OWASP", "Message", "ASVS Requirement", "PCI-DSS Requirement"]
    assert back.filter("Type = 'XSS'").first()["ASVS Requirement"] == "5.3.3"
    parts = spark.createDataFrame([("p", "b", "1", "MIT"), ("p", "a", "2", "")], "project string, name string, version string, license string")
    from vulnlake.operators.dependencies import components
    bill = written_documents(sinks.sbom_lines(components(parts), "project", "now"), tmp_path / "bills")["p"]
    assert bill["bomFormat"] == "CycloneDX" and [(c["purl"], c["licenses"]) for c in bill["components"]] == [("pkg:pypi/a@2", []), ("pkg:pypi/b@1", ["MIT"])]


def written_documents(lines, path):
    """Documents by key, written and parsed whole."""
    sizes = {r.key: r.bytes for r in documents.write_documents(lines, str(path)).collect()}
    found = {}
    for key, size in sizes.items():
        text = (path / documents.file_name(key)).read_text()
        assert len(text.encode()) == size
        found[key] = json.loads(text)
    return found


def test_large_documents_are_written_by_many_tasks(spark, tmp_path):
    """One key holds nearly all rows, others few; odd keys name files too."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 50 > 0, "hot").otherwise(F.element_at(F.array(F.lit("a/b"), F.lit("é %"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))).alias("k"),
        "id", F.concat(F.lit('line\n"'), F.col("id")).alias("message"))
    item = F.to_json(F.struct("id", "message"))
    table = documents.frame_lines(rows.select("k").distinct(), "k", {0: '{"items":[', 2: "]}"}).unionByName(
        documents.lines(rows, "k", 1, item, F.col("id")))
    found = written_documents(table, tmp_path / "docs")
    assert {k: len(v["items"]) for k, v in found.items()} == {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert [x["id"] for x in found["hot"]["items"]] == [i for i in range(5000) if i % 50] and found["c"]["items"][0]["message"].startswith('line\n"')
    parts = spark.read.schema(documents.PART).json(str(tmp_path / "docs" / "_listed"))
    assert parts.filter("key = 'hot'").count() > 1
    back = documents.read_lines(spark, str(tmp_path / "docs"))
    assert back.filter("text LIKE '{\"id\"%'").count() == 5000 and {r.key for r in back.select("key").distinct().collect()} == set(found)


def test_compressed_documents_hold_the_same_and_are_read_by_members(spark, tmp_path):
    """Megabytes of lines: several gzip members in a part, read back by several tasks; no second copy stays beside the documents."""
    rows = spark.range(48000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise("é %").alias("k"), "id", F.repeat(F.lit("module "), 150).alias("message"))
    table = documents.frame_lines(rows.select("k").distinct(), "k", {0: '{"items":[', 2: "]}"}).unionByName(
        documents.lines(rows, "k", 1, F.to_json(F.struct("id", "message")), F.col("id"))).coalesce(4)
    plain = written_documents(table, tmp_path / "plain")
    sizes = {r.key: r.bytes for r in documents.write_documents(table, str(tmp_path / "packed"), compressed=True).collect()}
    assert set(sizes) == set(plain)
    for key, size in sizes.items():
        packed = (tmp_path / "packed" / documents.file_name(key, compressed=True)).read_bytes()
        assert len(packed) == size and gzip.decompress(packed) == (tmp_path / "plain" / documents.file_name(key)).read_bytes()
    members = spark.read.schema(documents.DOCUMENT).json(str(tmp_path / "packed" / "_documents")).filter("key = 'hot'").first().members
    parts = spark.read.schema(documents.PART).json(str(tmp_path / "packed" / "_listed")).filter("key = 'hot'").count()
    assert len(members) > parts > 1
    both = [documents.read_lines(spark, str(tmp_path / f), c) for f, c in (("plain", False), ("packed", True))]
    assert both[0].exceptAll(both[1]).count() == 0 and both[1].exceptAll(both[0]).count() == 0 and both[0].count() == 48004
    assert not (tmp_path / "plain" / "_parts").exists() and not (tmp_path / "packed" / "_parts").exists()


def test_split_output(spark, tmp_path):
    frame = spark.range(40).select(F.col("id").cast("string").alias("fingerprint"), (F.col("id") % 2).cast("int").alias("label"))
    sinks.write_splits(corpus.split_by_hash(frame), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "samples")).count() == 40
    assert spark.read.json(str(tmp_path / "out" / "metadata")).agg(F.sum("samples")).first()[0] == 40
    assert spark.read.json(str(tmp_path / "out" / "class_weights")).count() == 2


def compliance_findings(spark, n=4000):
    """Findings of two scans, one of which holds most."""
    i = F.col("id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("SQL Injection", "XSS", "Weak Cryptography", "AUTH bypass")]), (i % 4 + 1).cast("int"))
    return spark.range(n).repartition(4).select(
        F.when(i % 9 == 0, "b/1").otherwise("a").alias("scan_id"), i.alias("position"), kinds.alias("type"), F.lit("HIGH").alias("severity"), F.lit("CWE-89").alias("cwe"),
        F.lit(None).cast("string").alias("owasp"), F.when(i % 7 > 0, F.sha2(i.cast("string"), 512)).alias("message"), F.lit("s").alias("suggestion"), F.lit("f").alias("file"), i.cast("int").alias("line"))


def test_documents_written_in_passes_are_the_same(spark, tmp_path):
    table = sinks.compliance_lines(compliance_findings(spark), "scan_id", "position")
    whole, passes = tmp_path / "whole", tmp_path / "passes"
    documents.write_documents(table, str(whole))
    documents.write_documents(table, str(passes), passes=sinks.COMPLIANCE_PASSES, shares=2)
    names = sorted(f.name for f in whole.glob("*.json"))
    assert len(names) == 2 and names == sorted(f.name for f in passes.glob("*.json"))
    for name in names:
        assert (whole / name).read_bytes() == (passes / name).read_bytes()
        assert len(json.loads((passes / name).read_text())["findings"]) > 400


def test_a_compliance_export_leaves_little_on_disk(spark, tmp_path):
    """Findings were shuffled once more to find their requirements, and all shuffle files stayed beside the documents."""
    table = sinks.compliance_lines(compliance_findings(spark), "scan_id", "position")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [coalesce(scan_id" in plan and "SortMergeJoin [coalesce(scan_id" not in plan

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [found.apply(i) for i in range(found.size())]
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}

    before = shuffled()
    documents.write_documents(table, str(tmp_path / "docs"), compressed=True, passes=sinks.COMPLIANCE_PASSES)
    assert sum(size for name, size in shuffled().items() if name not in before) < 100_000 < (tmp_path / "docs" / documents.file_name("a", True)).stat().st_size
