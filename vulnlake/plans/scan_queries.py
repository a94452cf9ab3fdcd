"""Queries of the rule scans and of the row-wise predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake import dimensions as dim
from vulnlake.functions import code as code_fn
from vulnlake.functions.text import BLANKS, computed_once, explode_lines, html_escape, line_excerpt, slug
from vulnlake.operators import filters, scan
from vulnlake.operators.reports import secret_summary, severity_counts
from vulnlake.plans import tables as t
from vulnlake.plans.registry import query
from vulnlake.plans.tables import q, read, sql_lines, sql_list, with_tables
from vulnlake.rules.code_rules import CODE_RULES, SAFE_PATTERNS
from vulnlake.rules.infra_rules import (
    COMPOSE_RULES,
    DOCKERFILE_REQUIRED,
    DOCKERFILE_RULES,
    KUBERNETES_RULES,
    SECRET_RULES,
    SECRET_SKIP_SUFFIXES,
)
from vulnlake.rules.model import rules_frame

# The comparison engine has no lookahead, so rules that use it are left out of compared queries.
PORTABLE = tuple(r for r in CODE_RULES if "(?!" not in r.pattern)
CREDENTIALS = tuple(r for r in PORTABLE if r.cwe_id == "CWE-798")
PORTABLE_INFRA = {"dockerfile": DOCKERFILE_RULES, "docker-compose": COMPOSE_RULES, "kubernetes": KUBERNETES_RULES}

BLANK_SQL = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def sql_strip(text: str) -> str:
    return f"trim({text}, {BLANK_SQL})"


def sql_fires(rule, line="line"):
    option = ", 'i'" if rule.ignore_case else ""
    test = f"regexp_matches({line}, {q(rule.pattern)}{option})"
    for pattern in rule.negative:
        test += f" AND NOT regexp_matches({line}, {q(pattern)}{option})"
    return f"({test})"


def sql_safe(text, patterns=SAFE_PATTERNS):
    cases = " ".join(
        f"WHEN language = {q(lang)} THEN " + " OR ".join(f"regexp_matches({text}, {q(p)}, 'i')" for p in ps)
        for lang, ps in patterns.items())
    return f"(CASE {cases} ELSE FALSE END)"


SQL_COMMENT = f"""((language = 'python' AND (starts_with({sql_strip('line')}, '#') OR starts_with({sql_strip('line')}, '\"\"\"')
  OR starts_with({sql_strip('line')}, ''''''''))) OR (language IN ('javascript', 'typescript') AND (starts_with({sql_strip('line')}, '//')
  OR starts_with({sql_strip('line')}, '/*') OR starts_with({sql_strip('line')}, '*'))))"""


def sql_lang(rule):
    return "language IN (" + ", ".join(q(x) for x in rule.languages) + ")"


def sql_rule_attrs(rules, *names):
    rows = ", ".join("(" + ", ".join([str(r.number)] + ["NULL" if getattr(r, n) is None else q(getattr(r, n)) for n in names]) + ")" for r in rules)
    return f"(VALUES {rows}) AS r(number, {', '.join(names)})"


def sql_scan(source: str, columns: str, rules, best: bool = True) -> str:
    """The code scan over a source with language and text."""
    ordered = sorted(rules, key=lambda r: (r.rank, r.number))
    tests = [f"WHEN {sql_lang(r)} AND {sql_fires(r)} THEN {r.number}" for r in (ordered if best else rules)]
    if best:
        number = f"(CASE {' '.join(tests)} END)"
    else:
        number = "unnest(list_filter([" + ", ".join(f"CASE {x} END" for x in tests) + "], lambda x: x IS NOT NULL))"
    keep = "WHERE number IS NOT NULL" if best else ""
    live = f"(SELECT * FROM {source} WHERE NOT {sql_safe('text')})"
    lines = f"(SELECT * FROM {sql_lines(live, columns)} WHERE NOT {SQL_COMMENT} AND NOT {sql_safe('line')})"
    return f"(SELECT * FROM (SELECT *, {number} AS number FROM {lines}) {keep})"


# ------------------------------------------------------------------ code scan


@query("r1_code_rule_matches", with_tables(t.CODE_FILES, body=f"""
SELECT file_id, line_no AS start_line, r.rule_id, r.severity, r.cwe_id, {sql_strip('line')} AS code_snippet
FROM {sql_scan('code_files', 'file_id, language', PORTABLE, best=False)} m JOIN {sql_rule_attrs(PORTABLE, 'rule_id', 'severity', 'cwe_id')} ON m.number = r.number"""))
def code_rule_matches(spark, sf):
    files = t.code_files(spark, sf).select("file_id", "language", "text")
    return scan.match_code(files, PORTABLE, unicode=False).select("file_id", "start_line", "rule_id", "severity", "cwe_id", "code_snippet")


W1_SQL = f"""
SELECT file_id, line_no AS start_line, r.rule_id, r.severity, r.cwe_id, r.message, {sql_strip('line')} AS code_snippet
FROM {sql_scan('code_files', 'file_id, language', PORTABLE)} m JOIN {sql_rule_attrs(PORTABLE, 'rule_id', 'severity', 'cwe_id', 'message')} ON m.number = r.number"""


@query("w1_best_finding_per_line", with_tables(t.CODE_FILES, body=W1_SQL))
def best_finding_per_line(spark, sf):
    files = t.code_files(spark, sf).select("file_id", "language", "text")
    return scan.scan_code(files, PORTABLE, unicode=False).select(
        "file_id", "start_line", "rule_id", "severity", "cwe_id", "message", "code_snippet")


@query("w1_best_per_line_of_table", with_tables(t.CODE_FILES, body=W1_SQL))
def best_per_line_of_table(spark, sf):
    files = t.code_files(spark, sf).select("file_id", "language", "text")
    best = scan.best_per_line(scan.match_code(files, PORTABLE, unicode=False), ["file_id"])
    return best.select("file_id", "start_line", "rule_id", "severity", "cwe_id", "message", "code_snippet")


# No derived line can fire a rule with lookahead, so the portable rules give the same rows.
@query("r1_code_scan_all_rules", with_tables(t.CODE_FILES, body=f"SELECT file_id, start_line, rule_id, severity, cwe_id FROM ({W1_SQL})"))
def code_scan_all_rules(spark, sf):
    files = t.code_files(spark, sf).select("file_id", "language", "text")
    return scan.scan_code(files).select("file_id", "start_line", "rule_id", "severity", "cwe_id")


@query("r1_documents_scan", f"""
SELECT doc_id, line_no AS start_line, r.rule_id, r.severity, {sql_strip('line')} AS code_snippet
FROM {sql_scan("(SELECT doc_id, 'python' AS language, text FROM documents)", 'doc_id, language', PORTABLE)} m
JOIN {sql_rule_attrs(PORTABLE, 'rule_id', 'severity')} ON m.number = r.number""")
def documents_scan(spark, sf):
    files = read(spark, sf, "documents").select("doc_id", F.lit("python").alias("language"), "text")
    return scan.scan_code(files, PORTABLE, unicode=False).select("doc_id", "start_line", "rule_id", "severity", "code_snippet")


SECRETS_BY_SOURCE_SQL = f"""
WITH hits AS (SELECT d.source, r.severity FROM {sql_scan("(SELECT source, 'python' AS language, text FROM documents)", 'source, language', CREDENTIALS)} d
  JOIN {sql_rule_attrs(CREDENTIALS, 'severity')} ON d.number = r.number)
SELECT s.source, count(h.severity) AS total, count(*) FILTER (h.severity = 'CRITICAL') AS critical_count,
  count(*) FILTER (h.severity = 'HIGH') AS high_count, count(*) FILTER (h.severity = 'MEDIUM') AS medium_count
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN hits h ON h.source = s.source GROUP BY s.source"""


@query("flagship_credentials_by_source", SECRETS_BY_SOURCE_SQL)
def credentials_by_source(spark, sf):
    """Hard-coded credentials per source of the document corpus, by severity."""
    docs = read(spark, sf, "documents").select("source", F.lit("python").alias("language"), "text")
    hits = scan.scan_code(docs, CREDENTIALS, unicode=False)
    counted = severity_counts(hits, ["source"])
    names = ["total", "critical_count", "high_count", "medium_count"]
    sources = read(spark, sf, "documents").select("source").distinct()
    return sources.join(counted, "source", "left").select("source", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


@query("r9_rules_from_table", with_tables(t.CODE_FILES, body=f"""
SELECT file_id, line_no, r.rule_id, r.severity, r.cwe_id FROM (SELECT file_id, line_no, unnest(list_filter([{", ".join(
    f"CASE WHEN {sql_lang(r)} AND {sql_fires(r)} THEN {r.number} END" for r in PORTABLE)}], lambda x: x IS NOT NULL)) AS number
  FROM {sql_lines('code_files', 'file_id, language')}) m JOIN {sql_rule_attrs(PORTABLE, 'rule_id', 'severity', 'cwe_id')} ON m.number = r.number"""))
def rules_from_table(spark, sf):
    """All rules as a table; unlike the code scan it keeps comments and safe lines, and every rule that fires."""
    lines = explode_lines(t.code_files(spark, sf).select("file_id", "language", "text"))
    table = rules_frame(spark, PORTABLE).select("rule_id", "pattern", "severity", "cwe_id", "languages", "negative", "needles")
    return scan.scan_with_rule_table(lines, table).select("file_id", "line_no", "rule_id", "severity", "cwe_id")


# --------------------------------------------------------------- infra, secrets

SQL_INFRA_TYPE = """(CASE WHEN contains(lower(filename), 'dockerfile') THEN 'dockerfile'
  WHEN contains(lower(filename), 'docker-compose') OR contains(lower(filename), 'compose.y') THEN 'docker-compose'
  WHEN contains(text, 'apiVersion:') OR contains(text, 'kind:') OR contains(text, 'metadata:') THEN 'kubernetes'
  WHEN contains(lower(filename), 'terraform') OR ends_with(lower(filename), '.tf') THEN 'terraform' ELSE 'generic' END)"""


@query("p16_infra_type", with_tables(t.INFRA_FILES, body=f"SELECT file_id, {SQL_INFRA_TYPE} AS infra_type FROM infra_files"))
def infra_types(spark, sf):
    return t.infra_files(spark, sf).select("file_id", scan.infra_type(F.col("filename"), F.col("text")).alias("infra_type"))


def sql_family(lines, rules, guard=""):
    ported = [r for r in rules if "(?!" not in r.pattern]
    numbers = ", ".join(f"CASE WHEN {sql_fires(r)} THEN {r.number} END" for r in ported)
    where = f"WHERE {guard}" if guard else ""
    return f"""SELECT file_id, line_no, r.rule_id, r.type, r.severity FROM (SELECT file_id, line_no,
      unnest(list_filter([{numbers}], lambda x: x IS NOT NULL)) AS number FROM {lines} {where}) m JOIN
      (VALUES {", ".join(f"({r.number}, {q(r.rule_id)}, {q(r.title)}, {q(r.severity)})" for r in ported)}) r(number, rule_id, type, severity) ON m.number = r.number"""


INFRA_LINES_SQL = sql_lines(f"(SELECT *, {SQL_INFRA_TYPE} AS infra_type FROM infra_files)", "file_id, filename, infra_type")


@query("r2_infra_scan", with_tables(t.INFRA_FILES, f"infra_lines AS (SELECT * FROM {INFRA_LINES_SQL})", body=" UNION ALL ".join(
    [sql_family("infra_lines", rules, f"infra_type = {q(kind)}") for kind, rules in PORTABLE_INFRA.items()] + [sql_family("infra_lines", SECRET_RULES)])))
def infra_scan(spark, sf):
    files = t.infra_files(spark, sf).withColumn("infra_type", scan.infra_type(F.col("filename"), F.col("text")))
    hits = scan.scan_infra(files.select("file_id", "infra_type", "text"), unicode=False)
    lookahead = [r.rule_id for rules in PORTABLE_INFRA.values() for r in rules if "(?!" in r.pattern]
    return hits.filter(~F.col("rule_id").isin(*lookahead)).select("file_id", "line_no", "rule_id", "type", "severity")


@query("r2_infra_scan_all_rules")
def infra_scan_all_rules(spark, sf):
    files = t.infra_files(spark, sf).withColumn("infra_type", scan.infra_type(F.col("filename"), F.col("text")))
    return scan.scan_infra(files.select("file_id", "infra_type", "text"))


@query("r3_secret_scan", with_tables(t.INFRA_FILES, body=sql_family(sql_lines("infra_files", "file_id"), SECRET_RULES)))
def secret_scan(spark, sf):
    return scan.scan_secrets(t.infra_files(spark, sf).select("file_id", "text"), unicode=False).select(
        "file_id", "line_no", "rule_id", "type", "severity")


SKIP_SQL = " OR ".join(f"ends_with(filename, {q(s)})" for s in SECRET_SKIP_SUFFIXES)
FILE_SECRETS_SQL = sql_family(
    f"(SELECT * FROM {sql_lines('infra_files', 'file_id, filename')} WHERE NOT ({SKIP_SQL}) AND NOT starts_with({sql_strip('line')}, '#') AND NOT starts_with({sql_strip('line')}, '//'))",
    SECRET_RULES)


@query("r4_file_secret_scan", with_tables(t.INFRA_FILES, body=FILE_SECRETS_SQL))
def file_secret_scan(spark, sf):
    files = t.infra_files(spark, sf).select("file_id", "filename", "text")
    hits = scan.scan_secrets(files, unicode=False, skip_comments=True, filename="filename")
    return hits.select("file_id", "line_no", "rule_id", "type", "severity")


@query("p17_secret_scan_files", with_tables(t.INFRA_FILES, body=f"SELECT file_id, filename FROM infra_files WHERE NOT ({SKIP_SQL})"))
def secret_scan_files(spark, sf):
    name = F.col("filename")
    skipped = F.lit(False)
    for suffix in SECRET_SKIP_SUFFIXES:
        skipped = skipped | name.endswith(suffix)
    return t.infra_files(spark, sf).filter(~skipped).select("file_id", "filename")


@query("r4_documents_secrets", sql_family(sql_lines("(SELECT doc_id AS file_id, text FROM documents)", "file_id"), SECRET_RULES))
def documents_secrets(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return scan.scan_secrets(docs, unicode=False).select("file_id", "line_no", "rule_id", "type", "severity")


@query("r5_missing_instructions", with_tables(t.INFRA_FILES, body=" UNION ALL ".join(
    f"SELECT file_id, 1 AS line_no, {q(rid)} AS rule_id, {q(kind)} AS type, {q(sev)} AS severity FROM infra_files WHERE contains(lower(filename), 'dockerfile') AND NOT contains(upper(text), {q(need)})"
    for rid, sev, kind, need, _m, _a in DOCKERFILE_REQUIRED)))
def missing_instructions(spark, sf):
    files = t.infra_files(spark, sf).filter(F.lower("filename").contains("dockerfile")).select("file_id", "text")
    return scan.scan_absent(files).select("file_id", "line_no", "rule_id", "type", "severity")


@query("a17_secret_summary", with_tables(t.INFRA_FILES, body=f"""SELECT file_id, count(*) AS secrets_found,
  array_to_string(list_sort(list_distinct(list(type))), '|') AS types FROM ({sql_family(sql_lines('infra_files', 'file_id'), SECRET_RULES)}) GROUP BY file_id"""))
def secrets_per_file(spark, sf):
    hits = scan.scan_secrets(t.infra_files(spark, sf).select("file_id", "text"), unicode=False)
    return secret_summary(hits, ["file_id"]).select("file_id", "secrets_found", F.array_join("types", "|").alias("types"))


@query("r8_indicator_features", f"""SELECT doc_id, {", ".join(f"CAST(regexp_matches(text, {q(p)}, 'i') AS DOUBLE) AS f{i:02d}" for i, p in enumerate(code_fn.INDICATORS))},
  round(least(length(text) / 1000.0, 1.0), 6) AS f46, round(least((length(text) - length(replace(text, chr(10), ''))) / 100.0, 1.0), 6) AS f47,
  round(least((length(text) - length(replace(text, 'import', ''))) / 6 / 10.0, 1.0), 6) AS f48,
  round(least((length(text) - length(replace(text, 'def ', ''))) / 4 / 10.0, 1.0), 6) AS f49 FROM documents""")
def indicators(spark, sf):
    docs = computed_once(read(spark, sf, "documents").select("doc_id", "text"), _low=F.lower("text"))
    rows = computed_once(docs, v=code_fn.indicator_features(F.col("text"), False, F.col("_low")))
    return rows.select("doc_id", *[F.round(F.element_at("v", i + 1), 6).alias(f"f{i:02d}") for i in range(code_fn.FEATURES)])


# -------------------------------------------------------------- row predicates


@query("p1_lines", f"SELECT doc_id, line_no, line FROM {sql_lines('documents', 'doc_id')}")
def all_lines(spark, sf):
    return explode_lines(read(spark, sf, "documents").select("doc_id", "text"))


def sql_case_map(values, key, default="NULL"):
    return f"(CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END)"


SQL_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.].*?(\.[^.]+)$', 1))"


@query("p2_p3_language_by_extension", with_tables(t.CODE_FILES, body=f"""SELECT file_id, {sql_case_map(dim.SCANNER_LANGUAGES, SQL_EXT)} AS scanner_language,
  {sql_case_map(dim.PROJECT_LANGUAGES, SQL_EXT)} AS project_language, {sql_case_map(dim.SCANNER_LANGUAGES, SQL_EXT, "'python'")} AS default_language FROM code_files"""))
def languages_by_extension(spark, sf):
    path = F.col("path")
    return t.code_files(spark, sf).select(
        "file_id", filters.language_by_extension(path).alias("scanner_language"), filters.project_language(path).alias("project_language"),
        filters.language_by_extension(path, default="python").alias("default_language"))


def sql_content_language(text, branches):
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, {q(x)})" for x in xs) + f" THEN {q(lang)}" for lang, xs in branches)
    return f"(CASE {cases} ELSE 'unknown' END)"


@query("p4_language_by_content", with_tables(t.CODE_FILES, body=f"""SELECT file_id, {sql_content_language('text', filters.CONTENT_LANGUAGE)} AS language,
  {sql_content_language('text', filters.CONTENT_LANGUAGE_SHORT)} AS short_language FROM code_files"""))
def languages_by_content(spark, sf):
    text = F.col("text")
    return t.code_files(spark, sf).select("file_id", filters.language_by_content(text).alias("language"),
                                          filters.language_by_content(text, filters.CONTENT_LANGUAGE_SHORT).alias("short_language"))


@query("p5_ignored_paths", with_tables(t.CODE_FILES, body=f"""SELECT file_id, path, list_has_any(string_split(path, '/'), {sql_list(dim.IGNORED_DIRS)}) AS ignored,
  list_contains({sql_list(dim.PROJECT_SKIP_DIRS)}, string_split(path, '/')[2]) OR starts_with(string_split(path, '/')[2], '.') AS skipped_dir FROM code_files"""))
def ignored_paths(spark, sf):
    part = F.element_at(F.split("path", "/"), 2)
    return t.code_files(spark, sf).select("file_id", "path", filters.in_ignored_dir(F.col("path")).alias("ignored"),
                                          filters.skip_project_dir(part).alias("skipped_dir"))


@query("p6_comment_lines", with_tables(t.CODE_FILES, body=f"SELECT file_id, line_no, {SQL_COMMENT} AS is_comment FROM {sql_lines('code_files', 'file_id, language')}"))
def comment_lines(spark, sf):
    lines = explode_lines(t.code_files(spark, sf).select("file_id", "language", "text"))
    return lines.select("file_id", "line_no", scan.is_comment(F.col("line"), F.col("language")).alias("is_comment"))


@query("p7_safe_files", with_tables(t.CODE_FILES, body=f"SELECT file_id, {sql_safe('text')} AS is_safe FROM code_files"))
def safe_files(spark, sf):
    return t.code_files(spark, sf).select("file_id", scan.is_safe(F.col("text"), F.col("language")).alias("is_safe"))


@query("p8_safe_lines", with_tables(t.CODE_FILES, body=f"SELECT file_id, line_no, {sql_safe('line')} AS is_safe FROM {sql_lines('code_files', 'file_id, language')}"))
def safe_lines(spark, sf):
    lines = explode_lines(t.code_files(spark, sf).select("file_id", "language", "text"))
    return lines.select("file_id", "line_no", scan.is_safe(F.col("line"), F.col("language")).alias("is_safe"))


SQL_LINES_OF_TEXT = "(length(text) - length(replace(text, chr(10), '')) + 1)"


@query("p9_code_input_problem", f"""SELECT doc_id, CASE WHEN text IS NULL OR {sql_strip('text')} = '' THEN 'Code cannot be empty'
  WHEN length(text) > 1000000 THEN 'Code exceeds maximum size of 976KB' WHEN {SQL_LINES_OF_TEXT} > 10000 THEN 'Code exceeds maximum of 10000 lines'
  WHEN lang NOT IN {tuple(filters.INPUT_LANGUAGES)} THEN 'Unsupported language: ' || lang || '. Allowed: {", ".join(filters.INPUT_LANGUAGES)}' END AS reason
  FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'python' END AS lang FROM documents)""")
def code_input_problem(spark, sf):
    d = read(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 17 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("python").alias("lang"))
    return d.select("doc_id", filters.code_problem(F.col("text"), F.col("lang")).alias("reason"))


NAME_VARIANTS = ["{}.py", "../{}.py", "a/{}.js", "x;{}", "we irdé{}.txt", "..%2f{}", "n{}$(ls)", "", "ok-{}_v.2.ts", "b\\{}"]
SQL_NAME = "replace(" + t.sql_pick(NAME_VARIANTS, "p_partkey") + ", '{}', CASE WHEN p_partkey % 97 = 0 THEN repeat(p_name, 30) ELSE p_name END)"


@query("p10_filename_problem", f"""SELECT p_partkey, name, CASE WHEN name = '' THEN 'Filename cannot be empty' WHEN length(name) > 255 THEN 'Filename too long (max 255 characters)'
  WHEN {" OR ".join(f"regexp_matches(name, {q(p)})" for p in filters.DANGEROUS_NAME_PATTERNS if "x00" not in p)} THEN 'Invalid filename - contains dangerous characters'
  WHEN contains(name, '/') OR contains(name, chr(92)) THEN 'Filename cannot contain path separators'
  WHEN NOT regexp_matches(name, '^[\\w\\-. é]+$') THEN 'Filename contains invalid characters' END AS reason,
  NOT (contains(name, '..') OR contains(name, '/') OR contains(name, chr(92)) OR length(name) > 255) AS is_safe
  FROM (SELECT p_partkey, {SQL_NAME} AS name FROM part)""")
def filename_problem(spark, sf):
    p = F.col("p_partkey")
    filled = F.when(p % 97 == 0, F.repeat("p_name", 30)).otherwise(F.col("p_name"))
    rows = read(spark, sf, "part").select("p_partkey", F.replace(t.pick(NAME_VARIANTS, p), F.lit("{}"), filled).alias("name"))
    return rows.select("p_partkey", "name", filters.filename_problem(F.col("name")).alias("reason"), filters.is_safe_filename(F.col("name")).alias("is_safe"))


URL_VARIANTS = ["", "http://localhost:8000/", "https://10.0.0.7/x?u=", "ftp://", "http://172.20.1.1/?", "http://[::1]/", "https://192.168.1.9/"]
SQL_URL = f"(CASE WHEN page_id % 4 = 0 THEN {t.sql_pick(URL_VARIANTS, 'page_id')} || url ELSE url END)"


@query("p11_url_problem", f"""SELECT page_id, CASE WHEN url = '' THEN 'URL cannot be empty' WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://'))
  THEN 'URL must start with http:// or https://' WHEN {" OR ".join(f"regexp_matches(url, {q(p)}, 'i')" for p in filters.PRIVATE_URL_PATTERNS)}
  THEN 'Access to internal/private URLs is not allowed' END AS reason FROM (SELECT page_id, {SQL_URL} AS url FROM pages)""")
def url_problem(spark, sf):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(t.pick(URL_VARIANTS, F.col("page_id")), F.col("url"))).otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", filters.url_problem(url).alias("reason"))


PATH_VARIANTS = ["/srv/app/a/{}", "/srv/app/../etc/{}", "/srv/application/{}", "x/./{}", "../../{}", "/srv/app/b/../../app/{}", "../app/{}"]
PATH_INSIDE = [True, False, False, True, False, True, True]


@query("p12_path_containment", f"""SELECT p_partkey, {t.sql_pick([str(x) for x in PATH_INSIDE], 'p_partkey')} = 'True' AS inside FROM part""")
def path_containment(spark, sf):
    path = F.replace(t.pick(PATH_VARIANTS, F.col("p_partkey")), F.lit("{}"), F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", filters.within(path, F.lit("/srv/app")).alias("inside"))


SQL_STRIPPED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')"


@query("p13_sample_quality", with_tables(t.CODE_FILES, body=f"""SELECT file_id, length({sql_strip('text')}) >= 20 AND len({SQL_STRIPPED}) >= 2 AND
  len(list_filter({SQL_STRIPPED}, lambda x: NOT (starts_with(x, 'import') OR starts_with(x, 'from ') OR starts_with(x, '#include') OR starts_with(x, 'using')))) >= 1 AS valid FROM code_files"""))
def sample_quality(spark, sf):
    return t.code_files(spark, sf).select("file_id", filters.is_valid_sample(F.col("text")).alias("valid"))


@query("p14_length_limits", f"""SELECT doc_id, length(text) BETWEEN 50 AND 5000 AS cleaned, length(text) BETWEEN 51 AND 4999 AS csv, length(text) BETWEEN 50 AND 10000 AS large,
  length(text) BETWEEN 30 AND 15000 AND {SQL_LINES_OF_TEXT} >= 2 AS large_multi_line, length(text) BETWEEN 100 AND 10000 AS production, length(text) >= 20 AS minimum FROM documents""")
def length_limits(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *[filters.length_within(F.col("text"), use).alias(use) for use in filters.LENGTH_LIMITS])


@query("p15_language_subset", with_tables(t.SAMPLES, body="SELECT lower(language) AS language, count(*) AS samples FROM samples WHERE lower(language) IN ('python', 'javascript') GROUP BY lower(language)"))
def language_subset(spark, sf):
    kept = filters.keep_languages(t.samples(spark, sf), ["Python", "javascript"])
    return kept.groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("samples"))


@query("p18_plain_imports", with_tables(t.CODE_FILES, body=f"""SELECT file_id, (starts_with(s, 'import ') OR (starts_with(s, 'from ') AND contains(s, ' import ')))
  AND NOT ({" OR ".join(f"contains(text, {q(x)})" for x in filters.DANGEROUS_CALLS)}) AS plain_import FROM (SELECT file_id, text, {sql_strip('text')} AS s FROM code_files)"""))
def plain_imports(spark, sf):
    return t.code_files(spark, sf).select("file_id", filters.is_plain_import(F.col("text")).alias("plain_import"))


# ------------------------------------------------------------------ expressions


@query("w6_line_excerpt", f"""SELECT doc_id, line_no, array_to_string(parts[greatest(1, line_no - 1) : line_no + 1], chr(10)) AS one,
  array_to_string(parts[greatest(1, line_no - 2) : line_no + 2], chr(10)) AS two
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, doc_id % 9 + 1 AS line_no FROM documents)""")
def excerpts(spark, sf):
    line = (F.col("doc_id") % 9 + 1).cast("int")
    return read(spark, sf, "documents").select("doc_id", line.alias("line_no"), line_excerpt(F.col("text"), line).alias("one"),
                                               line_excerpt(F.col("text"), line, 2).alias("two"))


@query("z17_html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def escaped_pages(spark, sf):
    return read(spark, sf, "pages").select("page_id", html_escape(F.col("html")).alias("escaped"))


@query("z13_slugs", with_tables(t.FINDINGS, body="""SELECT DISTINCT type, lower(replace(type, ' ', '_')) AS slug, rule_id,
  array_to_string(list_transform(regexp_extract_all(replace(list_last(string_split(rule_id, '.')), '-', ' '), '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM findings"""))
def slugs(spark, sf):
    from vulnlake.functions.text import title_of_rule_id
    return t.findings(spark, sf).select("type", slug(F.col("type")).alias("slug"), "rule_id", title_of_rule_id(F.col("rule_id")).alias("title")).distinct()


@query("r6_rule_catalogue")
def rule_catalogue(spark, sf):
    """Findings per rule of the catalogue, rules without a finding included."""
    families = {"code": CODE_RULES, "dockerfile": DOCKERFILE_RULES, "compose": COMPOSE_RULES, "kubernetes": KUBERNETES_RULES, "secrets": SECRET_RULES}
    rows = None
    for name, rules in families.items():
        part = rules_frame(spark, rules).select(F.lit(name).alias("family"), "number", "rule_id", "severity")
        rows = part if rows is None else rows.unionByName(part)
    hits = scan.scan_secrets(t.infra_files(spark, sf).select("file_id", "text")).groupBy("rule_id").agg(F.count("*").alias("n"))
    joined = F.broadcast(rows).join(hits, "rule_id", "left")
    return joined.groupBy("family").agg(F.count("*").alias("rules"), F.sum(F.coalesce("n", F.lit(0))).alias("secret_findings"),
                                        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "rule_id"))), lambda s: s["rule_id"]), ",").alias("rule_ids"))
