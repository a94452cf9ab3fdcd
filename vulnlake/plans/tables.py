"""Tables of the domain derived from the given test tables.

Every derivation exists twice, as a DataFrame and as SQL for the comparison engine, and
grows with the table it reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.dimensions import ADVISORIES

# Lines of which the code files are composed; @@ becomes a number.
CODE_LINES = [
    'x_@@ = load(@@)',
    'os.system("ls " + name_@@)',
    "os.system(f'rm {path_@@}')",
    'result = eval(expr_@@)',
    '# eval(comment_@@)',
    'cursor.execute("SELECT * FROM t@@ WHERE id=%s" % uid)',
    'query = "SELECT * FROM users WHERE id=" + uid_@@',
    "q = f'DELETE FROM t@@ WHERE k={key}'",
    "password = 'hunter@@x'",
    "api_key = 'ABCDEFGH@@'",
    'token = "tok_@@_abcdefgh"',
    'DB_PASSWORD = "pw@@"',
    'data = pickle.loads(blob_@@)',
    'cfg = yaml.load(stream_@@)',
    'cfg = yaml.load(stream_@@, Loader=SafeLoader)',
    'n = random.randint(1, @@)',
    'h = hashlib.md5(b_@@).hexdigest()',
    'el.innerHTML = value_@@;',
    'document.write(html_@@)',
    'if (a == "v@@") { run() }',
    'fetch(url_@@ + path)',
    "axios.get(base_@@ + id)",
    '// console.log(password_@@)',
    'console.log("user" + name_@@)',
    'requests.get(host_@@ + path, verify=False)',
    'app.run(debug=True, port=@@)',
    'jwt.decode(tok_@@, verify=False)',
    'time.sleep(@@)',
    '# TODO security review @@',
    'pip install pkg_@@',
    'logger.info("login %s" % user_@@)',
    'print(f"value {v_@@}")',
    'except Exception: pass',
    'try { f(@@) } catch (e) {}',
    'with open(path_@@) as fh:',
    'fh = open("../conf/@@.ini")',
    '    return helper_@@(a, b)',
    'def func_@@(a, b):',
    'import mod_@@',
    'from pkg import mod_@@',
    '',
    'const v@@ = require("x")',
    '"""docstring @@"""',
    'y_@@ = a.b.c(@@)',
    'subprocess.run(cmd_@@, shell=True)',
    'Access-Control-Allow-Origin: *',
    'value = html.escape(raw_@@)',
]
INFRA_LINES = [
    'FROM python:latest', 'FROM python:3.12-slim', 'USER root', 'USER app', 'RUN curl https://x.test/i@@.sh | bash',
    'EXPOSE 22', 'EXPOSE 80@@', 'ENV API_KEY=abc@@', 'ADD https://x.test/a@@.tgz /opt', 'RUN chmod 777 /srv',
    'RUN sudo make install', 'COPY . /app', 'HEALTHCHECK CMD true', 'privileged: true', 'network_mode: "host"',
    'pid: host', 'volumes: /a:/b@@:rw', 'environment: PASSWORD=p@@', 'cap_add: SYS_ADMIN',
    'security_opt: seccomp:unconfined', 'runAsUser: 0', 'hostNetwork: true', 'hostPID: true', 'hostIPC: true',
    'allowPrivilegeEscalation: true', 'readOnlyRootFilesystem: false', 'capabilities: {add: [NET_ADMIN]}',
    'image: repo/app:latest', 'resources: {}', 'apiVersion: v1', 'kind: Pod', 'api_key = abcdefghijklmnopqrst@@',
    'password: correcthorse@@', '-----BEGIN RSA PRIVATE KEY-----',
    'ghp_abcdefghijklmnopqrstuvwxyz0123456789', 'Authorization: Bearer abcdefghijklmnopqrstuvwx@@',
    'postgres://user:pw@@@db/x', 'xoxb-1234567890-abc@@', '# password: commentedout@@', '// bearer abcdefghijklmnopqrstuvw',
    'twilio_token = abcdefghijklmnopqrst@@', 'name: svc@@', '',
]
INFRA_NAMES = ["Dockerfile", "docker-compose.yml", "deploy.yaml", "main.tf", "notes.txt", "app.min.js", "Dockerfile.dev"]
REQUIREMENT_LINES = [f"{n}{o}{v}" for (n, o, v) in [
    ("Django", "==", "3.2.@"), ("flask", ">=", "2.@.0"), ("requests", "==", "2.@.1"), ("numpy", "~=", "1.@.0"),
    ("PyYAML", "==", "5.@"), ("jinja2", " == ", "3.1.@"), ("pillow", "<", "9.@.0"), ("left_pad", "==", "1.@.0"),
    ("cryptography", ">=", "@.0.0"), ("werkzeug", "==", "2.@.0rc1")]] + [
    "# pinned @", "-r base.txt", "", "lodash", "pkg[extra]==1.@", "  axios==1.@.0  "]
PACKAGES = sorted({a[0] for a in ADVISORIES}) + ["left-pad", "numba", "click"]
FINDING_TYPES = [
    "SQL Injection", "XSS", "Command Injection", "Path Traversal", "LDAP Injection", "XXE", "Insecure Deserialization",
    "Hardcoded Credentials", "Weak Cryptography", "SSRF", "Broken Access Control", "Security Misconfiguration",
    "Insufficient Logging", "Open Redirect", "Session Fixation", "AUTH bypass"]
FINDING_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "NOTICE"]
FINDING_CWES = ["CWE-89", "CWE-79", "CWE-78", "CWE-90", "CWE-22", "CWE-611", "CWE-502", "CWE-798", "CWE-327", "CWE-918",
                "CWE-200", "CWE-284", "CWE-306", "CWE-307", "CWE-434", "CWE-352", "CWE-1021", "CWE-1", "CWE-1035", "CWE-9999"]
LANGUAGES = ["python", "javascript", "typescript", "java", "go"]
RULE_IDS = ["python.lang.sql-injection", "js.xss.dangerous-url", "java.weak-hash.md5", "go.session-store", "c.log-injection",
            "py.yaml-load.unsafe", "ts.ssrf.fetch", "rb.open-redirect", "py.pickle-use", "py.crypto.aes", "js.auth.check",
            "any.rule", "py.path-traversal", "java.deserial.obj", "js.jwt-none-algorithm", "py.debug-enabled", "insufficient-logging"]
TEST_IDS = ["B101", "B102", "B105", "B201", "B301", "B303", "B310", "B404", "B608", "B999"]
LICENSES = ["MIT", "Apache-2.0 License", "GPL-3.0-only", "LGPL-2.1", "SSPL-1.0", "Proprietary", "", "LIMITED", "ISC"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def whole_quotient(number: Column, by: int) -> Column:
    """Division of whole numbers; ``/`` would go through doubles, which are not exact beyond 2 ** 53."""
    return F.call_function("div", number, F.lit(by))


def sql_pick(values, index: str) -> str:
    return f"{sql_list(values)}[1 + ({index}) % {len(values)}]"


def _composed(spark, sf, lines) -> DataFrame:
    """One text per order; only the numbers of which its lines are made are shuffled and sorted, not the lines."""
    li = read(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("file_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("s"))

    def line(s):
        return F.replace(pick(lines, s["l_partkey"] * 7 + s["l_suppkey"]), F.lit("@@"), s["l_suppkey"].cast("string"))

    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), line), "\n").alias("text"))


def _sql_composed(lines) -> str:
    return f"""SELECT l_orderkey AS file_id, string_agg(replace({sql_pick(lines, 'l_partkey * 7 + l_suppkey')}, '@@',
      CAST(l_suppkey AS VARCHAR)), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text
      FROM lineitem GROUP BY l_orderkey"""


def code_files(spark, sf) -> DataFrame:
    """file_id, project, path, language, text: one file per order, one line per item."""
    ext = pick([".py", ".js", ".ts", ".py", ".jsx", ".rb"], F.col("file_id"))
    folder = pick(["src/a", "node_modules/b", "lib/.git", "app/build", "core"], F.col("file_id"))
    return _composed(spark, sf, CODE_LINES).select(
        "file_id", F.when(F.col("file_id") % 3 == 0, 0).otherwise(F.col("file_id") % 40).alias("project"),
        F.concat(folder, F.lit("/f"), F.col("file_id").cast("string"), ext).alias("path"),
        pick(["python", "javascript", "typescript", "python"], F.col("file_id")).alias("language"), "text")


CODE_FILES = f"""code_files AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 0 ELSE file_id % 40 END AS project,
  {sql_pick(["src/a", "node_modules/b", "lib/.git", "app/build", "core"], "file_id")} || '/f' || CAST(file_id AS VARCHAR)
  || {sql_pick([".py", ".js", ".ts", ".py", ".jsx", ".rb"], "file_id")} AS path,
  {sql_pick(["python", "javascript", "typescript", "python"], "file_id")} AS language, text
  FROM ({_sql_composed(CODE_LINES)}))"""


def infra_files(spark, sf) -> DataFrame:
    return _composed(spark, sf, INFRA_LINES).select("file_id", pick(INFRA_NAMES, F.col("file_id")).alias("filename"), "text")


INFRA_FILES = f"""infra_files AS (SELECT file_id, {sql_pick(INFRA_NAMES, "file_id")} AS filename, text
  FROM ({_sql_composed(INFRA_LINES)}))"""


def sql_lines(source: str, columns: str) -> str:
    """Lines of a source with a ``text`` column."""
    return f"""(SELECT {columns}, unnest(string_split(text, chr(10))) AS line,
      unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM {source})"""


def findings(spark, sf) -> DataFrame:
    """Findings of scans; a third of them belong to scan 0."""
    li = read(spark, sf, "lineitem")
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return li.select(
        F.when(k % 3 == 0, 0).otherwise(k % 400).alias("scan_id"),
        (((k * 16 + n) * 1000000 + p) * 1000 + s % 1000).alias("position"),
        pick(FINDING_TYPES, p).alias("type"), pick(FINDING_SEVERITIES, s).alias("severity"),
        pick(FINDING_CWES, p + s).alias("cwe"), pick(RULE_IDS, p + k).alias("rule_id"), pick(TEST_IDS, s + n).alias("test_id"),
        F.when(p % 7 == 0, None).otherwise(F.concat(F.lit("label "), (p % 9).cast("string"))).alias("owasp"),
        F.when(p % 11 == 0, None).otherwise(F.concat(F.lit("Issue "), p.cast("string"), F.lit(" in "), F.repeat(F.lit("module "), (p % 60).cast("int")))).alias("message"),
        F.when(p % 5 == 0, None).otherwise(F.concat(F.lit("Fix "), (p % 5).cast("string"))).alias("suggestion"),
        F.concat(F.lit("src/f"), (s % 50).cast("string"), F.lit(".py")).alias("file"),
        ((k * 7 + n * 3) % 200 + 1).cast("int").alias("line"), (p % 80 + 1).cast("int").alias("column"),
        ((p % 100) / 100.0).alias("confidence"))


FINDINGS = f"""findings AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 400 END AS scan_id,
  ((l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS position,
  {sql_pick(FINDING_TYPES, 'l_partkey')} AS type, {sql_pick(FINDING_SEVERITIES, 'l_suppkey')} AS severity,
  {sql_pick(FINDING_CWES, 'l_partkey + l_suppkey')} AS cwe, {sql_pick(RULE_IDS, 'l_partkey + l_orderkey')} AS rule_id,
  {sql_pick(TEST_IDS, 'l_suppkey + l_linenumber')} AS test_id,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'label ' || CAST(l_partkey % 9 AS VARCHAR) END AS owasp,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'Issue ' || CAST(l_partkey AS VARCHAR) || ' in ' || repeat('module ', l_partkey % 60) END AS message,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'Fix ' || CAST(l_partkey % 5 AS VARCHAR) END AS suggestion,
  'src/f' || CAST(l_suppkey % 50 AS VARCHAR) || '.py' AS file,
  CAST((l_orderkey * 7 + l_linenumber * 3) % 200 + 1 AS INTEGER) AS line, CAST(l_partkey % 80 + 1 AS INTEGER) AS "column",
  (l_partkey % 100) / 100.0 AS confidence FROM lineitem)"""


def scans(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    counts = {"critical_count": k % 3, "high_count": c % 5, "medium_count": (k + c) % 7, "low_count": k % 4}
    total = reduce(lambda a, b: a + b, counts.values())
    return o.select(
        k.alias("scan_id"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (c % 24).cast("int"), (k % 60).cast("int"))).alias("ts"),
        F.concat(F.lit("f"), (c % 97).cast("string"), F.lit(".py")).alias("filename"), pick(LANGUAGES, c).alias("language"),
        F.concat(F.lit("project"), F.when(k % 3 == 0, 0).otherwise(k % 30).cast("string")).alias("project_name"),
        (k % 5000).alias("code_size"), total.alias("vulnerability_count"), *[v.alias(n) for n, v in counts.items()],
        (c % 900).alias("scan_time_ms"))


SCANS = f"""scans AS (SELECT o_orderkey AS scan_id, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_custkey % 24 AS INTEGER))
  + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS ts, 'f' || CAST(o_custkey % 97 AS VARCHAR) || '.py' AS filename,
  {sql_pick(LANGUAGES, 'o_custkey')} AS language,
  'project' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 30 END AS VARCHAR) AS project_name,
  o_orderkey % 5000 AS code_size,
  o_orderkey % 3 + o_custkey % 5 + (o_orderkey + o_custkey) % 7 + o_orderkey % 4 AS vulnerability_count,
  o_orderkey % 3 AS critical_count, o_custkey % 5 AS high_count, (o_orderkey + o_custkey) % 7 AS medium_count,
  o_orderkey % 4 AS low_count, o_custkey % 900 AS scan_time_ms FROM orders)"""


def scan_findings(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("line_number"),
                     pick(FINDING_TYPES, F.col("l_partkey") * F.col("l_partkey") + F.col("l_suppkey")).alias("vulnerability_type"),
                     F.when(F.col("l_suppkey") % 9 == 0, None).otherwise(pick(FINDING_SEVERITIES[:5], F.col("l_suppkey"))).alias("severity"))


SCAN_FINDINGS = f"""scan_findings AS (SELECT l_orderkey AS scan_id, l_linenumber AS line_number,
  {sql_pick(FINDING_TYPES, 'l_partkey * l_partkey + l_suppkey')} AS vulnerability_type,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE {sql_pick(FINDING_SEVERITIES[:5], 'l_suppkey')} END AS severity FROM lineitem)"""


def samples(spark, sf) -> DataFrame:
    """Documents as labelled samples."""
    d = read(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("sample_id"), F.col("text").alias("code"), (i % 5 < 2).cast("int").alias("label"),
        pick(["python", "JavaScript", "typescript", "java"], i).alias("language"), "source",
        F.when(i % 13 == 0, None).when(i % 17 == 0, "").otherwise(pick(FINDING_TYPES, i * 3)).alias("vulnerability_type"),
        pick([22, 79, 89, 1021, 16, 9999, 0], i).cast("int").alias("cwe_id"))


SAMPLES = f"""samples AS (SELECT doc_id AS sample_id, text AS code, CAST(doc_id % 5 < 2 AS INTEGER) AS label,
  {sql_pick(["python", "JavaScript", "typescript", "java"], 'doc_id')} AS language, source,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE {sql_pick(FINDING_TYPES, 'doc_id * 3')} END AS vulnerability_type,
  {sql_pick([22, 79, 89, 1021, 16, 9999, 0], 'doc_id')} AS cwe_id FROM documents)"""

MODELS = [("net", "mlp", 1.5, 0.9), ("tree", "gbt", 1.0, 0.85), ("line", "logreg", 0.5, 0.8), ("seq", "rnn", 2.0, 0.88)]


def model_predictions(spark, sf) -> DataFrame:
    """One prediction per event and model; probabilities on a grid that avoids exact halves."""
    e = read(spark, sf, "events")
    models = F.array(*[F.struct(F.lit(i).alias("model_no"), F.lit(m[0]).alias("model"), F.lit(m[2]).alias("weight"))
                       for i, m in enumerate(MODELS)])
    rows = e.select(F.col("event_id").alias("sample_id"), F.inline(models))
    return rows.withColumn("probability", ((F.col("sample_id") * (F.col("model_no") * 37 + 11) + F.col("model_no") * 101) % 997 + 1) / 1000.0)


MODEL_PREDICTIONS = f"""model_predictions AS (SELECT event_id AS sample_id, m.model_no, m.model, m.weight,
  ((event_id * (m.model_no * 37 + 11) + m.model_no * 101) % 997 + 1) / 1000.0 AS probability
  FROM events CROSS JOIN (VALUES {", ".join(f"({i}, {q(m[0])}, CAST({m[2]} AS DOUBLE))" for i, m in enumerate(MODELS))}) m(model_no, model, weight))"""


def predictions(spark, sf) -> DataFrame:
    """Score, prediction and label per event."""
    e = read(spark, sf, "events")
    i = F.col("event_id")
    p = ((i * 37 + F.col("user_id") * 11) % 500 + 0.5) / 501.0
    return e.select(i.alias("sample_id"), p.alias("probability"), (p >= 0.5).cast("int").alias("prediction"),
                    (((i * 37 + F.col("user_id") * 11) % 500 + i % 300) > 400).cast("int").alias("label"),
                    F.col("event_type").alias("vulnerability_type"))


PREDICTIONS = """predictions AS (SELECT sample_id, probability, CAST(probability >= 0.5 AS INTEGER) AS prediction, label, vulnerability_type
  FROM (SELECT event_id AS sample_id, CAST((event_id * 37 + user_id * 11) % 500 + 0.5 AS DOUBLE) / 501.0 AS probability,
  CAST((event_id * 37 + user_id * 11) % 500 + event_id % 300 > 400 AS INTEGER) AS label, event_type AS vulnerability_type FROM events))"""


def dependencies(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    version = F.concat_ws(".", (p % 6).cast("string"), (s % 40).cast("string"), (n % 7).cast("string"))
    return li.select(F.when(k % 3 == 0, 0).otherwise(k % 300).alias("project"), pick(PACKAGES, p + s).alias("name"),
                     F.when(p % 29 == 0, "*").when(p % 31 == 0, "latest").when(p % 7 == 0, F.concat(F.lit("^"), version, F.lit("b1"))).otherwise(version).alias("version"),
                     pick(LICENSES, p).alias("license"))


DEPENDENCIES = f"""dependencies AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 300 END AS project,
  {sql_pick(PACKAGES, 'l_partkey + l_suppkey')} AS name, CASE WHEN l_partkey % 29 = 0 THEN '*' WHEN l_partkey % 31 = 0 THEN 'latest'
  WHEN l_partkey % 7 = 0 THEN '^' || v || 'b1' ELSE v END AS version, {sql_pick(LICENSES, 'l_partkey')} AS license
  FROM (SELECT *, CAST(l_partkey % 6 AS VARCHAR) || '.' || CAST(l_suppkey % 40 AS VARCHAR) || '.' || CAST(l_linenumber % 7 AS VARCHAR) AS v FROM lineitem))"""


def requirement_files(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    line = F.replace(pick(REQUIREMENT_LINES, F.col("l_partkey") * 5 + F.col("l_suppkey")), F.lit("@"), (F.col("l_suppkey") % 30).cast("string"))
    rows = li.select(F.col("l_orderkey").alias("file_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")).alias("s"))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))


REQUIREMENT_FILES = f"""requirement_files AS (SELECT l_orderkey AS file_id, string_agg(replace({sql_pick(REQUIREMENT_LINES, 'l_partkey * 5 + l_suppkey')}, '@',
  CAST(l_suppkey % 30 AS VARCHAR)), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY l_orderkey)"""

PATHS = ["/api/v1/scan/code", "/api/v1/ml-scan", "/api/v1/feedback", "/api/v1/health", "/other"]


def requests(spark, sf) -> DataFrame:
    """Requests 0.7 seconds apart, so that windows of a minute are full; a third come from one client."""
    e = read(spark, sf, "events")
    i = F.col("event_id")
    return e.select(i.alias("request_id"), F.timestamp_millis(F.lit(1704067200000) + i * 700 + F.col("user_id") % 7 * 90).alias("ts"),
                    F.when(i % 3 == 0, 0).otherwise(F.col("user_id")).alias("client"), pick(PATHS, F.col("user_id")).alias("path"))


REQUESTS = f"""requests AS (SELECT event_id AS request_id, make_timestamp((1704067200000 + event_id * 700 + user_id % 7 * 90) * 1000) AS ts,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS client, {sql_pick(PATHS, 'user_id')} AS path FROM events)"""


def feedback(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("feedback_id"), "ts",
                    F.when(F.col("event_id") % 19 == 0, None).otherwise(pick(FINDING_CWES, F.col("user_id"))).alias("cwe_id"),
                    F.when(F.col("event_type") == "click", "confirmed").otherwise("false_positive").alias("feedback_type"))


FEEDBACK = f"""feedback AS (SELECT event_id AS feedback_id, ts, CASE WHEN event_id % 19 = 0 THEN NULL ELSE {sql_pick(FINDING_CWES, 'user_id')} END AS cwe_id,
  CASE WHEN event_type = 'click' THEN 'confirmed' ELSE 'false_positive' END AS feedback_type FROM events)"""


def progress(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    total = (F.col("user_id") % 40) * 10
    return e.select((F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))).alias("scan_id"), "ts", F.col("event_id").alias("seq"),
                    pick(["pending", "scanning", "completed", "failed"], F.col("event_id")).alias("status"),
                    (F.col("event_id") % 397).alias("files_scanned"), (total + 3).alias("total_files"))


PROGRESS = f"""progress AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS scan_id, ts, event_id AS seq,
  {sql_pick(["pending", "scanning", "completed", "failed"], 'event_id')} AS status, event_id % 397 AS files_scanned,
  (user_id % 40) * 10 + 3 AS total_files FROM events)"""


def with_tables(*tables: str, body: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + body
