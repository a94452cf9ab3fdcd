"""Rules against Python's own regex engine, and the scan's special cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vulnlake.operators import scan
from vulnlake.rules.code_rules import CODE_RULES, SAFE_PATTERNS
from vulnlake.rules.infra_rules import INFRA_RULES, SECRET_RULES
from vulnlake.rules.model import required_literals, required_marks, rules_frame

# A line per rule number on which the rule fires. 84 needs a line break and never does.
HITS = {
    1: "os.system('ls')", 2: "os.system(f'rm {x}')", 3: 'os.system("ls " + d)', 4: "os.system('ls {}'.format(d))",
    5: "subprocess.run(cmd, shell=True)", 6: "subprocess.Popen(cmd)", 7: "eval (x)", 8: "exec(code)",
    9: "execute('select %s' % x)", 10: 'cursor.execute("select " + name)', 11: 'q = "SELECT * FROM t WHERE a=" + b',
    12: 'q = "INSERT INTO t VALUES " + v', 13: 'q = "UPDATE t SET a=" + v', 14: 'q = "DELETE FROM t WHERE a=" + v',
    15: "q = f'SELECT a FROM {t}'", 16: "q = f'INSERT INTO {t}'", 17: "q = f'UPDATE x {t}'", 18: "q = f'DELETE FROM {t}'",
    19: "q = 'SELECT a FROM {}'.format(t)", 20: "open('../etc/passwd')", 21: "open(base + name)", 22: "p = f'/srv/uploads/{name}'",
    23: "open(f'/srv/{name}')", 24: "open(path, 'r')", 25: "print('DEBUG on')", 26: "print(f'user {u}')", 27: "let key = 1",
    28: "DB_USER = 'postgres'", 29: "user = 'admin'", 30: "passwd = 'hunter2'", 31: "apiKey = 'abcdefgh1'", 32: "token = 'abcdefgh1'",
    33: "db_pass = 'abc1'", 34: "aws_secret = 'abcdefgh1'", 35: "pickle.loads(b)", 36: "pickle.load(f)", 37: "yaml.load(f)",
    38: "marshal.load(f)", 39: "shelve.open('x')", 40: "random.randint(1, 2)", 41: "hashlib.md5(b)", 42: "sha1(b)",
    43: "new Function('a')", 44: "res.send(`hi ${name}`)", 45: "res.send('hi' + name)", 46: "el.innerHTML = x", 47: "el.outerHTML = x",
    48: "document.write(x)", 49: "Math.random()", 50: "if (a == 'b')", 51: "q = 'SELECT a' + b", 52: "q = `DROP ${t}`", 53: "spawn('ls')",
    54: "fs.readFileSync(p)", 55: "requests.get(host + path)", 56: "urllib.request.urlopen(host + path)", 57: "httpx.get(host + path)",
    58: "fetch(url + id)", 59: "axios.get(url + id)", 60: "Access-Control-Allow-Origin: *", 61: "cors({ origin: '*' })", 62: "p = '../../../etc'",
    63: "$where: 'a' + b", 64: "db.find({ a: b })", 65: "render_template_string(t)", 66: "jinja2.Template(a + b)", 67: "logger.info('%s' % a)",
    68: "console.warn(a + b)", 69: "DES (k)", 70: "mode = AES.MODE_ECB", 71: "verify=False", 72: "ssl.PROTOCOL_SSLv3", 73: "debug: true",
    74: "app.run(debug=True)", 75: "SECRET_KEY = 'abc'", 76: "jwt.decode(t, verify=False)", 77: "algorithms=['none']",
    78: "session['p'] = password", 79: "yaml.load(f, Loader=SafeLoader)", 80: "<div dangerouslySetInnerHTML", 81: "JSON.parse(x)",
    82: "time.sleep(3)", 83: "# x TODO fix security", 85: "pip install x", 86: "print(password)", 87: "logger.debug(token)",
    88: "console.log(secret)", 89: "logging.info(api_key)", 90: "catch (e) {}", 91: "except Exception: pass",
}
INFRA_HITS = {
    "DOCKER001": "FROM a:latest", "DOCKER002": "user root", "DOCKER003": "RUN curl x | bash", "DOCKER004": "RUN apt-get install -y x",
    "DOCKER005": "EXPOSE 22", "DOCKER006": "ENV A_TOKEN=x", "DOCKER007": "ADD https://x /y", "DOCKER008": "RUN chmod 777 /a",
    "DOCKER009": "RUN sudo ls", "DOCKER010": "COPY . /app", "COMPOSE001": "privileged: true", "COMPOSE002": "network_mode: host",
    "COMPOSE003": "pid: host", "COMPOSE004": "volumes: /a:/b:rw", "COMPOSE005": "environment: PASSWORD=x", "COMPOSE006": "cap_add: SYS_ADMIN",
    "COMPOSE007": "security_opt: seccomp:unconfined", "K8S001": "privileged: true", "K8S002": "runAsUser: 0", "K8S003": "hostNetwork: true",
    "K8S004": "hostPID: true", "K8S005": "hostIPC: true", "K8S006": "allowPrivilegeEscalation: true", "K8S007": "readOnlyRootFilesystem: false",
    "K8S008": "capabilities: {add: [ALL]}", "K8S009": "image: a:latest", "K8S010": "password: abcdefgh1", "K8S011": "resources: {}",
}
SECRET_HITS = {
    "SECRET001": "api_key = abcdefghijklmnopqrstu", "SECRET002": "Password: abcdefgh", "SECRET003": "-----BEGIN EC PRIVATE KEY-----",
    "SECRET004": "aws_secret_access_key=ABCDEFGHIJKLMNOPQRST", "SECRET005": "ghp_" + "a1" * 18, "SECRET006": "sk-" + "a1" * 24,
    "SECRET007": "Bearer abcdefghijklmnopqrstu", "SECRET008": "mysql://u:p@h", "SECRET009": "xoxb-1234567890", "SECRET010": "twilio_token=abcdefghijklmnopqrstu",
}
MISSES = ["", "x = 1", "return helper(a, b)", "passé = élan", "the quick brown fox"]


def python_hits(rule, line):
    flags = re.IGNORECASE if rule.ignore_case else 0
    return bool(re.search(rule.pattern, line, flags)) and not any(re.search(p, line, flags) for p in rule.negative)


def test_rule_table_shape():
    assert len(CODE_RULES) == 91
    assert len({r.cwe_id for r in CODE_RULES}) == 28
    assert sum("python" in r.languages for r in CODE_RULES) == 70
    assert sum("javascript" in r.languages for r in CODE_RULES) == sum("typescript" in r.languages for r in CODE_RULES) == 45
    by_severity = [sum(r.severity == s for r in CODE_RULES) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]
    assert by_severity == [13, 55, 15, 7, 1]
    assert [len(x) for x in (*INFRA_RULES.values(), SECRET_RULES)] == [10, 7, 11, 10]


def test_every_rule_has_a_hit():
    for rule in CODE_RULES:
        if rule.number != 84:
            assert python_hits(rule, HITS[rule.number]), rule.number
    for rules, hits in ((sum(INFRA_RULES.values(), ()), INFRA_HITS), (SECRET_RULES, SECRET_HITS)):
        for rule in rules:
            assert python_hits(rule, hits[rule.rule_id]), rule.rule_id


@pytest.mark.parametrize("unicode", [False, True])
def test_all_rules_on_all_lines_equal_python(spark, unicode):
    """Every rule on every line of the pool, needles and marks included."""
    lines = list(HITS.values()) + list(INFRA_HITS.values()) + list(SECRET_HITS.values()) + MISSES
    lines += [line.upper() for line in lines] + [line + "\r" for line in lines]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    for rules in (CODE_RULES, *INFRA_RULES.values(), SECRET_RULES):
        flagged = scan.with_marks(frame, rules, unicode)
        found = flagged.select("n", scan.all_rules(rules, F.col("line"), F.col("_low"), unicode).alias("r")).collect()
        got = {(r.n, x) for r in found for x in r.r}
        assert got == {(n, r.number) for n, line in enumerate(lines) for r in rules if python_hits(r, line)}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([r for r in CODE_RULES if r.number != 84]), st.text(alphabet="aeSkıſ ('\"=+%{}$:.,*x1", max_size=12), st.text(alphabet=" )'\"}k;", max_size=6))
def test_needles_and_marks_are_necessary(rule, before, after):
    line = before + HITS[rule.number] + after
    if re.search(rule.pattern, line, re.IGNORECASE):
        low = line.lower().replace("ſ", "s").replace("ı", "i")
        assert not rule.needles or any(n in low for n in rule.needles)
        assert all(any(m in line for m in marks) for marks in rule.marks)


def test_required_texts_of_patterns():
    assert required_literals(r"eval\s*\(") == ("eval",)
    assert required_literals(r"(foo|barbaz)x?") == ("barbaz", "foo")
    assert required_literals(r"\w+") == ()
    assert required_literals(r"a?b*") == ()
    assert ("(",) in required_marks(r"eval\s*\(")
    assert ('"', "'") in required_marks(r"[\'\"]x")


def scan_text(spark, text, language="python", **options):
    files = spark.createDataFrame([(1, language, text)], "file_id int, language string, text string")
    return [(r.start_line, r.rule_no, r.severity) for r in scan.scan_code(files, **options).orderBy("start_line").collect()]


def test_highest_severity_wins_the_line(spark):
    assert scan_text(spark, 'os.system("ls " + d)') == [(1, 3, "CRITICAL")]


def test_safe_construct_silences_the_file(spark):
    assert scan_text(spark, "eval(x)\ny = 1\ns = secrets.token_hex()") == []
    assert scan_text(spark, "eval(x)\ny = 1") == [(1, 7, "CRITICAL")]


def test_anchored_safe_construct_counts_per_line_too(spark):
    assert scan_text(spark, "import os\nprint('token here')\neval(x)") == [(3, 7, "CRITICAL")]


def test_comments_are_skipped(spark):
    assert scan_text(spark, "# eval(x)\n  '''eval(x)'''\n\teval(x)") == [(3, 7, "CRITICAL")]
    assert scan_text(spark, "// eval(x)\n * eval(x)\n/* eval(x)", "javascript") == []


def test_negative_pattern_leaves_other_rules(spark):
    numbers = [r.rule_no for r in scan.match_code(spark.createDataFrame(
        [(1, "python", "yaml.load(f, Loader=SafeLoader)")], "file_id int, language string, text string")).collect()]
    assert numbers == [79]


def test_loose_console_rule_matches_bare_words(spark):
    assert scan_text(spark, "let monkey = 1", "typescript") == [(1, 27, "MEDIUM")]


def test_rule_with_line_break_never_fires(spark):
    assert scan_text(spark, "@app.route('/x', methods=['POST'])\ndef f():") == []


def test_unknown_language_has_no_rules(spark):
    assert scan_text(spark, "eval(x)", "java") == []


def test_rule_id_snippet_and_lines(spark):
    files = spark.createDataFrame([(1, "python", "a\n\n   eval(x)  ")], "file_id int, language string, text string")
    row = scan.scan_code(files).collect()[0]
    assert (row.rule_id, row.code_snippet, row.start_line, row.end_line, row.cwe_id) == (
        "code_injection_via_eval()", "eval(x)", 3, 3, "CWE-94")


def test_best_per_line_equals_fused_scan(spark):
    text = "\n".join(HITS[n] for n in sorted(HITS))
    files = spark.createDataFrame([(i, lang, text) for i, lang in enumerate(SAFE_PATTERNS)], "file_id int, language string, text string")
    fused = scan.scan_code(files, safe_patterns={}).select("file_id", "start_line", "rule_no")
    table = scan.best_per_line(scan.match_code(files, safe_patterns={}), ["file_id"]).select("file_id", "start_line", "rule_no")
    assert sorted(fused.collect()) == sorted(table.collect())
    assert fused.count() > 100


def test_rule_table_scan(spark):
    lines = spark.createDataFrame([(1, "python", "eval(x)"), (1, "python", "yaml.load(f, Loader=SafeLoader)"), (2, "javascript", "eval(x)")],
                                  "file_id int, language string, line string")
    chosen = [r for r in CODE_RULES if r.number in (7, 37, 8)]
    table = rules_frame(spark, chosen).select("rule_id", "pattern", "severity", "cwe_id", "languages", "negative", "needles")
    for rules in (table, table.drop("needles")):
        got = scan.scan_with_rule_table(lines, rules).select("file_id", "language", "rule_id").collect()
        assert sorted(map(tuple, got)) == [(1, "python", "code_injection_via_eval()"), (2, "javascript", "code_injection_via_eval()")]


def test_rule_table_scan_equals_every_pattern_on_every_line(spark):
    """Random rules: several needles, short and missing ones, negatives, two languages; and lines of all lengths."""
    rng = random.Random(6)
    words = ["eval", "exec", "load", "ab", "x==y", "é(", "password", "open", "a.b"]
    rules = []
    for i in range(60):
        own = rng.sample(words, rng.randint(1, 3))
        pattern = "|".join(re.escape(w) for w in own) + ("" if i % 5 else r"|\d\d")
        rules.append((f"r{i}", pattern, "HIGH", None, rng.choice([["python"], ["python", "java"]]), [re.escape(rng.choice(words))] if i % 4 == 0 else None,
                      [] if i % 5 == 0 else own))
    lines = [(i, rng.choice(["python", "java", "go"]), rng.choice(["", " ", "\t"]).join(rng.choice([*words, "Zz", "12", "EVAL"]) for _ in range(rng.choice([0, 1, 3, 8]))))
             for i in range(300)]
    lines.append((999, "python", "y" * 50000 + "pass" + "word" + "z" * 50000))
    table = spark.createDataFrame(rules, "rule_id string, pattern string, severity string, cwe_id string, languages array<string>, negative array<string>, needles array<string>")
    frame = spark.createDataFrame(lines, "id int, language string, line string").repartition(3)
    want = {(i, r[0]) for i, language, line in lines for r in rules if language in r[4] and re.search(r[1], line, re.I)
            and not any(re.search(n, line, re.I) for n in r[5] or [])}
    got = [(r.id, r.rule_id) for r in scan.scan_with_rule_table(frame, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert (999, next(r[0] for r in rules if "password" in r[6] and not r[5])) in want
    assert scan.scan_with_rule_table(frame, table.limit(0)).collect() == []


def test_lines_are_not_shuffled_by_a_rule_table(spark):
    table = rules_frame(spark, CODE_RULES).select("rule_id", "pattern", "severity", "cwe_id", "languages", "negative", "needles")
    lines = spark.range(1000).select("id", F.lit("python").alias("language"), F.lit("eval(x)").alias("line"))
    plan = scan.scan_with_rule_table(lines, table)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("BroadcastHashJoin")[0] + plan.split("Range (")[0]
    assert "Exchange hashpartitioning(id" not in plan and "BroadcastHashJoin" in main


def test_infra_scan_and_absence(spark):
    files = spark.createDataFrame([
        (1, "Dockerfile", "FROM a:latest\nRUN ls"), (2, "compose.yml", "pid: host"), (3, "x.yaml", "kind: Pod\nhostPID: true"),
        (4, "main.tf", "privileged: true\napi_key = abcdefghijklmnopqrstu")], "file_id int, filename string, text string")
    typed = files.withColumn("infra_type", scan.infra_type(F.col("filename"), F.col("text")))
    got = scan.scan_infra(typed.select("file_id", "infra_type", "text")).select("file_id", "line_no", "rule_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "DOCKER001"), (2, 1, "COMPOSE003"), (3, 2, "K8S004"), (4, 2, "SECRET001")]
    absent = scan.scan_absent(files.filter("file_id = 1").select("file_id", "text")).select("rule_id").collect()
    assert sorted(r.rule_id for r in absent) == ["DOCKER_HEALTH", "DOCKER_USER"]


def test_secret_scan_skips(spark):
    files = spark.createDataFrame([(1, "a.py", "# password: abcdefgh\npassword: abcdefgh"), (2, "b.lock", "password: abcdefgh")],
                                  "file_id int, filename string, text string")
    got = scan.scan_secrets(files, skip_comments=True, filename="filename").select("file_id", "line_no").collect()
    assert list(map(tuple, got)) == [(1, 2)]
