"""Text, version, code and date expressions against plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from vulnlake.functions import code, text, versions
from vulnlake.operators import corpus, evaluation, filters, history, scale
from vulnlake.operators.search import search


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_versions(spark):
    assert column(spark, ["1.2.3", ">=2.0b1", "*", "latest", "^1.10.post1"], versions.parse_version) == [[1, 2, 3], [2, 0, 1], [], [], [1, 10, 1]]


@pytest.mark.parametrize("version, affected, expected", [
    ("4.0.5", "<4.0.6", True), ("4.0.6", "<4.0.6", False), ("*", "<0.1", True), ("2", "<=2", True), ("1.5", ">=1.0,<2.0", True),
    ("2.1", ">=1.0,<2.0", False), ("3", ">2.9", True), ("2.9", "2.9", True), ("1.10", "<1.9", False), ("1", "<1.0", True)])
def test_ranges(spark, version, affected, expected):
    assert column(spark, [version], lambda v: versions.in_range(versions.parse_version(v), F.lit(affected))) == [expected]


def test_requirement_lines(spark):
    lines = ["Django==3.2.1", "a >= 1.0", "# c", "-r x", "", "bare_name", "pkg[extra]==1", "dots.name"]
    got = column(spark, lines, versions.requirement)
    assert [tuple(g) if g else None for g in got] == [("django", "3.2.1"), ("a", "1.0"), None, None, None, ("bare_name", "*"), None, None]


def test_package_manifest(spark):
    body = '{"dependencies": {"A": "^1.0", "b": "2"}, "devDependencies": {"b": "~3", "c": ">=4"}}'
    got = column(spark, [body, "not json", "{}"], versions.package_entries)
    assert sorted(map(tuple, got[0])) == [("a", "1.0"), ("b", "3"), ("c", "4")]
    assert not got[1] and not got[2]


def test_license_first_class_wins(spark):
    assert column(spark, ["LIMITED", "gpl-3.0", "SSPL-1.0", "", None], versions.license_class) == ["permissive", "copyleft", "restrictive", "unknown", "unknown"]


def test_week_labels(spark):
    days = [dt.datetime(2019, 1, 1) + dt.timedelta(days=i) for i in range(366 * 8)]
    frame = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    got = {r.ts: r.w for r in frame.select("ts", history.week_label(F.col("ts")).alias("w")).collect()}
    assert all(got[d] == d.strftime("%Y-%W") for d in days)


def test_strip_covers_unicode_blanks(spark):
    values = ["\u2003 x y \x1f\u3000", "\x85\xa0z\ufeff", "\t\r\n"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_titles(spark):
    ids = ["a.b.sql-injection", "xss2go-fast", "x.JWT-none"]
    assert column(spark, ids, text.title_of_rule_id) == [i.split(".")[-1].replace("-", " ").title() for i in ids]
    assert column(spark, ["eval via os.system() x_y"], text.capitalize_words) == ["Eval Via Os.System() X_y"]


def test_excerpts(spark):
    assert column(spark, ["a\nb\nc\nd"] * 4, lambda v: text.line_excerpt(v, F.lit(1))) == ["a\nb"] * 4
    assert column(spark, ["a\nb\nc\nd"], lambda v: text.line_excerpt(v, F.lit(9))) == [""]


def brute_normal(source):
    names, n = {}, {"func": 0, "var": 0}
    out, i = [], 0
    for m in re.finditer(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b", source):
        word = m.group(1)
        out.append(source[i:m.start()])
        i = m.end()
        if word in code.RESERVED or word.startswith("__"):
            out.append(word)
            continue
        if word not in names:
            kind = "func" if source[m.end():m.end() + 1] == "(" else "var"
            n[kind] += 1
            names[word] = f"{kind}_{n[kind]}"
        out.append(names[word])
    return "".join(out) + source[i:]


def test_normalised_identifiers(spark):
    rng = random.Random(5)
    parts = ["foo", "bar(", "if ", "__init__", " = ", "x1", ")", "(", "'text'", "\n", "def ", "foo(", "é"]
    values = ["".join(rng.choice(parts) for _ in range(20)) for _ in range(50)] + [None]
    got = column(spark, values, lambda v: code.normalize_identifiers(v))
    assert got == [brute_normal(v) if v is not None else None for v in values]


def test_careful_cleaning(spark):
    source = 'x = 1  # note\n"""doc\nstring # a\n"""\ny = "#keep"  # kept\n"""one line"""\n\n\n\n\nz = 2   '
    assert column(spark, [source], lambda v: code.clean_code(v, F.lit("python"))) == ['x = 1\ny = "#keep"  # kept\nz = 2']
    script = "a // b\n/* x\ny */\n\n\n\nc"
    assert column(spark, [script], lambda v: code.clean_code(v, F.lit("javascript"))) == ["a \n\nc"]


def test_simple_cleaning(spark):
    assert column(spark, ["a # b\n\n  # c\nd"], lambda v: code.without_comments(v, F.lit("python"))) == ["a \nd"]
    assert column(spark, ["a // b\n/* c\n */d"], lambda v: code.without_comments(v, F.lit("typescript"))) == ["a \nd"]


def test_tokens_equal_python(spark):
    values = ["x = 'a b' + f(1.5)  # c", "é != b // d\nlet a=[1,2];", "/* gone */ y->z ** 2 @ \"q\""]

    def bare(v):
        v = re.sub(r"//.*$", "", re.sub(r"#.*$", "", v, flags=re.M), flags=re.M)
        return re.sub(r"/\*.*?\*/", "", v, flags=re.S)

    assert column(spark, values, code.tokens_a) == [re.findall(code.TOKENS_A, bare(v)) for v in values]
    assert column(spark, values, code.tokens_b) == [re.findall(code.TOKENS_B, bare(v)) for v in values]


def test_features_equal_python(spark):
    values = ["eval(x)\nimport os\ndef f(): pass\nclass A: pass", "SELECT a FROM b", "x" * 1500]

    def expected(v):
        flags = [1.0 if re.search(p, v, re.I) else 0.0 for p in code.INDICATORS]
        ratios = [min(len(v) / 1000, 1.0), min(v.count("\n") / 100, 1.0), min(v.count("import") / 10, 1.0), min(v.count("def ") / 10, 1.0)]
        return flags + ratios

    assert column(spark, values, code.indicator_features) == [expected(v) for v in values]
    assert column(spark, values, lambda v: code.indicator_features(v, low=F.lower(v))) == [expected(v) for v in values]


def test_paths_and_names(spark):
    inside = column(spark, ["/a/b/c", "/a/bc", "../b/x", "x/../../y", "/a/b"], lambda v: filters.within(v, F.lit("/a/b")))
    assert inside == [True, False, True, False, True]
    assert column(spark, ["a.PY", ".bashrc", "x/y.tar.gz", "none", "a/.hidden.js"], filters.extension) == [".py", "", ".gz", "", ".js"]
    assert column(spark, ["ok.py", "a b-c.js", "x;y", "a/b", "", "é.py", "a" * 256, "q?"], filters.filename_problem) == [
        None, None, "Invalid filename - contains dangerous characters", "Filename cannot contain path separators", "Filename cannot be empty",
        None, "Filename too long (max 255 characters)", "Filename contains invalid characters"]


def test_code_problem(spark):
    values = [None, "  \n", "x", "a\x00b", "\n" * 10_000, "x" * 1_000_001]
    got = column(spark, values, lambda v: filters.code_problem(v, F.lit("Python")))
    assert got == ["Code cannot be empty", "Code cannot be empty", None, "Invalid characters in code", "Code cannot be empty", "Code exceeds maximum size of 976KB"]
    assert column(spark, ["x\n" * 10_000], lambda v: filters.code_problem(v, F.lit("go"))) == ["Code exceeds maximum of 10000 lines"]


def test_labels_from_mixed_fields(spark):
    rows = [("1", None, None, None), ("0", "XSS", None, None), (None, "none", ["x"], None), (None, "XSS", None, None), (None, " ", ["x"], None),
            (None, None, [], True), (None, None, None, True), ("bad", None, None, True)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, label string, t string, v array<string>, b boolean")
    got = [r[0] for r in frame.orderBy("i").select(corpus.binary_label(F.col("label"), F.col("t"), F.col("v"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0]


def test_class_weights(spark):
    frame = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert {r.label: round(r.weight, 3) for r in corpus.class_weights(frame).collect()} == {0: 0.667, 1: 2.0}


def test_report_metrics(spark):
    frame = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "label int, prediction int")
    row = evaluation.binary_metrics(frame).collect()[0]
    assert (round(row.accuracy, 3), round(row.precision, 3), row.recall, row.f1) == (0.333, 0.333, 1.0, 0.5)
    report = {r["class"]: r for r in evaluation.class_report(frame).collect()}
    assert report["macro avg"].f1 == 0.25 and report["1"].support == 1


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    data = [(rng.randrange(2), rng.randrange(8) / 8) for _ in range(200)]
    wins = [(p > n) + 0.5 * (p == n) for y, p in data if y for z, n in data if not z]
    got = evaluation.roc_auc(spark.createDataFrame(data, "label int, probability double")).collect()[0].auc
    assert abs(got - sum(wins) / len(wins)) < 1e-12
    assert evaluation.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, probability double")).collect()[0].auc is None


def test_search_ranks(spark):
    frame = spark.createDataFrame([(1, "eval"), (2, "evaluate"), (3, "my eval"), (4, "none")], "id int, name string")
    assert [(r.id, r.score) for r in search(frame, "EVAL", ["name"], 10, ["id"]).collect()] == [(1, 100), (2, 50), (3, 10)]


def test_row_numbers_with_a_hot_group(spark):
    data = [(0 if i % 3 else i % 7, (i * 7919) % 1009, i) for i in range(1009)]
    got = scale.number_rows(spark.createDataFrame(data, "g int, v int, i int"), [F.col("v"), F.col("i")], "n", ["g"]).collect()
    groups = {}
    for g, v, i in sorted(data):
        groups.setdefault(g, []).append(i)
    assert {(r.g, r.n): r.i for r in got} == {(g, n): i for g, ids in groups.items() for n, i in enumerate(ids, 1)}


def test_exact_split_sizes(spark):
    frame = spark.range(103).withColumnRenamed("id", "k")
    for split in (corpus.split_by_rank(frame, "k"), corpus.split_in_order(frame, ["k"])):
        assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 72, "val": 15, "test": 16}


def test_cap_keeps_the_first_rows(spark):
    frame = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1)], "source string, i int")
    got = corpus.cap_per_source(frame, 5, "i").collect()
    assert sorted(map(tuple, got)) == [("b", 1)] + [("hot", i) for i in range(5)]


def test_encode_and_decode(spark):
    frame = spark.createDataFrame([(1, "a b a c"), (2, "a"), (3, "")], "id int, text string")
    toks = code.tokens_b(F.col("text"))
    vocab = corpus.vocabulary(frame, toks, 6, corpus.SPECIALS_B)
    assert {r.token: r.token_id for r in vocab.collect()} == {"a": 4, "b": 5}
    cut = {r.id: (r.ids, r.mask) for r in corpus.encode(frame, toks, vocab, "id", 5).collect()}
    assert cut == {1: ([2, 4, 5, 4, 1], [1] * 5), 2: ([2, 4, 3, 0, 0], [1, 1, 1, 0, 0]), 3: ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0])}
    kept = {r.id: r.ids for r in corpus.encode(frame, toks, vocab, "id", 5, keep_end=True).collect()}
    assert kept[1] == [2, 4, 5, 4, 3]
    words = corpus.decode(corpus.encode(frame, toks, vocab, "id", 5, keep_end=True), vocab, "id")
    assert {r.id: r.text for r in words.collect()} == {1: "a b a", 2: "a"}


def test_a_small_vocabulary_is_looked_up_without_a_shuffle(spark, tmp_path):
    """Tokens stay in their text; a vocabulary of unknown size is joined and gives the same rows."""
    from vulnlake.operators import corpus

    frame = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "z z"), (5, "<PAD> a"), (6, "a b c a b c")], "id int, text string")
    toks = F.filter(F.split("text", " "), lambda w: w != "")
    small = spark.createDataFrame([("a", 4), ("b", 5), ("<EOS>", 6)], "token string, token_id int").limit(3)
    small.write.parquet(str(tmp_path / "vocab"))
    large = spark.read.parquet(str(tmp_path / "vocab"))
    for keep_end in (False, True):
        for pad in (False, True):
            near, far = (corpus.encode(frame, toks, v, "id", 5, keep_end, pad) for v in (small, large))
            assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
            plan = near._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan
            words, slow = (corpus.decode(near, v, "id") for v in (small, large))
            assert sorted(map(tuple, words.collect())) == sorted(map(tuple, slow.collect()))
            plan = words._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan
