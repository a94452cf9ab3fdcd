"""Queries of corpus preparation, evaluation, votes, graphs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import code as code_fn
from vulnlake.operators import corpus, evaluation, graph, lookups, models, votes
from vulnlake.operators.scale import kept, number_rows
from vulnlake.plans import tables as t
from vulnlake.plans.registry import query
from vulnlake.plans.report_queries import SQL_GROUPS
from vulnlake.plans.scan_queries import sql_strip
from vulnlake.plans.tables import q, read, with_tables
from vulnlake.sources.corpora import unify_any, unify_functions, unify_safe

# ---------------------------------------------------------------- union, labels


@query("u1_corpus_union", """SELECT 'documents' AS corpus, doc_id AS id, text AS code, source, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL
  SELECT 'benchmark', item_id, text, NULL, NULL FROM benchmark UNION ALL SELECT 'conversations', conv_id, text, NULL, role FROM conversations""")
def corpus_union(spark, sf):
    docs = read(spark, sf, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), F.col("text").alias("code"), "source")
    bench = read(spark, sf, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"), F.col("text").alias("code"))
    talks = read(spark, sf, "conversations").select(F.lit("conversations").alias("corpus"), F.col("conv_id").alias("id"), F.col("text").alias("code"), "role")
    return corpus.union_samples(docs, bench, talks)


@query("s20_fix_pairs", with_tables(t.SAMPLES, body="""SELECT sample_id, label, vulnerability_type, language, code FROM (
  SELECT sample_id, code, 1 AS label, coalesce(vulnerability_type, 'unknown') AS vulnerability_type, CASE sample_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' ELSE 'javascript' END AS language FROM samples
  UNION ALL SELECT sample_id, code[sample_id % 70 + 1:], 0, 'none', CASE sample_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' ELSE 'javascript' END FROM samples) WHERE length(code) > 20"""))
def fix_pairs(spark, sf):
    s = t.samples(spark, sf)
    i = F.col("sample_id")
    fixes = s.select("sample_id", F.col("code").alias("func_before"), F.expr("substring(code, CAST(sample_id % 70 + 1 AS int))").alias("func_after"),
                     F.col("vulnerability_type").alias("cwe_id"), t.pick(["PY", "cpp", "xyz"], i).alias("extension"))
    return corpus.fix_pairs(fixes, "fixes").select("sample_id", "label", "vulnerability_type", "language", "code")


@query("z18_binary_labels", with_tables(t.SAMPLES, body="""SELECT sample_id, CAST(CASE WHEN sample_id % 4 = 0 THEN label WHEN vulnerability_type IS NOT NULL AND trim(vulnerability_type) <> '' THEN CASE WHEN lower(vulnerability_type) = 'xxe' THEN 1 ELSE 1 END
  WHEN sample_id % 2 = 0 THEN CASE WHEN sample_id % 6 > 0 THEN 1 ELSE 0 END WHEN sample_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM samples"""))
def binary_labels(spark, sf):
    i = F.col("sample_id")
    label = F.when(i % 4 == 0, F.col("label").cast("string"))
    listed = F.when(i % 2 == 0, F.when(i % 6 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return t.samples(spark, sf).select("sample_id", corpus.binary_label(label, F.col("vulnerability_type"), listed, i % 3 == 0).alias("label"))


@query("r7_weak_labels", with_tables(t.CODE_FILES, body=f"""SELECT file_id, w.cwe_id, CASE WHEN w.cwe_id = 0 THEN 'A05' ELSE g.owasp_category END AS owasp_category, w.cwe_id <> 0 AS is_vulnerable FROM (SELECT file_id,
  CASE WHEN contains(text, 'eval(') OR contains(text, 'exec(') THEN 95 WHEN regexp_matches(text, {q("password" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + "']")}, 'i') THEN 798
  WHEN contains(text, 'hashlib.md5') OR contains(text, 'hashlib.sha1') THEN 327 ELSE 0 END AS cwe_id FROM code_files WHERE length(text) BETWEEN 100 AND 10000) w
  LEFT JOIN {SQL_GROUPS} ON g.cwe_id = w.cwe_id WHERE w.cwe_id = 0 OR g.owasp_category IS NOT NULL"""))
def weak_labels(spark, sf):
    return corpus.weak_labels(t.code_files(spark, sf).select("file_id", "text")).select("file_id", "cwe_id", "owasp_category", "is_vulnerable")


@query("s5_labelled_functions", with_tables(t.CODE_FILES, body=f"""SELECT file_id, f.cwe_id, f.language, coalesce(g.owasp_category, 'A05') AS owasp_category, target <> 0 AS is_vulnerable FROM (SELECT file_id, [22, 79, 0, 9999][1 + file_id % 4] AS cwe_id, file_id % 2 AS target,
  CASE WHEN contains(text, 'def ') OR contains(text, 'import ') OR contains(text, 'print(') THEN 'python' WHEN contains(text, 'function ') OR contains(text, 'const ') OR contains(text, 'var ') THEN 'javascript' ELSE 'unknown' END AS language
  FROM code_files WHERE length(text) > 50 AND length(text) < 5000) f LEFT JOIN {SQL_GROUPS} ON g.cwe_id = f.cwe_id WHERE f.language <> 'unknown'"""))
def labelled_functions(spark, sf):
    i = F.col("file_id")
    rows = t.code_files(spark, sf).select("file_id", F.col("text").alias("code"), (i % 2).alias("target"), t.pick([22, 79, 0, 9999], i).alias("cwe_id"))
    return corpus.labelled_functions(rows).select("file_id", "cwe_id", "language", "owasp_category", "is_vulnerable")


@query("s9_harmonised_functions", with_tables(t.CODE_FILES, body=f"""SELECT 'c' AS language, file_id % 2 AS label, CASE WHEN file_id % 2 = 1 THEN 'vulnerability' ELSE 'safe' END AS vulnerability_type, 'devign' AS source, text AS code FROM code_files
  UNION ALL SELECT 'python', 0, 'safe', 'safe_code', text FROM code_files WHERE length(text) >= 50 UNION ALL SELECT NULL, file_id % 2, NULL, 'defects', text FROM code_files WHERE text <> ''"""))
def harmonised_functions(spark, sf):
    f = t.code_files(spark, sf)
    a = unify_functions(f.select(F.col("text").alias("func"), (F.col("file_id") % 2).alias("target"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("commit_id")), "devign", quality=False)
    b = unify_safe(f, F.col("text"), "safe_code")
    c = unify_any(f.select("text", (F.col("file_id") % 2).alias("target")), "defects")
    return corpus.union_samples(a.drop("metadata"), b, c)


@query("s10_group_labelled", with_tables(t.SAMPLES, body=f"""SELECT sample_id, s.cwe_id, g.owasp_category FROM (SELECT sample_id, CASE WHEN sample_id % 7 = 6 THEN 79 ELSE cwe_id END AS cwe_id FROM samples) s JOIN {SQL_GROUPS} ON g.cwe_id = s.cwe_id"""))
def group_labelled(spark, sf):
    from vulnlake.sources.corpora import group_labelled as load
    rows = t.samples(spark, sf).withColumn("target", F.col("label")).withColumn("cwe_id", F.when(F.col("sample_id") % 7 != 6, F.col("cwe_id")))
    return load(rows).select("sample_id", "cwe_id", "owasp_category")


# ----------------------------------------------------------- duplicates, splits


@query("w7_first_of_prefix", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text[1:200]")
def first_of_prefix(spark, sf):
    return corpus.first_of_prefix(read(spark, sf, "documents").select("doc_id", F.col("text").alias("code")), "doc_id").select("doc_id")


@query("u3_distinct_texts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_texts(spark, sf):
    return corpus.distinct_texts(read(spark, sf, "documents").select("doc_id", F.col("text").alias("code")), "doc_id").select("doc_id")


@query("z12_fingerprints", "SELECT doc_id, sha256(regexp_replace(text, '\\s+', ' ', 'g')) AS fingerprint FROM documents")
def fingerprints(spark, sf):
    return read(spark, sf, "documents").select("doc_id", code_fn.fingerprint(F.col("text")).alias("fingerprint"))


def sql_hash(text):
    return f"CAST('0x' || md5({text})[1:8] AS BIGINT)"


SQL_SPLIT = f"""SELECT doc_id, fingerprint, CASE WHEN p < 7000 THEN 'train' WHEN p < 8500 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, fingerprint, {sql_hash('fingerprint')} % 10000 AS p
  FROM (SELECT doc_id, sha256(regexp_replace(text, '\\s+', ' ', 'g')) AS fingerprint FROM documents))"""


def _hash_split(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", code_fn.fingerprint(F.col("text")).alias("fingerprint"))
    return corpus.split_by_hash(rows)


@query("w10_hash_split", f"SELECT doc_id, split FROM ({SQL_SPLIT})")
def hash_split(spark, sf):
    return _hash_split(spark, sf).select("doc_id", "split")


SQL_RANK_SPLIT = """SELECT {id}, CASE WHEN n <= floor(m * 0.7) THEN 'train' WHEN n <= floor(m * 0.7) + floor(m * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {id}, row_number() OVER (ORDER BY {order}) AS n, count(*) OVER () AS m FROM {source})"""


@query("w10_shuffled_split", SQL_RANK_SPLIT.format(id="doc_id", order=sql_hash("'0:' || CAST(doc_id AS VARCHAR)") + ", doc_id", source="documents"))
def shuffled_split(spark, sf):
    return corpus.split_by_rank(read(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("w10_ordered_split", SQL_RANK_SPLIT.format(id="doc_id", order="source, doc_id", source="documents"))
def ordered_split(spark, sf):
    return corpus.split_in_order(read(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "split")


@query("l9_shuffle", f"SELECT doc_id FROM documents ORDER BY {sql_hash(chr(39) + '7:' + chr(39) + ' || CAST(doc_id AS VARCHAR)')}, doc_id")
def shuffled(spark, sf):
    return corpus.shuffle_samples(read(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("l10_cap_per_source", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20")
def cap_per_source(spark, sf):
    return corpus.cap_per_source(read(spark, sf, "documents").select("doc_id", "source"), 20, "doc_id")


@query("x13_u5_split_overlap", f"""SELECT doc_id FROM ({SQL_RANK_SPLIT.format(id="doc_id, fingerprint", order="doc_id", source="(SELECT doc_id, sha256(regexp_replace(text, '\\s+', ' ', 'g')) AS fingerprint FROM documents)")})
  WHERE split = 'test' AND fingerprint IN (SELECT fingerprint FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS m, sha256(regexp_replace(text, '\\s+', ' ', 'g')) AS fingerprint FROM documents) WHERE n <= floor(m * 0.7))""")
def split_overlap(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", code_fn.fingerprint(F.col("text")).alias("fingerprint"))
    split = corpus.split_in_order(rows, ["doc_id"])
    return lookups.split_overlap(split.filter("split = 'test'"), split.filter("split = 'train'")).select("doc_id")


@query("x13_no_overlap_after_hash_split", f"""SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM (SELECT DISTINCT fingerprint, split FROM ({SQL_SPLIT})) a
  JOIN (SELECT DISTINCT fingerprint, split FROM ({SQL_SPLIT})) b ON a.fingerprint = b.fingerprint GROUP BY ALL""")
def no_overlap(spark, sf):
    rows = _hash_split(spark, sf).select("fingerprint", "split").distinct()
    other = rows.select("fingerprint", F.col("split").alias("right_split"))
    return rows.withColumnRenamed("split", "left_split").join(other, "fingerprint").groupBy("left_split", "right_split").agg(F.count("*").alias("shared"))


@query("x14_changed_files", with_tables(t.CODE_FILES, body="SELECT file_id, path FROM code_files WHERE file_id % 5 IN (0, 1)"))
def changed_files(spark, sf):
    """Files against an earlier state in which a fifth was missing and a fifth had other content."""
    now = t.code_files(spark, sf).select("file_id", "path", "text")
    i = F.col("file_id")
    before = now.filter(i % 5 != 0).withColumn("text", F.when(i % 5 == 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    return lookups.changed_files(now, lookups.file_digests(before)).select("file_id", "path")


@query("p15_s3_language_counts", with_tables(t.SAMPLES, body="SELECT lower(language) AS language, count(*) AS samples, CAST(sum(label) AS BIGINT) AS vulnerable FROM samples GROUP BY 1"))
def language_counts(spark, sf):
    return t.samples(spark, sf).groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("samples"), F.sum("label").alias("vulnerable"))


# ------------------------------------------------------------- cleaning, tokens

CLEAN_PY = f"array_to_string(list_filter(string_split(regexp_replace(text, '#[^\\n]*', '', 'g'), chr(10)), lambda x: {sql_strip('x')} <> ''), chr(10))"
CLEAN_JS = f"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs'), chr(10)), lambda x: {sql_strip('x')} <> ''), chr(10))"


@query("z7_without_comments", with_tables(t.CODE_FILES, body=f"SELECT file_id, CASE WHEN language = 'python' THEN {CLEAN_PY} ELSE {CLEAN_JS} END AS code FROM code_files"))
def without_comments(spark, sf):
    return t.code_files(spark, sf).select("file_id", code_fn.without_comments(F.col("text"), F.col("language")).alias("code"))


@query("z7_careful_cleaning")
def careful_cleaning(spark, sf):
    return t.code_files(spark, sf).select("file_id", code_fn.clean_code(F.col("text"), F.col("language")).alias("code"))


SQL_RESERVED = "(" + ", ".join(q(w) for w in sorted(code_fn.RESERVED)) + ")"
SQL_PREPARED = f"""cleaned AS (SELECT file_id, language, code FROM (SELECT file_id, language, CASE WHEN language = 'python' THEN {CLEAN_PY} WHEN language IN ('javascript', 'typescript') THEN {CLEAN_JS} ELSE '' END AS code FROM code_files) WHERE length(code) BETWEEN 50 AND 5000),
parted AS (SELECT *, regexp_extract_all(code, {q(code_fn.IDENTIFIER)}) AS w, string_split_regex(code, {q(code_fn.IDENTIFIER)}) AS g FROM cleaned),
kinds AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN {SQL_RESERVED} OR starts_with(w[i], '__') THEN 'kept' WHEN starts_with(g[i + 1], '(') THEN 'func' ELSE 'var' END) AS k FROM parted),
named AS (SELECT *, list_transform(list_filter(range(1, len(w) + 1), lambda i: k[i] = 'func' AND list_position(w, w[i]) = i), lambda i: w[i]) AS f,
  list_transform(list_filter(range(1, len(w) + 1), lambda i: k[i] = 'var' AND list_position(w, w[i]) = i), lambda i: w[i]) AS v FROM kinds)"""


@query("z8_prepared_samples", with_tables(t.CODE_FILES, SQL_PREPARED, body="""SELECT file_id, language, g[1] || array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(f, w[i]) THEN 'func_' || list_position(f, w[i])
  WHEN list_contains(v, w[i]) THEN 'var_' || list_position(v, w[i]) ELSE w[i] END || g[i + 1]), '') AS code FROM named"""))
def prepared_samples(spark, sf):
    return corpus.prepare(t.code_files(spark, sf).select("file_id", "language", F.col("text").alias("code")))


SQL_UNCOMMENTED = "regexp_replace(regexp_replace(regexp_replace(text, '#[^\\n]*', '', 'g'), '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs')"


@query("z9_z10_tokens", with_tables(t.CODE_FILES, body=f"""SELECT file_id, array_to_string(regexp_extract_all({SQL_UNCOMMENTED}, {q(code_fn.TOKENS_A)}), ' ') AS tokens_a,
  array_to_string(regexp_extract_all({SQL_UNCOMMENTED}, {q(code_fn.TOKENS_B)}), ' ') AS tokens_b FROM code_files"""))
def tokens(spark, sf):
    text = F.col("text")
    return t.code_files(spark, sf).select("file_id", F.array_join(code_fn.tokens_a(text, False), " ").alias("tokens_a"), F.array_join(code_fn.tokens_b(text, False), " ").alias("tokens_b"))


SQL_TOKENS = f"(SELECT file_id, unnest(regexp_extract_all({SQL_UNCOMMENTED}, {q(code_fn.TOKENS_A)})) AS token FROM code_files)"
SQL_VOCAB = f"(SELECT token, count, row_number() OVER (ORDER BY count DESC, token) + 3 AS token_id FROM (SELECT token, count(*) AS count FROM {SQL_TOKENS} GROUP BY token) ORDER BY count DESC, token LIMIT 9996)"


@query("a21_vocabulary", with_tables(t.CODE_FILES, body=f"SELECT * FROM {SQL_VOCAB}"))
def vocabulary(spark, sf):
    return corpus.vocabulary(t.code_files(spark, sf), code_fn.tokens_a(F.col("text"), False), 10_000)


@query("a21_full_vocabulary", with_tables(t.CODE_FILES, body=f"SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT token FROM {SQL_TOKENS})"))
def full_vocabulary(spark, sf):
    return corpus.full_vocabulary(t.code_files(spark, sf), code_fn.tokens_a(F.col("text"), False))


@query("z11_encoded", with_tables(t.CODE_FILES, f"vocab AS (SELECT * FROM {SQL_VOCAB})", f"toks AS (SELECT file_id, regexp_extract_all({SQL_UNCOMMENTED}, {q(code_fn.TOKENS_A)}) AS l FROM code_files)", body="""
SELECT file_id, array_to_string(list_resize(ids, 512, 0), ' ') AS ids, least(len(ids), 512) AS used FROM (SELECT t.file_id, [2] || coalesce(e.ids, []) || [3] AS ids FROM toks t LEFT JOIN
  (SELECT file_id, list(coalesce(v.token_id, 1) ORDER BY p) AS ids FROM (SELECT file_id, unnest(l) AS token, unnest(generate_series(1, len(l))) AS p FROM toks) x LEFT JOIN vocab v ON v.token = x.token GROUP BY file_id) e ON e.file_id = t.file_id)"""))
def encoded(spark, sf):
    files = t.code_files(spark, sf)
    toks = code_fn.tokens_a(F.col("text"), False)
    out = corpus.encode(files, toks, corpus.vocabulary(files, toks, 10_000), "file_id", 512)
    return out.select("file_id", F.array_join("ids", " ").alias("ids"), F.size(F.array_remove("mask", F.lit(0))).cast("bigint").alias("used"))


@query("z11_decoded", with_tables(t.CODE_FILES, f"toks AS (SELECT file_id, regexp_extract_all({SQL_UNCOMMENTED}, {q(code_fn.TOKENS_B)}) AS l FROM code_files)",
                                  "vocab AS (SELECT token FROM (SELECT token, count(*) AS n FROM (SELECT unnest(l) AS token FROM toks) GROUP BY token) ORDER BY n DESC, token LIMIT 9996)", body="""
SELECT file_id, string_agg(coalesce(v.token, '<UNK>'), ' ' ORDER BY p) AS text FROM (SELECT file_id, unnest(l[1:510]) AS token, unnest(generate_series(1, least(len(l), 510))) AS p FROM toks) x LEFT JOIN vocab v ON v.token = x.token GROUP BY file_id"""))
def decoded(spark, sf):
    files = t.code_files(spark, sf)
    toks = code_fn.tokens_b(F.col("text"), False)
    vocab = spark.createDataFrame(corpus.vocabulary(files, toks, 10_000, corpus.SPECIALS_B).toArrow())  # counted once, used twice
    return corpus.decode(corpus.encode(files, toks, vocab, "file_id", 512, keep_end=True, pad=False), vocab, "file_id")


# ------------------------------------------------------------------- statistics


@query("a18_label_stats", with_tables(t.SAMPLES, body="""SELECT source, n AS total, v AS vulnerable, n - v AS safe, round(v * 100 / CAST(n AS DOUBLE), 6) AS vulnerable_percent, round((n - v) * 100 / CAST(n AS DOUBLE), 6) AS safe_percent,
  abs(v - (n - v)) / CAST(n AS DOUBLE) < 0.1 AS balanced FROM (SELECT source, count(*) AS n, count(*) FILTER (label = 1) AS v FROM samples GROUP BY source)"""))
def label_stats(spark, sf):
    rows = corpus.label_stats(t.samples(spark, sf), ["source"])
    return rows.withColumn("vulnerable_percent", F.round("vulnerable_percent", 6)).withColumn("safe_percent", F.round("safe_percent", 6))


@query("a18_language_shares", with_tables(t.SAMPLES, body="SELECT language, count(*) AS count, round(count(*) * 100 / CAST((SELECT count(*) FROM samples) AS DOUBLE), 6) AS percent FROM samples GROUP BY 1"))
def language_shares(spark, sf):
    return corpus.share_by(t.samples(spark, sf), "language").withColumn("percent", F.round("percent", 6))


@query("a18_top_types", with_tables(t.SAMPLES, body="""SELECT vulnerability_type, n AS count, round(n * 100 / CAST(m AS DOUBLE), 6) AS percent FROM (SELECT coalesce(nullif(vulnerability_type, ''), 'Unknown') AS vulnerability_type, count(*) AS n,
  sum(count(*)) OVER () AS m FROM samples WHERE label = 1 GROUP BY 1) ORDER BY n DESC, vulnerability_type LIMIT 5"""))
def top_types(spark, sf):
    return corpus.top_types_of_vulnerable(t.samples(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("a19_category_distribution", with_tables(t.SAMPLES, body=f"SELECT owasp_category, count(*) AS count FROM samples s JOIN {SQL_GROUPS} ON g.cwe_id = s.cwe_id GROUP BY 1 ORDER BY 1"))
def category_distribution(spark, sf):
    return corpus.category_distribution(lookups.with_cwe_group(t.samples(spark, sf).select("cwe_id")))


@query("a20_class_weights", with_tables(t.SAMPLES, body="SELECT label, n AS count, round(m / CAST(k * n AS DOUBLE), 6) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS m, count(*) OVER () AS k FROM samples GROUP BY 1)"))
def class_weights(spark, sf):
    return corpus.class_weights(t.samples(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("a20_positive_weight", with_tables(t.SAMPLES, body="SELECT v AS vulnerable, s AS safe, round(CASE WHEN s > v AND v > 0 THEN s / CAST(v AS DOUBLE) END, 6) AS pos_weight FROM (SELECT count(*) FILTER (label = 1) AS v, count(*) FILTER (label <> 1) AS s FROM samples)"))
def positive_weight(spark, sf):
    return corpus.positive_weight(t.samples(spark, sf)).withColumn("pos_weight", F.round("pos_weight", 6))


@query("a37_split_readiness", f"SELECT split, count(*) AS count, round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS percent, sum(count(*)) OVER () >= 3000 AS ready FROM ({SQL_SPLIT}) GROUP BY split")
def split_readiness(spark, sf):
    return corpus.split_readiness(_hash_split(spark, sf)).withColumn("percent", F.round("percent", 6))


# ------------------------------------------------------------------- evaluation

SQL_CONFUSION = "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label <> 1 AND prediction <> 1) AS tn, count(*) FILTER (label = 1 AND prediction <> 1) AS fn"


def sql_ratio(a, b):
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / CAST({b} AS DOUBLE) END)"


def _rounded(frame, *names):
    for name in names:
        frame = frame.withColumn(name, F.round(name, 6))
    return frame


@query("a22_a27_binary_metrics", with_tables(t.PREDICTIONS, body=f"""SELECT vulnerability_type, tp, fp, tn, fn, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
  round({sql_ratio('2 * p * r', '(p + r)')}, 6) AS f1, round({sql_ratio('fp', '(fp + tn)')}, 6) AS fpr, round({sql_ratio('fn', '(fn + tp)')}, 6) AS fnr
  FROM (SELECT *, {sql_ratio('tp', '(tp + fp)')} AS p, {sql_ratio('tp', '(tp + fn)')} AS r FROM (SELECT vulnerability_type, {SQL_CONFUSION} FROM predictions GROUP BY 1))"""))
def binary_metrics(spark, sf):
    return _rounded(evaluation.binary_metrics(t.predictions(spark, sf), ["vulnerability_type"]), "accuracy", "precision", "recall", "f1", "fpr", "fnr")


@query("a23_class_report", with_tables(t.PREDICTIONS, f"""per AS (SELECT class, {sql_ratio('tp', 'pr')} AS p, {sql_ratio('tp', 'su')} AS r, su FROM (
  SELECT CAST(k AS VARCHAR) AS class, count(*) FILTER (label = k AND prediction = k) AS tp, count(*) FILTER (prediction = k) AS pr, count(*) FILTER (label = k) AS su FROM predictions, (VALUES (0), (1)) v(k) GROUP BY k))""",
    f"full_rows AS (SELECT class, p, r, {sql_ratio('2 * p * r', '(p + r)')} AS f, su FROM per)", body="""
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, su AS support FROM full_rows
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(su) AS BIGINT) FROM full_rows
  UNION ALL SELECT 'weighted avg', round(sum(p * su) / sum(su), 6), round(sum(r * su) / sum(su), 6), round(sum(f * su) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM full_rows"""))
def class_report(spark, sf):
    return _rounded(evaluation.class_report(t.predictions(spark, sf)), "precision", "recall", "f1")


@query("a24_roc_auc", with_tables(t.PREDICTIONS, body="""SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM (
  SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r, count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label <> 1) OVER () AS n FROM predictions) GROUP BY p, n"""))
def roc_auc(spark, sf):
    return _rounded(evaluation.roc_auc(t.predictions(spark, sf)), "auc")


@query("a25_roc_curve", with_tables(t.PREDICTIONS, body="""SELECT round(probability, 6) AS threshold, round(sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE), 6) AS tpr, round(sum(n) OVER w / CAST(sum(n) OVER () AS DOUBLE), 6) AS fpr
  FROM (SELECT probability, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM predictions GROUP BY 1) WINDOW w AS (ORDER BY probability DESC)"""))
def roc_curve(spark, sf):
    return _rounded(evaluation.roc_curve(t.predictions(spark, sf)), "threshold", "tpr", "fpr")


@query("x12_a26_detection_by_type", with_tables(t.PREDICTIONS, body="""SELECT vulnerability_type, round(avg(prediction), 6) AS detection_rate, count(*) AS num_samples, round(avg(probability), 6) AS avg_confidence FROM predictions WHERE label = 1 GROUP BY 1"""))
def detection_by_type(spark, sf):
    p = t.predictions(spark, sf)
    out = evaluation.detection_by_type(p.select("sample_id", "label", "vulnerability_type"), p.select("sample_id", "prediction", "probability"))
    return _rounded(out, "detection_rate", "avg_confidence")


@query("a34_temperature", with_tables(t.PREDICTIONS, body="""SELECT temperature, round(loss, 6) AS loss FROM (SELECT CAST(k / 10.0 AS DOUBLE) AS temperature, avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS loss FROM (
  SELECT k, label, 1 / (1 + exp(-ln(probability / (1 - probability)) / (k / 10.0))) AS q FROM predictions, generate_series(5, 29) g(k)) GROUP BY k)"""))
def temperatures(spark, sf):
    return _rounded(evaluation.temperature_losses(t.predictions(spark, sf)), "loss")


@query("a34_best_temperature", with_tables(t.PREDICTIONS, body="""SELECT arg_min(temperature, loss) AS temperature, round(min(loss), 6) AS loss FROM (SELECT CAST(k / 10.0 AS DOUBLE) AS temperature, avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS loss FROM (
  SELECT k, label, 1 / (1 + exp(-ln(probability / (1 - probability)) / (k / 10.0))) AS q FROM predictions, generate_series(5, 29) g(k)) GROUP BY k)"""))
def best_temperature(spark, sf):
    return _rounded(evaluation.best_temperature(t.predictions(spark, sf)), "loss")


@query("z19_calibrated", with_tables(t.PREDICTIONS, body="SELECT sample_id, round(1 / (1 + exp(-ln(probability / (1 - probability)) / 1.7)), 6) AS calibrated, round(probability, 6) AS unchanged FROM predictions"))
def calibrated(spark, sf):
    p = F.col("probability")
    return t.predictions(spark, sf).select("sample_id", F.round(evaluation.calibrated(p, 1.7), 6).alias("calibrated"), F.round(evaluation.calibrated(p, 1.0), 6).alias("unchanged"))


@query("z20_prediction_columns", with_tables(t.PREDICTIONS, body="""SELECT sample_id, probability >= 0.5 AS vulnerable, CAST(probability >= 0.5 AS INTEGER) AS prediction, CASE WHEN probability >= 0.5 THEN 'VULNERABLE' ELSE 'SAFE' END AS label_text,
  round(greatest(probability, 1 - probability), 6) AS confidence, round(1 - probability, 6) AS p_safe, round(probability, 6) AS p_vulnerable FROM predictions"""))
def prediction_columns(spark, sf):
    rows = evaluation.prediction_columns(t.predictions(spark, sf).select("sample_id", "probability")).drop("probability")
    return _rounded(rows, "confidence", "p_safe", "p_vulnerable")


@query("z22_branch_shares", """SELECT vec_id, round(a / (a + b + 1e-8), 5) AS structure_share, CASE WHEN a / (a + b + 1e-8) > 0.6 THEN 'structural' WHEN b / (a + b + 1e-8) > 0.6 THEN 'sequential' ELSE 'hybrid' END AS dominant FROM (
  SELECT vec_id, sqrt(list_sum(list_transform(embedding[1:8 + vec_id % 40], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS a, sqrt(list_sum(list_transform(embedding[9 + vec_id % 40:64], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS b FROM embeddings)""")
def branch_shares(spark, sf):
    cut = (F.col("vec_id") % 40 + 8).cast("int")
    rows = read(spark, sf, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), cut).alias("a"), F.slice("embedding", cut + 1, 64 - cut).alias("b"))
    a, b = evaluation.branch_shares(F.col("a"), F.col("b"))
    return rows.select("vec_id", F.round(a, 5).alias("structure_share"), evaluation.dominant_branch(a, b).alias("dominant"))


# ------------------------------------------------------------ token importances

IMPORTANCES = """importances AS (SELECT l_orderkey AS sample_id, CAST(l_linenumber AS BIGINT) AS line_no, 'tok' || CAST(l_partkey AS VARCHAR) AS token, (l_partkey * 100000 + l_suppkey) * 100 + l_quantity::BIGINT AS position, ((l_partkey * 7 + l_suppkey) % 97 + 0.25) / CAST(97 AS DOUBLE) AS importance FROM lineitem)"""


def _importances(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").cast("bigint").alias("line_no"), F.concat(F.lit("tok"), F.col("l_partkey").cast("string")).alias("token"),
                     ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")).alias("position"), (((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 97 + 0.25) / 97.0).alias("importance"))


SQL_RISK = f"""(SELECT l.file_id AS sample_id, l.line_no, l.line[1:100] AS code_snippet, coalesce(r.risk, 0.0) AS risk_score, coalesce(h.tokens, '') AS contributing_tokens FROM {t.sql_lines('code_files', 'file_id')} l
  LEFT JOIN (SELECT sample_id, line_no, round_even(0.3 * avg(importance) + 0.7 * max(importance), 4) AS risk FROM importances GROUP BY ALL) r ON r.sample_id = l.file_id AND r.line_no = l.line_no
  LEFT JOIN (SELECT sample_id, line_no, string_agg(token, ' ' ORDER BY n) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, line_no ORDER BY importance DESC, position) AS n FROM importances WHERE importance > 0.5) WHERE n <= 5 GROUP BY ALL) h
  ON h.sample_id = l.file_id AND h.line_no = l.line_no)"""


@query("a28_line_risk", with_tables(t.CODE_FILES, IMPORTANCES, body=f"SELECT sample_id, line_no, code_snippet, risk_score, contributing_tokens FROM {SQL_RISK}"))
def line_risk(spark, sf):
    from vulnlake.functions.text import explode_lines
    lines = explode_lines(t.code_files(spark, sf).select(F.col("file_id").alias("sample_id"), "text"))
    out = evaluation.line_risk(lines, _importances(spark, sf), "sample_id")
    return out.withColumn("contributing_tokens", F.array_join("contributing_tokens", " "))


@query("a29_high_risk_tokens", with_tables(IMPORTANCES, body="SELECT sample_id, count(*) FILTER (importance > 0.7) AS high_risk_tokens, count(*) AS high_risk_tokens_of FROM importances GROUP BY 1"))
def high_risk_tokens(spark, sf):
    return evaluation.high_risk(_importances(spark, sf), ["sample_id"], "importance", "high_risk_tokens")


@query("l7_top_tokens", with_tables(IMPORTANCES, body="""SELECT sample_id, token, importance, place FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY importance DESC, position) AS place FROM importances) WHERE place <= 20"""))
def top_tokens(spark, sf):
    return evaluation.top_tokens(_importances(spark, sf), ["sample_id"], 20).select("sample_id", "token", "importance", "place")


# ------------------------------------------------------------------------ votes

SQL_V = "(SELECT sample_id, model_no, probability, weight, probability > 0.5 AS v FROM model_predictions)"
VOTE_SQL = {
    "majority": f"SELECT sample_id, y > n / 2.0 AS is_vulnerable, round(abs(y - n / 2.0) / (n / 2.0), 6) AS confidence, round(greatest(y, n - y) / CAST(n AS DOUBLE), 6) AS agreement FROM (SELECT sample_id, count(*) FILTER (v) AS y, count(*) AS n FROM {SQL_V} GROUP BY 1)",
    "weighted": f"SELECT sample_id, p > 0.5 AS is_vulnerable, round(abs(p - 0.5) * 2, 6) AS confidence, round(greatest(y, w - y) / w, 6) AS agreement FROM (SELECT sample_id, sum(probability * weight) / sum(weight) AS p, sum(weight) AS w, sum(CASE WHEN v THEN weight ELSE 0 END) AS y FROM {SQL_V} GROUP BY 1)",
    "average": f"SELECT sample_id, p > 0.5 AS is_vulnerable, round(abs(p - 0.5) * 2, 6) AS confidence, round(CASE WHEN p > 0.5 THEN y ELSE n - y END / CAST(n AS DOUBLE), 6) AS agreement FROM (SELECT sample_id, avg(probability) AS p, count(*) FILTER (v) AS y, count(*) AS n FROM {SQL_V} GROUP BY 1)",
    "max_confidence": f"""SELECT sample_id, b AS is_vulnerable, round(a * 2, 6) AS confidence, round(CASE WHEN b THEN y ELSE n - y END / CAST(n AS DOUBLE), 6) AS agreement FROM (SELECT sample_id, v AS b, abs(probability - 0.5) AS a,
      row_number() OVER (PARTITION BY sample_id ORDER BY abs(probability - 0.5) DESC, model_no) AS r, count(*) FILTER (v) OVER (PARTITION BY sample_id) AS y, count(*) OVER (PARTITION BY sample_id) AS n FROM {SQL_V}) WHERE r = 1""",
}
VOTE_SQL["stacking"] = VOTE_SQL["weighted"]
VOTE_NAMES = {"majority": "a30_majority_vote", "weighted": "a31_weighted_vote", "average": "a32_average_vote", "max_confidence": "a33_max_confidence_vote", "stacking": "m3_stacking_falls_back"}


def _register_vote(strategy):
    @query(VOTE_NAMES[strategy], with_tables(t.MODEL_PREDICTIONS, body=VOTE_SQL[strategy].replace("SELECT sample_id,", f"SELECT {q(strategy)} AS strategy, sample_id,", 1)))
    def vote(spark, sf):
        return _rounded(votes.combine(t.model_predictions(spark, sf), strategy), "confidence", "agreement")


for _strategy in votes.STRATEGIES:
    _register_vote(_strategy)


@query("m4_model_register", with_tables(t.MODEL_PREDICTIONS, body="SELECT model, model_no, weight, count(*) AS predictions FROM model_predictions GROUP BY ALL"))
def model_register(spark, sf):
    register = votes.model_register(spark, t.MODELS)
    return votes.with_weights(t.model_predictions(spark, sf).select("model"), register).groupBy("model", "model_no", "weight").agg(F.count("*").alias("predictions"))


# ----------------------------------------------------------------------- search


@query("l8_ranked_search", """SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN i = 0 THEN 0 WHEN lower(text) = 'the' THEN 100 WHEN i = 1 THEN 50 ELSE 10 END + CASE WHEN lower(lang) = 'the' THEN 100 WHEN instr(lower(lang), 'the') = 1 THEN 50 WHEN instr(lower(lang), 'the') > 0 THEN 10 ELSE 0 END AS score
  FROM (SELECT doc_id, text, lang, instr(lower(text), 'the') AS i FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def ranked_search(spark, sf):
    from vulnlake.operators.search import search
    return search(read(spark, sf, "documents"), "The", ["text", "lang"], 20, ["doc_id"]).select("doc_id", "score")


# ------------------------------------------------------------------------ graphs


def _nodes(spark, sf, columns=tuple(graph.NODE_TYPES), **options):
    """Nodes of the texts that parse, or with ``recover`` of all texts."""
    return graph.parse_nodes(t.code_files(spark, sf).select("file_id", "text"), columns=columns, **options)


@query("g1_nodes")
def nodes(spark, sf):
    return _nodes(spark, sf)


@query("g2_tree_edges")
def tree_edges(spark, sf):
    return graph.tree_edges(_nodes(spark, sf))


@query("g3_w9_sequence_edges")
def sequence_edges(spark, sf):
    return graph.sequence_edges(_nodes(spark, sf))


@query("g4_dataflow_edges")
def dataflow_edges(spark, sf):
    """Edges between the names of all texts, also of those that do not parse as a whole."""
    n = kept(_nodes(spark, sf, graph.DATAFLOW_COLUMNS, recover=True, kinds=graph.NAMED), "nodes")  # texts are parsed once for all edges
    return graph.dataflow_edges(n).withColumn("form", F.lit("all")).unionByName(graph.dataflow_edges(n, True).withColumn("form", F.lit("last")))


@query("g5_control_edges")
def control_edges(spark, sf):
    return graph.control_edges(_nodes(spark, sf, graph.CONTROL_COLUMNS))


@query("g6_g7_node_features")
def node_features(spark, sf):
    return graph.node_features(_nodes(spark, sf, graph.FEATURE_COLUMNS))


@query("g8_leaf_tokens")
def leaf_tokens(spark, sf):
    return graph.leaf_tokens(_nodes(spark, sf))


@query("a35_graph_stats")
def graph_stats(spark, sf):
    n = kept(_nodes(spark, sf), "nodes")  # texts are parsed once for all edges
    edges = graph.tree_edges(n).unionByName(graph.sequence_edges(n)).unionByName(graph.dataflow_edges(n))
    return graph.graph_stats(n, edges)


@query("w9_next_line_edges", "SELECT l_orderkey AS file_id, source, target, 'control' AS kind FROM (SELECT l_orderkey, nid AS source, lead(nid) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, nid) AS target FROM (SELECT l_orderkey, l_linenumber, l_partkey * 100000 + l_suppkey AS nid FROM lineitem)) WHERE target IS NOT NULL")
def next_line_edges(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("start_line"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("node_id"))
    return graph.sequence_edges(rows)


# ------------------------------------------------------------------------ models


def _model_samples(spark, sf, label):
    """(training rows, held-out rows): every fifth file is held out; features are computed once."""
    files = t.code_files(spark, sf).select("file_id", F.col("text").alias("code"), label.cast("int").alias("label"))
    samples = kept(models.with_features(files).drop("code"), "features")
    held_out = F.col("file_id") % 5 == 0
    return samples.filter(~held_out), samples.filter(held_out)


@query("m1_m2_network_scores")
def network_scores(spark, sf):
    train, held_out = _model_samples(spark, sf, F.col("text").contains("eval(") | F.col("text").contains("pickle"))
    return evaluation.binary_metrics(models.score(models.train_network(train), held_out))


@query("m1_weighted_model_scores")
def weighted_scores(spark, sf):
    train, held_out = _model_samples(spark, sf, F.col("text").contains("eval("))
    return evaluation.binary_metrics(models.score(models.train_weighted(corpus.with_class_weight(train)), held_out))


@query("row_numbers_over_order", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem")
def row_numbers(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    rows = read(spark, sf, "lineitem").select("l_returnflag", *order)
    return number_rows(rows, [F.col(c) for c in order], "n", ["l_returnflag"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n")


