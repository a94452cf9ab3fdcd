"""Readers that bring labelled corpora of several shapes to one sample schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions.severity import mapped
from vulnlake.operators.corpus import binary_label, labelled_functions
from vulnlake.operators.filters import extension, is_valid_sample, language_by_content
from vulnlake.operators.lookups import with_cwe_group

SAMPLE = ("code string, cleaned_code string, label string, language string, vulnerability_type string, vuln_type string, "
          "cwe_id string, source string, vulnerable boolean, is_vulnerable boolean, target string, func string, text string, "
          "vulnerabilities array<struct<cwe_id:string,severity:string,type:string,owasp_category:string,confidence:double>>, "
          "metadata map<string,string>")
WRAPPERS = ("data", "samples", "examples")


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Samples from files that hold a list, a wrapped list or a single object; empty files give none.

    A list is read by Spark as one row per element, so a row is a wrapper or a sample.
    """
    wrapped = ", ".join(f"{name} array<struct<{_as_fields(SAMPLE)}>>" for name in WRAPPERS)
    rows = spark.read.schema(f"{SAMPLE}, {wrapped}").option("multiLine", True).json(path)
    names = [c for c in rows.columns if c not in WRAPPERS]
    own = F.struct(*names)
    has_own = F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in ("code", "cleaned_code", "func", "text")], F.lit(False))
    listed = F.coalesce(*WRAPPERS, F.when(has_own, F.array(own)))
    return rows.select(F.inline(listed))


def _as_fields(schema: str) -> str:
    out, depth, field = [], 0, ""
    for char in schema + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += char
    return ",".join(out)


def with_label(samples: DataFrame) -> DataFrame:
    return samples.withColumn("label", binary_label(
        F.col("label"), F.col("vuln_type"), F.col("vulnerabilities"), F.col("vulnerable")).cast("int"))


def read_jsonl(spark: SparkSession, path: str, fields: str = "func string, target int, project string, commit_id string",
               source: str = "codexglue") -> tuple[DataFrame, DataFrame]:
    """(samples, bad lines) of a line-wise JSON corpus; samples pass the quality filter."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", parsed.alias("r"))
    bad = rows.filter(F.col("r._bad").isNotNull()).select(F.col("value").alias("line"))
    good = rows.filter(F.col("r._bad").isNull()).select("r.*").drop("_bad")
    return unify_functions(good, source, kind="defect", language=None), bad


def unify_functions(rows: DataFrame, source: str, *, kind: str = "vulnerability", language: str | None = "c",
                    quality: bool = True) -> DataFrame:
    """(func, target, project, commit_id) to samples; the language is looked for where none is given."""
    code = F.coalesce("func", F.lit(""))
    label = F.coalesce(F.col("target").cast("int"), F.lit(0))
    tongue = F.lit(language) if language else language_by_content(code)
    out = rows.select(
        code.alias("code"), label.alias("label"), tongue.alias("language"),
        F.when(label == 1, kind).otherwise("safe").alias("vulnerability_type"), F.lit(source).alias("source"),
        F.create_map(F.lit("project"), F.coalesce("project", F.lit("unknown")),
                     F.lit("commit_id"), F.coalesce("commit_id", F.lit(""))).alias("metadata"))
    return out.filter(is_valid_sample(F.col("code"))) if quality else out


def unify_safe(rows: DataFrame, code: Column, source: str, language: str = "python", least: int = 50) -> DataFrame:
    """Samples of a corpus that holds only safe code."""
    out = rows.select(code.alias("code"), F.lit(0).alias("label"), F.lit(language).alias("language"),
                      F.lit("safe").alias("vulnerability_type"), F.lit(source).alias("source"))
    return out.filter(F.char_length("code") >= least)


def unify_any(rows: DataFrame, source: str) -> DataFrame:
    """Code from the first field present (func, code, text), label from target or label."""
    def field(name, kind="string"):
        return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)

    out = rows.select(F.coalesce(field("func"), field("code"), field("text")).alias("code"),
                      F.coalesce(field("target", "int"), field("label", "int"), F.lit(0)).alias("label"),
                      F.lit(source).alias("source"))
    return out.filter(F.coalesce("code", F.lit("")) != "")


def read_function_csv(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """Labelled functions of a CSV; all of them unless a limit is given."""
    rows = (spark.read.schema("code string, target int, cwe_id string, project string")
            .option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    out = labelled_functions(rows).withColumn("source", F.lit("big-vul"))
    return out.orderBy(F.sha2("code", 256)).limit(max_samples) if max_samples else out


def read_test_manifest(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """Test cases of an XML manifest joined to their files; cases of unknown groups drop out."""
    cases = (spark.read.format("xml").schema("file string, cwe string, bad string").option("rowTag", "testcase").load(manifest))
    languages = {".py": "python", ".js": "javascript", ".ts": "javascript"}
    wanted = (cases.filter(F.col("file").isNotNull() & F.col("cwe").isNotNull())
              .withColumn("cwe_id", F.replace("cwe", F.lit("CWE-"), F.lit("")).cast("int"))
              .withColumn("is_vulnerable", F.coalesce(F.lower("bad") == "true", F.lit(False)))
              .withColumn("language", mapped(extension(F.col("file")), languages))
              .filter(F.col("language").isNotNull()))
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    texts = files.select(F.element_at(F.split("path", base, 2), 2).alias("file"), F.decode("content", "UTF-8").alias("code"))
    return with_cwe_group(wanted.join(texts, "file")).select(
        "code", "language", "cwe_id", "owasp_category", "is_vulnerable", F.col("file").alias("source_file"))


def group_labelled(rows: DataFrame, default_cwe: int = 79) -> DataFrame:
    """(code, target, language, cwe_id) with the default CWE where missing; unmapped CWEs drop out."""
    kept = rows.filter(F.col("code").isNotNull() & F.col("target").isNotNull())
    kept = kept.withColumn("cwe_id", F.coalesce(F.col("cwe_id").cast("int"), F.lit(default_cwe)))
    return with_cwe_group(kept).withColumn("is_vulnerable", F.col("target").cast("int") != 0).withColumn(
        "language", F.coalesce("language", F.lit("python")))
