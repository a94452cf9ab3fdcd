"""Row-wise predicates and projections over files, samples, URLs and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.dimensions import (
    IGNORED_DIRS,
    PROJECT_LANGUAGES,
    PROJECT_SKIP_DIRS,
    SCANNER_LANGUAGES,
)
from vulnlake.functions.severity import mapped
from vulnlake.functions.text import contains_any, count_of, lines_of, rlike_any, strip

# ---------------------------------------------------------------------------
# Limits, patterns, words.
# ---------------------------------------------------------------------------
MAX_CODE_CHARS = 1_000_000
MAX_CODE_LINES = 10_000
MAX_NAME_CHARS = 255
INPUT_LANGUAGES = ("python", "javascript", "typescript", "java", "c", "cpp", "go", "rust")
DANGEROUS_NAME_PATTERNS = (
    r"\.\.[/\\]",
    r"\.\.%2[fF]",
    r"\.\.%5[cC]",
    r"\x00",
    r"%00",
    r"[|;&$`]",
    r"\$\(",
    r"`.*`",
)
NAME_PATTERN = r"^[\w\-. ]+$"
PRIVATE_URL_PATTERNS = (
    r"localhost",
    r"127\.\d+\.\d+\.\d+",
    r"10\.\d+\.\d+\.\d+",
    r"172\.(1[6-9]|2\d|3[01])\.\d+\.\d+",
    r"192\.168\.\d+\.\d+",
    r"169\.254\.\d+\.\d+",
    r"\[::1\]",
    r"\[fe80:",
    r"0\.0\.0\.0",
)
CONTENT_LANGUAGE = (
    ("python", ("def ", "import ", "print(")),
    ("javascript", ("function ", "const ", "let ", "=>")),
    ("c", ("int main", "#include", "printf")),
    ("java", ("public class", "void main")),
)
CONTENT_LANGUAGE_SHORT = (
    ("python", ("def ", "import ", "print(")),
    ("javascript", ("function ", "const ", "var ")),
)
IMPORT_STARTS = ("import", "from ", "#include", "using")
DANGEROUS_CALLS = ("eval(", "exec(", "os.system(", "__import__(", "subprocess")
# ------------------------------ end of fixed values ------------------------


def extension(path: Column) -> Column:
    """Last suffix of the file name in lower case, '' if there is none (a leading dot is no suffix)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def language_by_extension(path: Column, languages=SCANNER_LANGUAGES, default: str | None = None) -> Column:
    return mapped(extension(path), languages, default)


def project_language(path: Column) -> Column:
    return language_by_extension(path, PROJECT_LANGUAGES)


def language_by_content(text: Column, branches=CONTENT_LANGUAGE) -> Column:
    """The first branch of which a text occurs (case as written), else unknown."""
    cases = None
    for language, texts in branches:
        test = contains_any(text, texts)
        cases = F.when(test, language) if cases is None else cases.when(test, language)
    return cases.otherwise("unknown")


def in_ignored_dir(path: Column, dirs=IGNORED_DIRS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in dirs]))


def skip_project_dir(name: Column) -> Column:
    return name.isin(*PROJECT_SKIP_DIRS) | name.startswith(".")


def code_problem(code: Column, language: Column) -> Column:
    """Why an input is refused; null where it is fine. The first reason that holds."""
    return (F.when(code.isNull() | (strip(code) == ""), "Code cannot be empty")
            .when(F.char_length(code) > MAX_CODE_CHARS, f"Code exceeds maximum size of {MAX_CODE_CHARS // 1024}KB")
            .when(count_of(code, "\n") + 1 > MAX_CODE_LINES, f"Code exceeds maximum of {MAX_CODE_LINES} lines")
            .when(~F.lower(language).isin(*INPUT_LANGUAGES),
                  F.concat(F.lit("Unsupported language: "), language,
                           F.lit(". Allowed: " + ", ".join(INPUT_LANGUAGES))))
            .when(code.contains("\x00"), "Invalid characters in code"))


def filename_problem(name: Column) -> Column:
    return (F.when(name.isNull() | (name == ""), "Filename cannot be empty")
            .when(F.char_length(name) > MAX_NAME_CHARS, f"Filename too long (max {MAX_NAME_CHARS} characters)")
            .when(rlike_any(name, DANGEROUS_NAME_PATTERNS), "Invalid filename - contains dangerous characters")
            .when(name.contains("/") | name.contains("\\"), "Filename cannot contain path separators")
            .when(~name.rlike("(?U)" + NAME_PATTERN), "Filename contains invalid characters"))


def is_safe_filename(name: Column) -> Column:
    return ~(contains_any(name, ("..", "/", "\\", "\x00")) | (F.char_length(name) > MAX_NAME_CHARS))


def url_problem(url: Column) -> Column:
    return (F.when(url.isNull() | (url == ""), "URL cannot be empty")
            .when(~(url.startswith("http://") | url.startswith("https://")),
                  "URL must start with http:// or https://")
            .when(rlike_any(url, ["(?i)" + p for p in PRIVATE_URL_PATTERNS]),
                  "Access to internal/private URLs is not allowed"))


def normal_path(path: Column) -> Column:
    """Absolute path without empty, `.` and `..` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within(path: Column, base: Column) -> Column:
    """Whether a path, resolved against the base, stays below it."""
    root = normal_path(base)
    full = normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))
    return (full == root) | full.startswith(F.concat(F.when(root == "/", "").otherwise(root), F.lit("/")))


def is_valid_sample(code: Column) -> Column:
    """At least 20 characters, two non-blank lines and one that is no import."""
    lines = F.filter(F.transform(lines_of(code), strip), lambda line: line != "")
    others = F.filter(lines, lambda line: ~_starts_with_any(line, IMPORT_STARTS))
    return F.coalesce((F.char_length(strip(code)) >= 20) & (F.size(lines) >= 2) & (F.size(others) >= 1), F.lit(False))


def _starts_with_any(col: Column, texts) -> Column:
    test = col.startswith(texts[0])
    for text in texts[1:]:
        test = test | col.startswith(text)
    return test


# Length limits by use, as (lowest, highest) number of characters.
LENGTH_LIMITS = {
    "cleaned": (50, 5000),
    "csv": (51, 4999),
    "large": (50, 10000),
    "large_multi_line": (30, 15000),
    "production": (100, 10000),
    "minimum": (20, None),
}


def length_within(code: Column, use: str) -> Column:
    low, high = LENGTH_LIMITS[use]
    size = F.char_length(code)
    test = size >= low if high is None else size.between(low, high)
    return test & (count_of(code, "\n") >= 1) if use == "large_multi_line" else test


def keep_languages(samples: DataFrame, languages) -> DataFrame:
    return samples.filter(F.lower("language").isin(*[name.lower() for name in languages]))


def is_plain_import(code: Column) -> Column:
    """Import-only text without a dangerous call: a model finding on it is dropped."""
    text = strip(code)
    imports = text.startswith("import ") | (text.startswith("from ") & text.contains(" import "))
    return imports & ~contains_any(code, DANGEROUS_CALLS)


def filter_findings(findings: DataFrame, file: str | None = None, severity: str = "all") -> DataFrame:
    """The report view's filter: one file and one severity, both optional."""
    if file is not None:
        findings = findings.filter(F.col("file_path") == file)
    if severity != "all":
        findings = findings.filter(F.lower("severity") == severity.lower())
    return findings


