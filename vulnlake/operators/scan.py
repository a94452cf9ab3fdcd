"""Rule scans: lines of text against regex rules.

Rules are compiled into one column expression with literal patterns, so each task
compiles every pattern once and nothing is shuffled. A rule's pattern runs only where
the line holds one of the texts the pattern cannot match without (``Rule.needles``);
that test is a plain byte search and rejects nearly all (line, rule) pairs.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.caching import remembered
from vulnlake.functions.severity import severity_rank
from vulnlake.functions.text import computed_once, contains_any, explode_lines, regex, strip
from vulnlake.operators.grams import EVERY_TEXT, GRAM, grams, looked_up, rarest_grams, sent_if_small
from vulnlake.rules.code_rules import CODE_RULES, SAFE_PATTERNS
from vulnlake.rules.infra_rules import (
    DOCKERFILE_REQUIRED,
    INFRA_RULES,
    SECRET_RULES,
    SECRET_SKIP_SUFFIXES,
)
from vulnlake.rules.model import required_literals

# --------------------------------------------------------------- expressions


def lowered(line: Column, unicode: bool = False) -> Column:
    """Search text for the needles. Two letters fold to ASCII only under Unicode rules."""
    low = F.lower(line)
    if not unicode:
        return low
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, low).otherwise(F.translate(low, "ſı", "si"))


def _mark_column(marks: tuple[str, ...]) -> str:
    return "_has_" + "_".join(f"{ord(m):02x}" for m in marks)


def with_marks(lines: DataFrame, rules, unicode: bool = False) -> DataFrame:
    """Adds ``_low`` and one flag per set of punctuation marks that some rule needs."""
    sets = sorted({m for rule in rules for m in rule.marks})
    flags = F.struct(lowered(F.col("line"), unicode).alias("_low"),
                     *[contains_any(F.col("line"), m).alias(_mark_column(m)) for m in sets])
    return computed_once(lines, _p=flags).select(*lines.columns, "_p.*")


def rule_fires(rule, line: Column, low: Column, unicode: bool = False, flagged: bool = False) -> Column:
    """Whether the rule holds for the line; cheap necessary tests come first."""
    hit = line.rlike(regex(rule.pattern, rule.ignore_case, unicode))
    for pattern in rule.negative:
        hit = hit & ~line.rlike(regex(pattern, rule.ignore_case, unicode))
    if rule.needles:
        hit = contains_any(low, rule.needles) & hit
    for marks in reversed(rule.marks if flagged else ()):
        hit = F.col(_mark_column(marks)) & hit
    return hit


def is_comment(line: Column, language: Column) -> Column:
    """Comment lines, judged by their first characters. A blank line is none."""
    text = strip(line)
    python = (language == "python") & (
        text.startswith("#") | text.startswith('"""') | text.startswith("'''"))
    script = language.isin("javascript", "typescript") & (
        text.startswith("//") | text.startswith("/*") | text.startswith("*"))
    return F.coalesce(python | script, F.lit(False))


def is_safe(text: Column, language: Column, safe_patterns=SAFE_PATTERNS, unicode: bool = False,
            low: Column | None = None) -> Column:
    """Whether a safe construct of the language occurs anywhere in the text."""
    low = lowered(text, unicode) if low is None else low
    cases = None
    for name, patterns in safe_patterns.items():
        hit = reduce(lambda a, b: a | b, [_safe_hit(p, text, low, unicode) for p in patterns])
        cases = F.when(language == name, hit) if cases is None else cases.when(language == name, hit)
    return F.lit(False) if cases is None else F.coalesce(cases, F.lit(False))


def _safe_hit(pattern: str, text: Column, low: Column, unicode: bool) -> Column:
    hit = text.rlike(regex(pattern, True, unicode))
    needles = required_literals(pattern)
    return contains_any(low, needles) & hit if needles else hit


def _by_language(rules, language: Column, build):
    """``build(rules of a language)`` as a case over the language; equal rule sets share a branch."""
    groups: dict[tuple, list[str]] = {}
    for name in sorted({n for rule in rules for n in rule.languages}):
        groups.setdefault(tuple(r for r in rules if name in r.languages), []).append(name)
    cases = None
    for chosen, names in groups.items():
        test = language.isin(*names)
        cases = F.when(test, build(chosen)) if cases is None else cases.when(test, build(chosen))
    return cases


def best_rule(rules, line: Column, low: Column, unicode: bool = False) -> Column:
    """Number of the rule that wins the line: highest severity, then rule order. Null if none.

    Testing in that order lets the first hit end the search.
    """
    ordered = sorted(rules, key=lambda r: (r.rank, r.number))
    return reduce(
        lambda chain, rule: chain.when(rule_fires(rule, line, low, unicode, True), F.lit(rule.number)),
        ordered[1:],
        F.when(rule_fires(ordered[0], line, low, unicode, True), F.lit(ordered[0].number)),
    )


def all_rules(rules, line: Column, low: Column, unicode: bool = False) -> Column:
    """Numbers of all rules that fire on the line."""
    return F.array_compact(
        F.array(*[F.when(rule_fires(r, line, low, unicode, True), F.lit(r.number)) for r in rules]))


def _attributes(rules, number: Column, *names: str) -> list[Column]:
    """Rule attributes by number, from literal arrays (no join)."""
    by_number = {r.number: r for r in rules}
    size = max(by_number)
    out = []
    for name in names:
        values = [getattr(by_number[i], name, None) if i in by_number else None for i in range(1, size + 1)]
        out.append(F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), number).alias(name))
    return out


# ------------------------------------------------------------------ code scan


def scannable_lines(files: DataFrame, safe_patterns=SAFE_PATTERNS, unicode: bool = False) -> DataFrame:
    """Lines that rules are tried on: unsuppressed files, no comments, no safe lines.

    Columns of ``files``: ``language`` and ``text`` plus anything to carry along.
    """
    kept = [c for c in files.columns if c != "text"]
    text, language = F.col("text"), F.col("language")
    live = computed_once(files.select(*kept, "text"), _low=lowered(text, unicode))
    live = live.filter(~is_safe(text, language, safe_patterns, unicode, F.col("_low")))
    lines = explode_lines(live, keep=kept)
    line = F.col("line")
    anchored = {k: [p for p in v if "^" in p or "$" in p] for k, v in safe_patterns.items()}
    anchored = {k: v for k, v in anchored.items() if v}
    lines = lines.filter(~is_comment(line, language))
    # A safe pattern found in a line is found in its file too, except for patterns tied
    # to the ends of the text; only those have to be tried again.
    return lines.filter(~is_safe(line, language, anchored, unicode)) if anchored else lines


def _finding_columns(rules, number: Column, tool: str) -> list[Column]:
    attrs = _attributes(rules, number, "rule_id", "title", "severity", "message", "cwe_id")
    return [
        F.lit(tool).alias("tool"), *attrs,
        F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"),
        strip(F.col("line")).alias("code_snippet"), number.alias("rule_no"),
    ]


def scan_code(files: DataFrame, rules=CODE_RULES, safe_patterns=SAFE_PATTERNS, *,
              unicode: bool = True, tool: str = "pattern") -> DataFrame:
    """At most one finding per line: the most severe rule, the earlier one on ties. No shuffle."""
    kept = [c for c in files.columns if c != "text"]
    line, low = F.col("line"), F.col("_low")
    number = remembered(("best", rules, unicode), lambda: _by_language(
        rules, F.col("language"), lambda rs: best_rule(rs, line, low, unicode)))
    hits = (computed_once(with_marks(scannable_lines(files, safe_patterns, unicode), rules, unicode), _rule=number)
            .filter(F.col("_rule").isNotNull()))
    return hits.select(*kept, *_finding_columns(rules, F.col("_rule"), tool))


def match_code(files: DataFrame, rules=CODE_RULES, safe_patterns=SAFE_PATTERNS, *,
               unicode: bool = True, tool: str = "pattern") -> DataFrame:
    """Every rule that fires on a line, before the choice of one finding per line."""
    kept = [c for c in files.columns if c != "text"]
    line, low = F.col("line"), F.col("_low")
    numbers = remembered(("all", rules, unicode), lambda: _by_language(
        rules, F.col("language"), lambda rs: all_rules(rs, line, low, unicode)))
    hits = (computed_once(with_marks(scannable_lines(files, safe_patterns, unicode), rules, unicode), _rules=numbers)
            .select(*kept, "line_no", "line", F.explode("_rules").alias("_rule")))
    return hits.select(*kept, *_finding_columns(rules, F.col("_rule"), tool))


def best_per_line(findings: DataFrame, keys: list[str], line: str = "start_line",
                  order: str = "rule_no") -> DataFrame:
    """One finding per line of any finding table: highest severity, then the given order.

    An aggregate, so each task reduces its own rows before the shuffle.
    """
    rest = [c for c in findings.columns if c not in (*keys, line)]
    best = F.min_by(F.struct(*rest), F.struct(severity_rank(F.col("severity")), F.col(order)))
    return findings.groupBy(*keys, line).agg(best.alias("_b")).select(*keys, line, "_b.*")


def _indexed(rules: DataFrame) -> DataFrame:
    """(language, gram, nth, rule): for every needle of a rule one of its grams, the rarest in the table."""
    rows = rules.select("language", "rule", F.posexplode("rule.needles").alias("nth", "needle")).select(
        "*", F.explode(F.array_distinct(grams(F.col("needle")))).alias("gram"))
    return rarest_grams(rows, ["language", "rule", "nth"])


def scan_with_rule_table(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Scan with rules given as a table (rule_id, pattern, severity, cwe_id, languages, negative, needles); one row per rule that fires.

    ``lines`` needs ``language`` and ``line``; ``needles`` are texts, in lower case, of which a match of the pattern holds
    one. Every needle stands in an index under one gram, and a line looks up each of its grams once: it meets only
    rules of its language whose gram it holds, however many rules there are. Rules without needles, or with one shorter than a
    gram, meet all lines of their languages. What is left is sorted by rule within its task, as Spark compiles the
    pattern of `regexp_instr` anew only when it changes. The sort is the only step besides the lookup; lines are not shuffled.
    """
    have = set(rules.columns)
    none = F.array().cast("array<string>")
    lists = {name: F.coalesce(F.col(name), none) if name in have else none for name in ("needles", "negative")}
    given = [c for c in rules.columns if c not in ("languages", *lists)]
    table = rules.select(F.explode("languages").alias("language"), F.struct(*given, *[v.alias(k) for k, v in lists.items()]).alias("rule")).distinct()
    short = (F.size("rule.needles") == 0) | F.exists("rule.needles", lambda n: F.octet_length(n) < GRAM)
    always = table.filter(short).select("language", "rule", F.lit(None).cast("int").alias("nth"), F.lit(EVERY_TEXT).alias("gram"))
    index = _indexed(table.filter(~short)).unionByName(always)
    low = computed_once(lines, _low=F.lower("line"))
    met = low.select("*", F.explode(looked_up(F.col("_low"), index)).alias("gram")).join(sent_if_small(index), ["language", "gram"])
    holds = lambda needle: F.col("_low").contains(needle)
    # A rule of several needles is met by the first one that the line holds.
    by_gram = holds(F.get("rule.needles", F.col("nth"))) & ~F.exists(F.slice("rule.needles", 1, F.col("nth")), holds)
    met = met.filter(F.when(F.col("nth").isNotNull(), by_gram).otherwise((F.size("rule.needles") == 0) | F.exists("rule.needles", holds)))
    fires = lambda pattern: F.concat(F.lit("(?d)(?i)"), pattern)
    ordered = met.select(*lines.columns, "rule").sortWithinPartitions(F.xxhash64("rule.pattern"))
    hits = ordered.filter(F.regexp_instr("line", fires(F.col("rule.pattern"))) > 0)
    hits = hits.filter(~F.exists("rule.negative", lambda p: F.regexp_like("line", fires(p))))
    return hits.select(*lines.columns, *[F.col(f"rule.{c}") for c in given if c != "pattern"])


# ------------------------------------------------------- infrastructure scans


def infra_type(filename: Column, text: Column) -> Column:
    """dockerfile, docker-compose, kubernetes, terraform or generic; the first test that holds."""
    name = F.lower(filename)
    return (F.when(name.contains("dockerfile"), "dockerfile")
            .when(name.contains("docker-compose") | name.contains("compose.y"), "docker-compose")
            .when(contains_any(text, ("apiVersion:", "kind:", "metadata:")), "kubernetes")
            .when(name.contains("terraform") | name.endswith(".tf"), "terraform")
            .otherwise("generic"))


def _family_hits(lines: DataFrame, kept, rules, unicode: bool, by_type: dict | None = None) -> DataFrame:
    line, low = F.col("line"), F.col("_low")

    def build():
        if not by_type:
            return all_rules(rules, line, low, unicode)
        cases = F.array().cast("array<int>")
        for kind, family in by_type.items():
            if kind != "secrets":
                cases = F.when(F.col("infra_type") == kind, all_rules(family, line, low, unicode)).otherwise(cases)
        return F.concat(cases, all_rules(by_type["secrets"], line, low, unicode)) if "secrets" in by_type else cases

    numbers = remembered(("family", rules, unicode, bool(by_type)), build)
    hits = (with_marks(lines, rules, unicode)
            .select(*kept, "line_no", F.explode(numbers).alias("_rule")))
    return hits.select(
        *kept, "line_no",
        *[c.alias("type") if n == "title" else c for n, c in zip(
            ("rule_id", "title", "severity", "message", "remediation"),
            _attributes(rules, F.col("_rule"), "rule_id", "title", "severity", "message", "remediation"))])


def scan_secrets(files: DataFrame, *, unicode: bool = True, skip_comments: bool = False,
                 filename: str | None = None) -> DataFrame:
    """Secrets in all lines; optionally without comment lines and without skipped file kinds."""
    kept = [c for c in files.columns if c != "text"]
    if filename:
        name = F.col(filename)
        files = files.filter(~reduce(lambda a, b: a | b, [name.endswith(s) for s in SECRET_SKIP_SUFFIXES]))
    lines = explode_lines(files)
    if skip_comments:
        text = strip(F.col("line"))
        lines = lines.filter(~(text.startswith("#") | text.startswith("//")))
    return _family_hits(lines, kept, SECRET_RULES, unicode)


def scan_infra(files: DataFrame, *, unicode: bool = True, with_secrets: bool = True) -> DataFrame:
    """Container and orchestration rules by ``infra_type``, secrets for every type.

    All families are tried in one pass over the lines; rules are renumbered through for that.
    """
    kept = [c for c in files.columns if c != "text"]
    families = {**INFRA_RULES, **({"secrets": SECRET_RULES} if with_secrets else {})}
    numbered, rules = {}, ()
    for kind, family in families.items():
        numbered[kind] = tuple(replace(r, number=len(rules) + i) for i, r in enumerate(family, 1))
        rules += numbered[kind]
    return _family_hits(explode_lines(files), kept, rules, unicode, numbered)


def scan_absent(files: DataFrame) -> DataFrame:
    """Findings at line 1 for instructions that a Dockerfile lacks."""
    kept = [c for c in files.columns if c != "text"]
    text = F.upper("text")
    checks = F.array(*[
        F.when(~text.contains(needed), F.struct(
            F.lit(1).alias("line_no"), F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("type"),
            F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(advice).alias("remediation")))
        for rule_id, severity, kind, needed, message, advice in DOCKERFILE_REQUIRED])
    return files.select(*kept, F.explode(F.array_compact(checks)).alias("_f")).select(*kept, "_f.*")
