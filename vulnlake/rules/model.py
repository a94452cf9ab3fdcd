"""The rule record and the literals a rule cannot match without."""

from __future__ import annotations

from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession

from vulnlake.functions.severity import severity_rank_of


@dataclass(frozen=True)
class Rule:
    """One regex rule. ``number`` gives the order within its family."""

    number: int
    rule_id: str
    title: str
    severity: str
    cwe_id: str | None
    message: str
    pattern: str
    languages: tuple[str, ...]
    negative: tuple[str, ...] = ()
    remediation: str | None = None
    owasp: str | None = None
    ignore_case: bool = True
    needles: tuple[str, ...] = field(init=False, compare=False)
    marks: tuple[tuple[str, ...], ...] = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "needles", required_literals(self.pattern))
        object.__setattr__(self, "marks", required_marks(self.pattern))

    @property
    def rank(self) -> int:
        return severity_rank_of(self.severity)


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    """Rules as a table, for joins and for the catalogue report."""
    rows = [
        (r.number, r.rule_id, r.title, r.severity, r.cwe_id, r.message, r.pattern,
         list(r.languages), list(r.negative), r.remediation, r.owasp, list(r.needles))
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "number int, rule_id string, title string, severity string, cwe_id string, message string, "
        "pattern string, languages array<string>, negative array<string>, remediation string, owasp string, needles array<string>",
    )


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every match of ``pattern`` holds at least one.

    An empty tuple means that nothing can be promised and the rule must be tried on
    every line. The search text has to be lower-cased before looking for them.
    """
    options = _required(parser.parse(pattern))
    return tuple(sorted(_most_selective(options))) if options else ()


def required_marks(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of punctuation marks; every match holds at least one mark of each set."""
    options = _required(parser.parse(pattern))
    marks = set()
    for texts in options:
        # of a longer text, every single mark is needed as well
        if len(texts) == 1:
            marks |= {(c,) for c in next(iter(texts)) if c in _MARKS}
        elif all(t in _MARKS for t in texts):
            marks.add(tuple(sorted(texts)))
    return tuple(sorted(marks))


_MARKS = set("()=\"'+%{}[]`*$:")


def _required(items) -> list[set[str]]:
    """Sets of texts; each set has at least one member in every match of the sequence."""
    options: list[set[str]] = []
    run = ""
    for op, arg in items:
        if op is sre.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        if run:
            options.append({run})
            run = ""
        if op is sre.SUBPATTERN:
            options += _required(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            options += _required(arg[2])
        elif op is sre.BRANCH:
            branches = [_required(branch) for branch in arg[1]]
            if all(branches):
                options.append(_drop_covered(set().union(*map(_most_selective, branches))))
        elif op is sre.IN and len(arg) <= 3 and all(kind is sre.LITERAL and chr(c) in _MARKS for kind, c in arg):
            options.append({chr(c) for _, c in arg})
    if run:
        options.append({run})
    return options


def _most_selective(options: list[set[str]]) -> set[str]:
    return max(options, key=lambda texts: (min(map(len, texts)), -len(texts)))


def _drop_covered(texts: set[str]) -> set[str]:
    """Without texts that hold another of the set: the shorter one finds them too."""
    return {t for t in texts if not any(o != t and o in t for o in texts)}
