"""Text helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def computed_once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions filters above cannot copy.

    Filter pushdown replaces a projected column by its expression in every predicate that
    uses it; a one-element explode is a boundary it does not cross.
    """
    for name, expression in columns.items():
        frame = frame.select("*", F.explode(F.array(expression)).alias(name))
    return frame


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(BLANKS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(BLANKS))


def lines_of(col: Column) -> Column:
    """All lines as an array, empty ones kept."""
    return F.split(col, "\n", -1)


def explode_lines(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per line with its number from 1; the whole text is not carried along."""
    kept = keep if keep is not None else [c for c in files.columns if c != text]
    return files.select(*kept, F.posexplode(lines_of(F.col(text))).alias("_pos", "line")).select(
        *kept, (F.col("_pos") + 1).alias("line_no"), "line")


def count_of(col: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a text."""
    return ((F.char_length(col) - F.char_length(F.replace(col, F.lit(needle), F.lit(""))))
            / len(needle)).cast("int")


def contains_any(col: Column, texts) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(t) for t in texts])


def rlike_any(col: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [col.rlike(p) for p in patterns])


def regex(pattern: str, ignore_case: bool = False, unicode: bool = False) -> str:
    """Pattern with flags under which a dot stops at line feeds only, as the rules expect."""
    return "(?d)" + ("(?i)" if ignore_case else "") + ("(?U)" if unicode else "") + pattern


def abbreviate(col: Column, limit: int, keep: int, mark: str = "...") -> Column:
    """First ``keep`` characters and a mark where the text is longer than ``limit``."""
    return F.when(F.char_length(col) > limit, F.concat(F.substring(col, 1, keep), F.lit(mark))).otherwise(col)


def html_escape(col: Column) -> Column:
    """Escapes & < > and both quotes; null becomes an empty text."""
    steps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    escaped = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, col)
    return F.coalesce(escaped, F.lit(""))


def line_excerpt(text: Column, line: Column, context: int = 1) -> Column:
    """The line with its neighbours, joined by line feeds."""
    lines = lines_of(text)
    first = F.greatest(F.lit(1), line - context)
    last = F.least(F.size(lines), line + context)
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")


def slug(col: Column) -> Column:
    return F.lower(F.replace(col, F.lit(" "), F.lit("_")))


def capitalize_words(col: Column) -> Column:
    """First character of every run of word characters in upper case, the rest as it is."""
    runs = F.regexp_extract_all(col, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def title_case(col: Column) -> Column:
    """Every run of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def title_of_rule_id(col: Column) -> Column:
    """``a.b.sql-injection`` gives ``Sql Injection``."""
    return title_case(F.replace(F.element_at(F.split(col, "\\."), -1), F.lit("-"), F.lit(" ")))
