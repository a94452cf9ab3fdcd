"""Anchors of near lines: which line of a file each finding is merged into.

Lines of a file come in some order. A line joins the earliest line before it in that order that is an anchor and at most two
lines away; if there is none it becomes an anchor itself. Whether a line is an anchor so depends on the four lines around
it only, and through them on all lines of a run of near lines, which may be as long as its file.

So a file is cut into pieces of SIZE line numbers. What is inside a piece depends on the outside only by four bits: whether the
last two lines before it and the first two lines after it are anchors. A piece is a function from these bits to those it shows to
its own neighbours (its first two and last two lines). Functions of neighbouring pieces are composed: the bits between
them are the only ones on which both agree, as the order of lines leaves one solution. Composition is associative, so
GROUP functions at a time become one, level by level, until a file has a single one; then the bits between pieces are handed
down the same levels, and every piece finds its anchors alone. No task holds more than a piece or a group of functions.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.scale import kept

NEAR = 2  # fixed value: lines at this distance or nearer are one issue
SIZE, GROUP = 4096, 1024


def anchors(lines: list[int], outside: set[int]) -> dict[int, int]:
    """The anchor of each line; lines come in order, ``outside`` holds those of other pieces that are anchors.

    A line of another piece is in ``lines`` at its place of the order, too, so that only those before a line count for it.
    """
    found, place = {}, {}
    for line in lines:
        if line in outside:
            place[line] = len(place)
        elif line not in found:
            near = [x for x in range(line - NEAR, line + NEAR + 1) if x in place]
            found[line] = min(near, key=place.__getitem__) if near else line
            if not near:
                place[line] = len(place)
    return found


def _bits(places: Iterable[int], found: dict[int, int]) -> int:
    return sum(1 << i for i, p in enumerate(places) if found.get(p) == p)


def function_of(lines: list[int], piece: int, size: int) -> int:
    """A piece as 16 values of four bits, packed: for bits (before 2, after 2) those of its first two and last two lines."""
    low, high = piece * size, (piece + 1) * size
    own = {x for x in lines if low <= x < high}
    packed = 0
    for outer in range(16):
        outside = {x for i, x in enumerate((low - 2, low - 1, high, high + 1)) if outer >> i & 1}
        dead = {x for x in lines if x not in own and x not in outside}
        found = anchors([x for x in lines if x not in dead], outside)
        packed |= _bits((low, low + 1, high - 2, high - 1), found) << 4 * outer
    return _signed(packed)


def _signed(packed: int) -> int:
    """As a number of 64 bits with a sign; reading four bits of it works as before."""
    return packed - (1 << 64) if packed >> 63 else packed


def shown(function: int, before: int, after: int) -> tuple[int, int]:
    """(bits of the first two lines, bits of the last two) for those before and after."""
    value = function >> 4 * (before | after << 2) & 15
    return value & 3, value >> 2


def between(left: int, right: int, before: int, after: int) -> tuple[int, int]:
    """(last bits of the left one, first bits of the right one) on which two neighbours agree."""
    for first in range(4):
        last = shown(left, before, first)[1]
        if shown(right, last, after)[0] == first:
            return last, first
    raise ValueError("neighbours do not agree; is the order of lines total?")


def composed(left: int, right: int) -> int:
    packed = 0
    for outer in range(16):
        before, after = outer & 3, outer >> 2
        last, first = between(left, right, before, after)
        packed |= (shown(left, before, first)[0] | shown(right, last, after)[1] << 2) << 4 * outer
    return _signed(packed)


#: A stretch without lines: nothing near it is an anchor, whatever is around.
NOTHING = 0


def _chain(functions: list[tuple[int, int]], first: int, last: int) -> list[tuple[int | None, int]]:
    """(piece, function) from ``first`` to ``last``, with one that shows nothing wherever pieces are missing."""
    out, expected = [], first
    for piece, function in functions:
        if piece != expected:
            out.append((None, NOTHING))
        out.append((piece, function))
        expected = piece + 1
    return out if expected == last + 1 else [*out, (None, NOTHING)]


def whole_of(functions: list[tuple[int, int]], first: int, last: int) -> int:
    """The function of all pieces from ``first`` to ``last``."""
    chain = _chain(functions, first, last)
    total = chain[-1][1]
    for _, function in reversed(chain[:-1]):
        total = composed(function, total)
    return total


def handed_down(functions: list[tuple[int, int]], first: int, last: int, before: int, after: int) -> list[tuple[int, int, int]]:
    """(piece, bits before, bits after) of each of the pieces, from the bits around all of them."""
    chain = _chain(functions, first, last)
    rest = [chain[-1][1]]
    for _, function in reversed(chain[1:-1]):
        rest.append(composed(function, rest[-1]))
    rest.reverse()  # rest[i]: the function of all after place i
    out = []
    for i, (piece, function) in enumerate(chain):
        ends, begins = between(function, rest[i], before, after) if i + 1 < len(chain) else (0, after)
        if piece is not None:
            out.append((piece, before, begins))
        before = ends
    return out


# Numbers of pieces are shifted to be positive, so that those of any file meet in one group some levels up.
_SHIFT = 1 << 40


def _function_of(size: int):
    @F.pandas_udf("bigint")
    def function(lines: pd.Series, piece: pd.Series) -> pd.Series:
        return pd.Series([function_of(x.tolist(), p - _SHIFT, size) for x, p in zip(lines, piece.tolist(), strict=True)], dtype="int64")

    return function


def _whole_of(group: int):
    @F.pandas_udf("bigint")
    def function(pieces: pd.Series, functions: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([whole_of(list(zip(p.tolist(), f.tolist(), strict=True)), n * group, n * group + group - 1)
                          for p, f, n in zip(pieces, functions, number.tolist(), strict=True)], dtype="int64")

    return function


def _handed_down(group: int):
    @F.pandas_udf("array<array<bigint>>")
    def bits(pieces: pd.Series, functions: pd.Series, number: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([[list(x) for x in handed_down(list(zip(p.tolist(), f.tolist(), strict=True)), n * group, n * group + group - 1, b, a)]
                          for p, f, n, b, a in zip(pieces, functions, number.tolist(), before.tolist(), after.tolist(), strict=True)])

    return bits


def _anchors_of(size: int):
    @F.pandas_udf("array<bigint>")
    def found(lines: pd.Series, piece: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for own, p, b, a in zip(lines, piece.tolist(), before.tolist(), after.tolist(), strict=True):
            low, high = (p - _SHIFT) * size, (p - _SHIFT + 1) * size
            own = own.tolist()
            outside = {x for i, x in enumerate((low - 2, low - 1, high, high + 1)) if (b | a << 2) >> i & 1}
            known = anchors([x for x in own if low <= x < high or x in outside], outside)
            out.append([known.get(x) for x in own])
        return pd.Series(out)

    return found


def with_anchors(lines: DataFrame, order: Column, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Adds ``anchor`` to lines (file_id, line, ..), of which each file holds a number once; ``order`` tells which comes first.

    A null line is its own anchor.
    """
    columns = [c for c in lines.columns if c != "file_id"]
    number = F.coalesce(F.col("line").cast("bigint"), F.lit(-(1 << 40)))
    piece = F.floor(number / size) + _SHIFT
    place = F.pmod(number, F.lit(size))
    near = F.when(place < NEAR, F.array(piece, piece - 1)).when(place >= size - NEAR, F.array(piece, piece + 1)).otherwise(F.array(piece))
    rows = lines.select("*", order.alias("_at"), number.alias("_line"), piece.alias("_own"), F.explode(near).alias("_piece"))
    mine = F.col("_own") == F.col("_piece")
    folded = rows.groupBy("file_id", "_piece").agg(F.sort_array(F.collect_list(F.struct(
        "_at", "_line", F.when(mine, F.struct(*columns)).alias("row")))).alias("_rows"), F.max(~mine).alias("_crossing"))
    folded = kept(folded.withColumn("_lines", F.transform("_rows", lambda r: r["_line"])).withColumn(
        "_rows", F.transform("_rows", lambda r: r["row"])), "near-lines")
    bits = _bits_of_pieces(folded.filter("_crossing").select("file_id", "_piece", "_lines"), size, group)
    if bits is None:
        around = folded.withColumn("_before", F.lit(0)).withColumn("_after", F.lit(0))
    else:
        known = bits.select(F.col("file_id").alias("_file"), F.col("piece").alias("_p"), "before", "after")
        around = folded.join(known, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("_piece") == F.col("_p")), "left").withColumn(
            "_before", F.coalesce("before", F.lit(0))).withColumn("_after", F.coalesce("after", F.lit(0)))
    found = around.select("file_id", "_rows", _anchors_of(size)("_lines", "_piece", "_before", "_after").alias("_anchors"))
    pairs = F.filter(F.arrays_zip(F.col("_rows").alias("row"), F.col("_anchors").alias("anchor")), lambda z: z["row"].isNotNull())
    opened = found.select("file_id", F.inline(pairs))
    kind = lines.schema["line"].dataType
    return opened.select("file_id", "row.*", F.when(F.col("row.line").isNotNull(), F.col("anchor")).cast(kind).alias("anchor"))


def _bits_of_pieces(crossing: DataFrame, size: int, group: int) -> DataFrame | None:
    """(file_id, piece, before, after) of pieces with lines of their neighbours; None if there are none."""
    level = kept(crossing.select("file_id", F.col("_piece").alias("piece"), _function_of(size)("_lines", "_piece").alias("function")), "functions")
    if level.isEmpty():
        return None
    levels = []
    while True:
        both = F.sort_array(F.collect_list(F.struct("piece", "function")))
        grouped = level.groupBy("file_id", F.floor(F.col("piece") / group).alias("number")).agg(both.alias("both"))
        grouped = kept(grouped.select("file_id", "number", F.col("both.piece").alias("pieces"), F.col("both.function").alias("functions")), "groups")
        levels.append(grouped)
        if grouped.groupBy("file_id").count().filter("count > 1").isEmpty():
            break
        level = grouped.select("file_id", F.col("number").alias("piece"), _whole_of(group)("pieces", "functions", "number").alias("function"))
    bits = levels[-1].select("file_id", F.col("number").alias("piece"), F.lit(0).alias("before"), F.lit(0).alias("after"))
    for grouped in reversed(levels):
        around = bits.select(F.col("file_id").alias("_file"), F.col("piece").alias("number"), "before", "after")
        both = grouped.alias("g").join(around.alias("a"), F.col("g.file_id").eqNullSafe(F.col("_file")) & (F.col("g.number") == F.col("a.number")))
        down = both.select("file_id", F.explode(_handed_down(group)("pieces", "functions", "g.number", "before", "after")).alias("b"))
        bits = down.select("file_id", F.col("b")[0].alias("piece"), F.col("b")[1].alias("before"), F.col("b")[2].alias("after"))
    return bits
