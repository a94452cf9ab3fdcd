"""An index of short texts by one gram each, so that a long text meets only those it may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.bitmaps import bitmap

GRAM = 3
#: The gram that every text holds besides its own.
EVERY_TEXT = 0
#: Rows of an index that are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_GRAMS = 200_000


def _gram(text: Column, at: Column) -> Column:
    """A number for the bytes of a gram; bytes are cut out in one step, however long the text."""
    return F.xxhash64(F.substring(text.cast("binary"), at, F.lit(GRAM)))


def grams(text: Column) -> Column:
    """Numbers of all grams of a text; none if it is shorter than one."""
    last = F.octet_length(text) - (GRAM - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: _gram(text, i))).otherwise(
        F.array().cast("array<bigint>"))


def looked_up(text: Column, index: DataFrame) -> Column:
    """The grams under which a text looks for what it may hold, each once; of those that a small index cannot hold, few."""
    asked = F.concat(grams(text), F.array(F.lit(EVERY_TEXT).cast("bigint")))
    count = index.count()
    return F.array_distinct(F.filter(asked, bitmap(index.select("gram"), count)) if count <= BROADCAST_GRAMS else asked)


#: Lengths of grams for tables of many parts that are alike; a part stands under grams of the greatest length it holds.
LENGTHS = (4, 8, 16, 32, 64)


def long_grams(text: Column) -> Column:
    """Numbers of the grams of a text that are of its greatest length in `LENGTHS`; none if it is shorter than all of them."""
    size, length = F.octet_length(text), F.lit(None).cast("int")
    for n in LENGTHS:
        length = F.when(size >= n, n).otherwise(length)
    return F.when(length.isNotNull(), grams_of(text, length)).otherwise(F.array().cast("array<bigint>"))


def grams_of(text: Column, length: Column | int) -> Column:
    """Numbers of all grams of one length, each once."""
    length = F.lit(length) if isinstance(length, int) else length
    last = F.octet_length(text) - length + 1
    data = text.cast("binary")
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(
        F.substring(data, i, length))))).otherwise(F.array().cast("array<bigint>"))


def rarest_grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows (keys, gram) the one whose gram is the rarest in the table.

    Exploded grams are many times what the plan estimates from the file they come from, so neither side may be broadcast."""
    uses = rows.groupBy("gram").agg(F.count("*").alias("uses"))
    return rows.hint("merge").join(uses, "gram").groupBy(*keys).agg(F.min_by("gram", F.struct("uses", "gram")).alias("gram"))


def sent_if_small(index: DataFrame) -> DataFrame:
    return F.broadcast(index) if index.count() <= BROADCAST_GRAMS else index
