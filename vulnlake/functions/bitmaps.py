"""A bitmap of hashes as a literal, so that rows without a known hash are told apart before they are looked up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most bits of a bitmap.
BITS_EACH, MOST_BITS = 32, 1 << 22


def bitmap(hashes: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test that holds for every hash in the one column of ``hashes`` and for few others; ``count`` is about how many there are."""
    size = 1 << min(max(count * BITS_EACH - 1, 1 << 12).bit_length(), MOST_BITS.bit_length() - 1)
    slot = lambda h: F.pmod(h, F.lit(size).cast("bigint"))
    word, bit = lambda s: F.shiftright(s, 6).cast("int"), lambda s: s.bitwiseAND(F.lit(63)).cast("int")
    slots = hashes.select(slot(F.col(f"`{hashes.columns[0]}`")).alias("s"))
    words = dict(slots.groupBy(word(F.col("s")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("s"))))).collect())
    known = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(size >> 6))), ",").cast("array<bigint>")  # folded into one literal
    return lambda h: F.getbit(F.get(known, word(slot(h))), bit(slot(h))) == 1
