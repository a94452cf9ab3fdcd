"""Ranked text search over the columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points per kind of match.
EXACT, PREFIX, INSIDE = 100, 50, 10


def search(rows: DataFrame, text: str, columns: list[str], limit: int, ties: list[str], least: int = 1) -> DataFrame:
    """The best rows for a text; each column adds points for an exact, leading or inner match."""
    wanted = text.lower()
    score = F.lit(0)
    for name in columns:
        value = F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
        score = score + (F.when(value == wanted, EXACT).when(value.startswith(wanted), PREFIX)
                         .when(value.contains(wanted), INSIDE).otherwise(0))
    if len(text) < least:
        score = F.lit(0)
    return rows.withColumn("score", score).filter(F.col("score") > 0).orderBy(F.desc("score"), *ties).limit(limit)
