"""Mixing sources to target weights.

Words are summed per source (with map-side reduction), targets follow from the weights, and the ratio of target to size is
the repetition rate: a document is emitted floor(rate) times, and once more if its seeded draw is below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import table, without, words, written
from vulnlake.operators.scale import hash_of, number_rows

BROADCAST_SOURCES = 50_000
BROADCAST_BYTES = 8 << 20


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources take the weights in turn, by code point, null last. They share the total of all sizes by weight; a target stops
    at ``cap`` times the source's size, and the excess goes to the others by weight until none is above. A source without
    words gets 0. Each round is one aggregate over the sources; only the totals come to the driver.
    """
    ordered = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "_n")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(ordered.select("source", "source_size", weight.alias("_w")), "sources")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total = rows.agg(F.sum(exact("source_size"))).first()[0] or Decimal(0)
    free, shared = F.lit(True), total
    capped = None
    while True:
        left = rows.filter(free).agg(F.sum(exact("_w")).alias("w"), F.count("*").alias("n")).first()
        over_weight = left["w"] or Decimal(1)
        above = free & (cap * exact("source_size") * F.lit(over_weight) < F.lit(shared) * exact("_w"))
        if capped == left["n"]:
            break
        capped = left["n"]
        taken = rows.filter(~free | above).agg(F.sum(exact("source_size"))).first()[0] or Decimal(0)
        free, shared = free & ~above, total - cap * taken
    share = F.lit(float(shared)) * F.col("_w") / F.lit(float(over_weight))
    return rows.select("source", "source_size", F.when(free, share).otherwise(
        (cap * F.col("source_size")).cast("double")).alias("target"))


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 0, doc_id: str = "doc_id",
                source: str = "source", text: str = "text") -> DataFrame:
    """The documents with size, source_size, target, rate and copies.

    A null text has size 0, null sources are one source. Equal ids get equal draws, null ids draw as the empty id; reruns
    agree. Columns of the input that bear a result's name give way to it.
    """
    made = ["size", "source_size", "target", "rate", "copies"]
    sized = without(docs, [*made, "_source"]).withColumn("size", F.size(words(F.col(text))).cast("bigint"))
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, cap).withColumnRenamed("source", "_source")
    extent = targets.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 32).alias("b")).first()
    if extent["n"] <= BROADCAST_SOURCES and (extent["b"] or 0) <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)
    return joined.withColumn("copies", (F.floor("rate") + (_draw(F.col(doc_id), seed) < F.col("rate") - F.floor("rate"))
                                        .cast("bigint")).cast("bigint"))


def _draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1, the same for the same id and seed."""
    return hash_of(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))) / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as its plan says, with copy_no from 1; documents without a copy are left out."""
    plan = without(mixing_plan(docs, **options), ["copy_no"]).filter("copies > 0")
    return plan.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))


def op3_mix_sources(spark, folder):
    plan = mixing_plan(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % 3 AS BIGINT) AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, CAST(sum(source_size) OVER () AS HUGEINT) - 3 * coalesce(sum(source_size) OVER lower, 0) AS shared,
         sum(w) OVER () - coalesce(sum(w) OVER lower, 0) AS weight
  FROM sources
  WINDOW lower AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * source_size * weight < shared * w AS capped FROM ordered),
left_over AS (
  SELECT sum(CASE WHEN capped THEN 0 ELSE w END) AS weight,
         (SELECT sum(source_size) FROM sources) - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) AS shared FROM marked),
targets AS (
  SELECT m.source, m.source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(l.shared AS DOUBLE) * m.w / CAST(l.weight AS DOUBLE) END AS target FROM marked m, left_over l),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
