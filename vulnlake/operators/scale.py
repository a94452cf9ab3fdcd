"""Numbering and running totals over a total order, without a single-task window.

The rows are range-partitioned on the order, so every task sorts only its share; the
totals of the partitions (a few rows) are then added up in order. Range bounds come from
sampling, so the partitioned rows are written once to the shared checkpoint folder and both
steps read that table: the places stay the same whichever executor is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vulnlake.session import ensure_checkpoint_dir


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go as soon as a write has ended."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared checkpoint folder: computed once, and still there if executors are lost."""
    spark = frame.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def _ranged(frame: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(frame.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def running_sums(frame: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Adds, per ``by`` group, running sums (inclusive) in the given order.

    ``order`` should identify a row; equal keys are ordered arbitrarily.
    """
    by = by or []
    ranged = _ranged(frame, by, order)
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*by, "_part"])
    return joined.select(*frame.columns, *[
        (F.sum(c).over(within) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()])


def number_rows(frame: DataFrame, order: list[Column], name: str = "row_no", by: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 per ``by`` group; one group may hold most of the rows."""
    return running_sums(frame, order, {name: F.lit(1)}, by).withColumn(name, F.col(name).cast("bigint"))


def literal_table(spark: SparkSession, rows: list[tuple], types: dict[str, pa.DataType]) -> DataFrame:
    """A few rows as a table whose number of rows and bytes the plan knows; rows from Python lists have no known size,
    and a join then sends the other side to all tasks."""
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types)))


def is_bounded(frame: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the plan itself proves an upper limit of rows (a limit or a literal table) and estimates few bytes."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    rows = plan.maxRows()
    return rows.isDefined() and int(str(rows.get())) <= most and int(str(plan.stats().sizeInBytes())) <= BROADCAST_BYTES


def bounded_broadcast(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only where the frame `is_bounded`; otherwise Spark chooses the join by measured size."""
    return F.broadcast(frame) if is_bounded(frame, most) else frame


def hash_of(col: Column) -> Column:
    """32 bits of an MD5 digest as a number; the same in every engine."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")


def shuffled_rank(frame: DataFrame, key: str, name: str = "rank", seed: int = 0) -> DataFrame:
    """Place of each row (from 1) in a reproducible shuffle by unique ``key``; adds ``_total``.

    Hash values spread evenly over 4096 buckets; ranks inside a bucket are shifted by the
    sizes of the buckets before it (4096 rows, broadcast). No task sorts more than a bucket.
    """
    hashed = frame.withColumn("_h", hash_of(F.concat_ws(":", F.lit(str(seed)), F.col(key)))).withColumn(
        "_b", F.shiftright("_h", 20).cast("int"))
    order = Window.orderBy("_b")
    sizes = hashed.groupBy("_b").count()
    offsets = sizes.select(
        "_b", F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("count").over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return (hashed.join(F.broadcast(offsets), "_b").withColumn(name, place + F.col("_before"))
            .drop("_h", "_b", "_before"))


def first_per_group(frame: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each group by an aggregate with map-side reduction."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*keys, "_f.*")


def cap_per_group(frame: DataFrame, key: str, limit: int, order: list[str], shares: int = 64) -> DataFrame:
    """The first ``limit`` rows of each group. Each group is cut down in shares first, so a
    group that holds most rows is not sorted whole by one task."""
    share = F.pmod(F.xxhash64(*order), F.lit(shares))
    inner = Window.partitionBy(key, "_share").orderBy(*order)
    outer = Window.partitionBy(key).orderBy(*order)
    cut = (frame.withColumn("_share", share).withColumn("_n", F.row_number().over(inner))
           .filter(F.col("_n") <= limit))
    return cut.withColumn("_n", F.row_number().over(outer)).filter(F.col("_n") <= limit).drop("_n", "_share")
