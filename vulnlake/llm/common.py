"""What the operators of this package share: reading, words, written tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns that bear one of the names, in any case."""
    taken = {n.lower() for n in names}
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken])


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared checkpoint folder: computed once, and still there if executors are lost.

    The shuffle files of the write are of no use after it and are removed at once.
    """
    folder = f"{ensure_checkpoint_dir(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(folder)
    finally:
        conf.set(CLEANUP, before)
    table = frame.sparkSession.read.schema(frame.schema).parquet(folder)
    table._written_to = folder
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id of an undirected link reaches; ids without a link are not listed.

    Every id takes the smallest id around it as its parent and then its parent's parent until it stands still. Links between
    the roots found so are all that is left; each root moves to the smallest root it is linked with, and so on until no link
    joins two roots. Every step is an aggregate with map-side reduction or a join of narrow tables, written once.
    """
    pairs = written(links.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b"), "edges")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = _flattened(written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents"))
    edges = pairs
    while True:
        up = parents.select(F.col("a").alias("k"), "p")
        left = written(edges.join(up.select(F.col("k").alias("a"), F.col("p").alias("pa")), "a")
                       .join(up.select(F.col("k").alias("b"), F.col("p").alias("pb")), "b").filter("pa <> pb")
                       .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges")
        forget(edges)
        edges = left
        if left.isEmpty():
            forget(left)
            return parents.select(F.col("a").alias("id"), F.col("p").alias("component"))
        hooks = left.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("to"))
        moved = written(parents.join(hooks, F.col("a") == F.col("k"), "left").select("a", F.coalesce("to", "p").alias("p")), "parents")
        forget(parents)
        parents = _flattened(moved)


def _flattened(parents: DataFrame) -> DataFrame:
    """Every id under its root; the parents of roots are the roots themselves."""
    while True:
        above = parents.filter("a <> p").select(F.col("a").alias("k"), F.col("p").alias("pp"))
        step = written(parents.join(above, F.col("p") == F.col("k"), "left").select(
            "a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("_moved")), "parents")
        forget(parents)
        done = step.filter("_moved").isEmpty()
        parents = step.select("a", "p")
        parents._written_to = step._written_to
        if done:
            return parents


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Sums of all values before each one, row by row; arrays of n values take n * sqrt(n) steps at most."""
    zero = F.lit(0).cast("bigint")

    def plain(array: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("sum"))
        return F.aggregate(array, start, lambda s, x: F.struct(
            F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).alias("sum")))["out"]

    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    size = F.greatest(F.lit(block), F.ceil(F.sqrt(F.size(values))).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.size(values), size), lambda i: i < F.size(values))
    blocks = F.transform(starts, lambda i: F.slice(values, i + 1, size))
    offsets = plain(F.transform(blocks, total))
    return F.when(F.size(values) <= block, plain(values)).otherwise(F.flatten(F.zip_with(
        blocks, offsets, lambda b, o: F.transform(plain(b), lambda x: x + o))))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bounds the batches that go to Python workers, as whole texts and their sets can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """Sends a value of bounded size to all tasks; the function gives it there.

    It is pickled here, where the classes of this package go along by value, so tasks need not be able to import the package.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(data.value)


def runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Batches of sorted rows, cut so that no key goes over the end of one."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = rows.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
