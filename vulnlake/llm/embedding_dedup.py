"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. Sign hashes of random rotations order the nodes; neighbours in several such orders
start a graph of near neighbours. Each round joins the neighbours of a node with one another, keeps the nearest, and lists
that are full of links grow twice as long. Pairs at or above the threshold are links. Recall is audited on a bounded sample
of nodes compared with all vectors; while it is too low, the graph gets further orders and rounds. Links of a component are
then completed: its members are compared block by block, so the numbers of links are those of all pairs of the component and
no list's length bounds them; only counts leave a block.

Vectors link only if their labels are equal and not null, and their lengths too. Vectors that are null, zero or hold null or
non-finite components have no link, nor do those with a null label; each is its own component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.llm.common import components, forget, runs, table, written
from vulnlake.operators.scale import number_rows

BITS = 16
AUDITED = 256
BLOCK = 512
EDGE = "a bigint, b bigint, cosine double"


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all have the same number of components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _edges(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine)], ["a", "b", "cosine"])


def _windows(nodes: DataFrame, order: int, seed: int, reach: int, keep: int) -> DataFrame:
    """Nearest ``keep`` of the ``reach`` nodes on either side in one order of the nodes, by label and sign hash."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            key = np.zeros(batch.num_rows, np.int64)
            for size in np.unique(sizes):
                here = np.flatnonzero(sizes == size)
                x = _units(batch.column(2).take(pa.array(here)))
                turn = np.random.default_rng((seed, order, int(size))).standard_normal((int(size), BITS + 1))
                y = x @ turn
                code = ((y[:, :BITS] > 0).astype(np.int64) << np.arange(BITS)).sum(1)
                key[here] = (code << 20) + np.clip((y[:, BITS] + 4) * (1 << 17), 0, (1 << 20) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["node", "g", "v", "key"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 1):  # one or more whole labels of this task
            ids, groups = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            for g in np.unique(groups):
                low, high = np.searchsorted(groups, g, "left"), np.searchsorted(groups, g, "right")
                x, own = _units(rows.column(2).slice(low, high - low).combine_chunks()), ids[low:high]
                n = len(own)
                if n < 2:
                    continue
                found = np.full((n, 2 * reach), -2.0)
                for o in range(1, min(reach, n - 1) + 1):
                    c = np.einsum("ij,ij->i", x[:-o], x[o:])
                    found[:-o, o - 1], found[o:, reach + o - 1] = c, c
                best = np.argsort(-found, 1, kind="stable")[:, :keep]
                score = np.take_along_axis(found, best, 1)
                other = np.arange(n)[:, None] + np.where(best < reach, best + 1, reach - 1 - best)
                some = score > -2
                yield _edges(np.repeat(own, some.sum(1)), own[other[some]], score[some])

    hashed = nodes.select("node", "g", "v").mapInArrow(keyed, "node bigint, g bigint, v array<float>, key bigint")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hashed.repartitionByRange(parts, "g", "key").sortWithinPartitions("g", "key").select("node", "g", "v").mapInArrow(near, EDGE)


def _nearest(edges: DataFrame, k: int, long: int, threshold: float) -> DataFrame:
    """The k nearest of each node; of links, the ``long`` nearest."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return (edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("_r", rank).filter(F.col("_r") <= long)
            .filter((F.col("_r") <= k) | (F.col("cosine") >= threshold)).drop("_r"))


def _joined(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b, cosine) of neighbours of a common node that are nearer than the last in either list, or links."""
    last = graph.groupBy("a").agg(F.min("cosine").alias("least"))
    back = graph.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("cosine"), "a"))).filter(F.col("_r") <= 2 * k)
    members = graph.select(F.col("a").alias("centre"), F.col("b").alias("node")).union(
        back.select(F.col("b").alias("centre"), F.col("a").alias("node"))).distinct()
    rows = members.join(nodes.select("node", "v"), "node").join(last.withColumnRenamed("a", "node"), "node", "left")
    rows = rows.select("centre", "node", F.coalesce("least", F.lit(-2.0)).alias("least"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 0):
            centre, ids, least = (run.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
            out, held = [], 0
            vectors = run.column(3).combine_chunks()
            for low, high in zip(starts, np.append(starts[1:], len(centre)), strict=True):
                if high - low < 2:
                    continue
                x = _units(vectors.slice(low, high - low))  # of one label, so of one length
                c = x @ x.T
                i, j = np.triu_indices(high - low, 1)
                s = c[i, j]
                good = (s > np.minimum(least[low + i], least[low + j])) | (s >= threshold)
                out.append((ids[low + i[good]], ids[low + j[good]], s[good]))
                held += int(good.sum())
                if held > 50_000:
                    yield _edges(*[np.concatenate([o[n] for o in out]) for n in range(3)])
                    out, held = [], 0
            if out:
                yield _edges(*[np.concatenate([o[n] for o in out]) for n in range(3)])

    found = rows.repartition("centre").sortWithinPartitions("centre").mapInArrow(compare, EDGE)
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).filter("a <> b")


def _audit(nodes: DataFrame, threshold: float, most: int) -> DataFrame:
    """All links of at most ``most`` nodes, drawn by hash, from comparing them with every node."""
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(most).collect()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["g"] for r in drawn}:
        own = [r for r in drawn if r["g"] == g]
        x = np.array([r["v"] for r in own], np.float64)
        asked[g] = (np.array([r["node"] for r in own]), x / np.sqrt((x * x).sum(1, keepdims=True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for g in np.unique(groups):
                if g in asked:
                    here = np.flatnonzero(groups == g)
                    c = asked[g][1] @ _units(batch.column(2).take(pa.array(here))).T
                    i, j = np.nonzero(c >= threshold)
                    yield _edges(asked[g][0][i], ids[here[j]], c[i, j])

    return nodes.select("node", "g", "v").mapInArrow(compare, EDGE).filter("a <> b")


def _completed(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(node, links): vectors that link with a node, from all pairs of its component, in blocks."""
    members = number_rows(groups.join(nodes.select(F.col("node").alias("id"), "n"), "id"), [F.col("id")], "no", ["component"])
    placed = members.select("id", "component", "n", F.floor((F.col("no") - 1) / BLOCK).alias("block"))
    sizes = placed.groupBy("component").agg((F.max("block") + 1).alias("blocks"))
    both = placed.join(sizes, "component").select(
        "id", "component", "n", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("with"))
    both = both.select("id", "component", "n", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    rows = both.join(nodes.select(F.col("node").alias("id"), "v"), "id")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["v"].tolist(), np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        ids, n, block = frame["id"].to_numpy(), frame["n"].to_numpy(), frame["block"].to_numpy()
        linked = x @ x.T >= threshold
        if frame["i"].iloc[0] != frame["j"].iloc[0]:
            linked &= block[:, None] != block[None]
        np.fill_diagonal(linked, False)
        return pd.DataFrame({"node": ids, "links": linked @ n})

    counted = rows.groupBy("component", "i", "j").applyInPandas(count, "node bigint, links bigint")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def find_links(vectors: DataFrame, threshold: float = 0.98, k: int = 8, orders: int = 8, reach: int = 8, rounds: int = 3, recall: float = 0.97,
               repeats: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, groups, links) of vectors (vec_id, embedding, label): rows (vec_id, node) with a null node where nothing links,
    components of nodes (id, component), and (node, links)."""
    v = F.col("embedding").cast("array<float>")
    finite = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall(v, _finite), F.lit(False)) & F.coalesce(
        F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(finite, F.xxhash64("label", v)).alias("node"), F.xxhash64("label", F.size(v)).alias("g"), v.alias("v"))
    rows = written(rows, "vectors")
    nodes = written(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("g").alias("g"), F.first("v").alias("v"), F.count("*").alias("n")), "nodes")
    truth = written(_audit(nodes, threshold, AUDITED), "audit")
    asked, graph, used, long = truth.count(), None, 0, 2 * k
    for _ in range(repeats):
        for order in range(used, used + orders):
            more = _windows(nodes, order, seed, reach, k // 2)
            graph = more if graph is None else graph.union(more)
        used += orders
        graph = written(_nearest(graph, k, long, threshold), "graph")
        found = written(graph.filter(F.col("cosine") >= threshold), "links")
        for _ in range(rounds):
            better = written(_joined(graph, nodes, k, threshold), "better")
            links = written(found.union(better.filter(F.col("cosine") >= threshold)).distinct(), "links")
            long *= 2
            after = written(_nearest(graph.union(better), k, long, threshold), "graph")
            changed = after.join(graph, ["a", "b"], "left_anti").count()
            forget(graph, better, found)
            graph, found = after, links
            if changed * 1000 < nodes.count() * k:
                break
        groups = written(components(found.select("a", "b")), "components")
        if not asked:
            break
        same = truth.join(groups.select(F.col("id").alias("a"), F.col("component").alias("ga")), "a").join(
            groups.select(F.col("id").alias("b"), F.col("component").alias("gb")), "b").filter("ga = gb").count()
        if same >= recall * asked:
            break
    # Links that the audit saw count as well.
    groups = written(components(found.select("a", "b").union(truth.select("a", "b"))), "components")
    return rows, groups, written(_completed(nodes, groups, threshold), "counts")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector; equal ids are judged by their own vectors."""
    rows, groups, links = find_links(vectors, **options)
    copies = rows.filter("node IS NOT NULL").groupBy(F.col("node").alias("_n")).agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    known = copies.join(groups.select(F.col("id").alias("_n"), "component"), "_n", "left").join(
        links.select(F.col("node").alias("_n"), "links"), "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = known.join(smallest, "component").select("_n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(of_node, F.col("node") == F.col("_n"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
