"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``times`` q and ``least`` words long, that no neighbouring word
extends. For each power of two b the factors of b words are named: equal factors of a document have equal names, those of 2b
words are pairs of those of b. The next occurrence of a factor within twice its length is its successor, at a distance d; where
neighbouring factors have successors at the same distance these form an arithmetic progression and propose the period d.

Distances in (b / 2, b] are taken at level b, so each period is proposed at one level only and no run twice. A run has q <= b
there, and as its root is primitive no factor of b words in it recurs before q words: the progression starts with the run and
ends b + d words before it does. So a proposal is extended by b + d words and is then a whole run with its smallest period,
for ``times`` of 3 or more. Names that occur once cannot lie in a run and are dropped before the next level.

Words are runs of anything but ASCII white space and are compared byte by byte. Null and blank texts have none. Rows are worked
on alone, whatever their ids and other columns: repeated rows get equal results and empty tables none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import small_batches, table, words

#: Words of short documents that are named at once.
CHUNK = 300_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def runs_of(names: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of word names; ``ends`` is where a place's document ends."""
    if times < 3:
        raise ValueError("runs of less than three periods are not found whole")
    n, b, found = len(names), 1, [np.zeros((0, 3), np.int64)]
    places, level, named = np.arange(n), np.full(n, -1, np.int64), np.zeros(0, np.int64)
    longest = int(np.diff(np.concatenate(([0], np.unique(ends)))).max()) if n else 0
    while len(places) and times * (b // 2 + 1) <= longest:
        order = np.argsort(names, kind="stable")  # places of a name stay in order
        at, name = places[order], names[order]
        same = name[1:] == name[:-1]
        distance = np.where(same, at[1:] - at[:-1], 0)
        near = (distance > b // 2) & (distance <= b)
        start, d = at[:-1][near], distance[near]
        order = np.argsort(start)
        start, d = start[order], d[order]
        if len(start):
            fresh = np.ones(len(start), bool)
            fresh[1:] = (start[1:] != start[:-1] + 1) | (d[1:] != d[:-1])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(start)) - 1
            length = start[last] - start[first] + d[first] + b
            whole = length >= np.maximum(least, times * d[first])
            found.append(np.stack([start[first], length, d[first]], 1)[whole])
        again = np.zeros(len(at), bool)
        again[:-1] |= same
        again[1:] |= same
        level[named] = -1
        named = at[again]
        level[named] = np.concatenate(([0], np.cumsum(~same)))[again]
        places = np.sort(named)
        places = places[places + 2 * b <= ends[places]]
        places = places[level[places + b] >= 0]
        names = level[places] * (n + 1) + level[places + b]
        b *= 2
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _worked(texts: list, least: int, times: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, words outside repeats joined by spaces) of each of some texts."""
    split = [(text or b"").split() for text in texts]  # bytes are split at ASCII white space only
    together = [word for part in split for word in part]
    seen = {word: i for i, word in enumerate(dict.fromkeys(together))}
    sizes = np.array([len(part) for part in split], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(split)), sizes)
    ids = np.fromiter(map(seen.__getitem__, together), np.int64, len(together))
    runs = runs_of(owner * len(seen) + ids, ends[owner], least, times)
    change = np.zeros(len(together) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    begin = ends - sizes
    low, high = np.searchsorted(runs[:, 0], begin), np.searchsorted(runs[:, 0], ends)
    for i, part in enumerate(split):
        own = runs[low[i]:high[i]] - [begin[i], 0, 0]
        yield len(part), own, b" ".join(compress(part, keep[begin[i]:ends[i]]) if len(own) else part)


def _finder(least: int, times: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            done, part, size = [], [], 0
            for i, text in enumerate(texts):
                part.append(text)
                size += len(text or b"")
                if size > 6 * CHUNK or i == len(texts) - 1:
                    done.extend(_worked(part, least, times))
                    part, size = [], 0
            runs = np.concatenate([r for _, r, _ in done]) if done else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for _, r, _ in done]))).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for n, _, _ in done], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs),
                 pa.array([c for _, _, c in done], pa.binary()).cast(pa.string())],
                [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    return rows


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row for each row of the input.

    ``runs`` are (start, length, period) by start and period, counted in words from 0. ``collapsed`` is the text without what
    stands in a run after its first period, its words joined by one space; '' for a null text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_finder(least, times), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period of an array in order; the first of equal ones, null if there is none."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.lit(0), F.size(runs) - 1)), F.get(runs, F.lit(0)),
                       lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, repeats a stretch of its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeating(array: Column) -> Column:
        n = F.size(array).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
            array, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    planted = F.transform(F.array(words(F.col("text"))), lambda array: F.when(F.size(array) > 0, repeating(array)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, folder):
    found = find_runs(with_planted_runs(table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
