"""N-gram Jaccard join by universe partition.

A document's set are the hashes of its distinct word n-grams. Sets that reach the Jaccard threshold differ in at most H
elements, H following from their sizes. The universe of hashes is dealt out to segments, more of them for larger sizes: with
allowances that add up to H + 1, two such sets agree on one segment within its allowance. An allowance of one is a segment's
sum hash; an allowance of two adds the segment's one-deletion neighbourhood. How many of each a size band gets is chosen by
cost. Segments of fewer than two elements are not indexed, as these meet much that is not alike; slack in the allowances makes
up for them, and the few sets that lose more than their slack index all. So no pair is lost, and candidates are verified on the
whole sets, once a sketch of element counts in bins (sets differ at least by what their counts differ) does not rule them out.

Documents with equal sets are one class from the start, so copies are never paired. In a bucket of classes the one with the
smallest key is the centre: first each class is verified against the centre it shares most buckets with, then against its
other centres unless both are in one component by now. Buckets that still hold several components are compared inside, block
by block on the sketches. Twice each class first takes only the nearest one of another component out of a block, which joins
most that belongs together and makes no more rows than come in; of what is open then, all pairs that may link leave a block.
Every link either is verified or joins classes that are in one component anyway.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.llm.common import components, forget, runs, small_batches, table, written
from vulnlake.operators.scale import number_rows

BAND = 1.4
BROADCAST_SETS = 200_000
CHUNK = 400_000
RARE = 1e-3
BINS = 256
BLOCK = 1024


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, one after the other, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = split.flatten().dictionary_encode()
    known = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in found.dictionary.cast(pa.binary()).to_pylist())
    full = pc.binary_length(found.dictionary).to_numpy(zero_copy_only=False) > 0  # a text has empty words at its ends
    codes = found.indices.to_numpy(zero_copy_only=False)
    real = full[codes] if len(full) else np.zeros(0, bool)
    ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.diff(np.append(0, np.cumsum(real))[np.append(0, ends)])
    return np.frombuffer(known, np.uint64)[codes[real]], counts


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the texts' n-grams, one text after the other, the sizes of these sets and two keys of each.

    A shorter text has one, of all its words, and one without words has none.
    """
    hashes, counts = _word_hashes(texts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the end of the text
    grams = np.zeros(len(hashes), np.uint64)
    for i in range(min(n, len(hashes))):
        on = len(hashes) - i
        longer = _mix((grams[:on] ^ hashes[i:]) + np.uint64(0x9E3779B97F4A7C15))
        grams[:on] = np.where(left[:on] > i, longer, grams[:on])
    grams = grams[(left >= n) | (left == np.repeat(counts, counts))]
    ends = np.append(0, np.cumsum(np.where(counts >= n, counts - (n - 1), np.minimum(counts, 1))))
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        grams[low:high].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[ends[:-1][ends[:-1] < ends[1:]]] = True
    ends, grams = np.append(0, np.cumsum(new))[ends], grams[new]
    sizes = np.diff(ends)

    def key(salt: int) -> np.ndarray:
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(_mix(grams ^ np.uint64(salt)), dtype=np.uint64))
        return _mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64) * np.uint64(salt))

    return grams, sizes, key(0xD6E8FEB86659FD93), key(0xA0761D6478BD642F)


def largest_difference(a: int, b: int, percent: int) -> int:
    """The most elements in which sets of these sizes can differ and still be linked; below 0 if they cannot be."""
    least_shared = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * least_shared if least_shared <= min(a, b) else -1


def bands(percent: int, longest: int = 1 << 40) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Lower bounds of the size bands, and for each (segments, of these with a one-deletion neighbourhood, largest size)."""
    lows = [1]
    while lows[-1] < longest:
        lows.append(max(lows[-1] + 1, math.floor(lows[-1] * BAND)))
    return lows, [_allocation(low, high - 1, percent) for low, high in zip(lows, [*lows[1:], 2 * lows[-1]], strict=True)]


def _most(size: float, high: float, percent: int) -> int:
    """A bound of the difference between a set of a size and others up to ``high``."""
    return math.floor((100 - percent) * (size + min(high, size * 100 // percent)) / (100 + percent))


def _few(mean: float, most: int) -> float:
    """The chance of at most so many elements in a segment."""
    return math.exp(-mean) * sum(mean ** k / math.factorial(k) for k in range(most + 1))


def _allocation(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """The cheapest allowances for sets whose larger one has ``low`` to ``high`` elements.

    Cost are the rows that a set of usual size gives. At most one set in a thousand may lose more segments than its slack, if
    any choice attains that.
    """
    h = max(largest_difference(a, high, percent) for a in range(max(1, high * percent // 100), high + 1)) if high < 1 << 16 else (
        2 * high * (100 - percent) // (100 + percent))
    if h <= 0:
        return 0, 0, high
    best = None
    for slack in range(0, 60):
        for d in {0, 1, 2, 4, 8, 16, h // 4, h // 2, h}:
            m = h + 1 + slack - d
            if m < 1 or d > m:
                continue
            over = 0.0
            for size in (max(1, low * percent // 100), low, (low + high) // 2, high):
                mean, spare = size / m, m + d - 1 - _most(size, high, percent)
                lost = (m - d) * _few(mean, 1) + d * (_few(mean, 1) + _few(mean, 2))
                over = max(over, 1.0 if spare < 0 or lost > 60 else 1 - _few(lost, spare) if spare < 100 else 0.0)
            cost = m + d * (low + high) / 2 / m
            rank = (over > RARE, over if over > RARE else 0.0, cost)
            if best is None or rank < best[0]:
                best = (rank, (m, d, high))
    return best[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(keys: np.ndarray, values: np.ndarray, sizes: np.ndarray, band: np.ndarray, plan: np.ndarray, percent: int):
    """(signature, key) of sets in a size band each; values are the sets' elements one after the other."""
    m = plan[band, 0]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate(([0], np.cumsum(m)))
    mixed = _mix(values)
    segment = ((mixed >> np.uint64(20)) % m[owner].astype(np.uint64)).astype(np.int64)
    place = first[owner] + segment
    element = _mix(mixed + np.uint64(0x9E3779B97F4A7C15))
    total, count = np.zeros(first[-1], np.uint64), np.bincount(place, minlength=first[-1])
    np.add.at(total, place, element)
    holder = np.repeat(np.arange(len(sizes)), m)
    number = np.arange(first[-1]) - first[holder]
    salt = _mix((band[holder].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1))
    deleting = number < plan[band, 1][holder]
    lost = np.bincount(holder, weights=np.where(deleting, (count < 2).astype(int) + (count < 3), count < 2), minlength=len(sizes))
    most = (100 - percent) * (sizes + np.minimum(plan[band, 2], sizes * 100 // percent)) // (100 + percent)
    whole = lost > m + plan[band, 1] - 1 - most  # more is lost than the allowances can spare
    kept = (count > 1) | whole[holder]
    yield _mix(total + salt)[kept], keys[holder[kept]]
    near = deleting[place] & ((count[place] > 2) | whole[owner])
    if near.any():
        at = place[near]
        yield _mix(total[at] - element[near] + salt[at]), keys[owner[near]]


def _keys(n: int):
    """Rows (doc_id, _text, text) with the size and the keys of the text's set instead of the text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, c, d = _sets(batch.column(2), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(c.view(np.int64)), pa.array(
                d.view(np.int64))], ["doc_id", "_text", "n_shingles", "c", "d"])

    return rows


def _signature_rows(n: int, percent: int):
    lows, plan = map(np.array, bands(percent))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        def packed(parts):
            found = list(parts)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)], ["h", "c"])

        for batch in batches:
            values, every, keys, _ = _sets(batch.column(0), n)
            once = np.zeros(len(keys), bool)  # copies in a batch give the same rows
            once[np.unique(keys, return_index=True)[1]] = True
            once &= every > 0
            values, keys, every = values[np.repeat(once, every)], keys[once], every[once]
            ends = np.cumsum(every)
            begin = 0
            while begin < len(keys):  # sets of about CHUNK elements at once
                low = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
                sizes = every[begin:end]
                part, own = values[low:ends[end - 1]], keys[begin:end]
                band = np.searchsorted(lows, sizes, "right") - 1
                # In its own band a set is the larger of a pair; in those above, the smaller.
                reach, step = sizes * 100 // percent, band.copy()
                alive = np.ones(len(sizes), bool)
                while alive.any():
                    use = alive & (plan[step, 0] > 0)
                    if use.any():
                        yield packed(_signatures(own[use], part[np.repeat(use, sizes)], sizes[use], step[use], plan, percent))
                    step = step + 1
                    alive &= lows[step] <= reach
                begin = end

    return rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, centre) of the signatures that several keys have, from rows sorted by (h, c)."""
    rest_h, rest_c = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def found(h, c):
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= c[1:] != c[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        size = np.add.reduceat(other.astype(np.int64), np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)
        keep = other & (np.repeat(size, np.diff(np.append(np.flatnonzero(new), len(h)))) > 1)
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(c[keep]), pa.array(c[start][keep])], ["h", "c", "centre"])

    for batch in batches:
        h = np.concatenate([rest_h, batch.column(0).to_numpy(zero_copy_only=False)])
        c = np.concatenate([rest_c, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(h):
            continue
        cut = int(np.searchsorted(h, h[-1], "left"))  # the last signature may go on; copies of a key in it may go
        yield found(h[:cut], c[:cut])
        rest_h, rest_c = h[cut:], c[cut:]
        fresh = np.ones(len(rest_c), bool)
        fresh[1:] = rest_c[1:] != rest_c[:-1]
        rest_h, rest_c = rest_h[fresh], rest_c[fresh]
    yield found(rest_h, rest_c)


def _sketched(n: int):
    """(c, d, n, _set, sketch) of texts; the sketch tells how many elements fall into each bin, by a byte of at most 255.

    Small sets have 256 bins, larger ones a power of two with two to four elements a bin, as many would even out in fewer.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, c, d = _sets(batch.column(0), n)
            bits = np.maximum(8, np.ceil(np.log2(np.maximum(sizes, 1) / 4)).astype(np.int64))
            start = np.append(0, np.cumsum(1 << bits))
            at = (_mix(values) >> np.repeat(64 - bits, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(start[:-1], sizes)
            counts = np.minimum(np.bincount(at, minlength=start[-1]), 255).astype(np.uint8).tobytes()
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.view(np.int64)), pa.array(d.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(
                    offsets, pa.array(values.view(np.int64))), pa.array([counts[p:q] for p, q in zip(start[:-1], start[1:], strict=True)], pa.binary())],
                ["c", "d", "n", "_set", "sketch"])

    return rows


def _folded(sketch: bytes, bins: int) -> np.ndarray:
    """The counts of a sketch in fewer bins."""
    return np.frombuffer(sketch, np.uint8).reshape(bins, -1).sum(1, dtype=np.int32)


def _apart_by(left: bytes, right: bytes) -> int:
    """A lower bound of the elements in which two sets differ, from their sketches."""
    bins = min(len(left), len(right))
    return int(np.abs(_folded(left, bins) - _folded(right, bins)).sum())


def _most_apart(nx, ny, percent: int):
    """In how many elements sets of these sizes may differ at most, to be linked."""
    return nx + ny - 2 * -(-percent * (nx + ny) // (100 + percent))


def _fits(percent: int):
    """Those of the pairs (x, y, nx, ny, kx, ky) whose sketches allow a link."""
    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = [_apart_by(p, q) <= m for p, q, m in zip(
                batch.column(4).to_pylist(), batch.column(5).to_pylist(), _most_apart(nx, ny, percent).tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return fits


def _linked(percent: int):
    """(a, b, x, y) of linked pairs, from rows (part, member, x, node, _set) sorted by (part, member): first a centre, then its members."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, centre, own = None, None, None
        for batch in batches:
            out = []
            parts, members, keys, nodes = (batch.column(i).to_pylist() for i in range(4))
            sets = batch.column(4)
            values, bounds = sets.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False)))
            for i, member in enumerate(members):
                mine = values[bounds[i]:bounds[i + 1]]
                if not member:
                    part, centre, own = parts[i], (nodes[i], keys[i]), mine.copy()
                elif parts[i] == part:
                    small, large = (mine, own) if len(mine) < len(own) else (own, mine)
                    at = np.searchsorted(large.view(np.uint64), small.view(np.uint64))
                    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * shared >= percent * (len(small) + len(large) - shared):
                        out.append((centre[0], nodes[i], centre[1], keys[i]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                                             ["a", "b", "x", "y"])

    return linked


def _may_link(percent: int, nearest: bool):
    """Pairs (h, x, y) of different components in blocks of a bucket h whose sizes and sketches allow a link; of each class only the nearest if asked for.

    Rows (part, c, g, n, block, crossing, sketch, h) are sorted by part; in a crossing part only pairs of its two blocks count.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 0):
            part, c, g, n, block, crossing, _, h = (run.column(i).to_numpy() for i in range(8))
            whole = run.column(6).to_pylist()
            sketch = np.stack([_folded(s, BINS) for s in whole])
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            out = [(np.zeros(0, np.int64),) * 3]
            for low, high in zip(starts, np.append(starts[1:], len(part)), strict=True):
                for i in range(low, high):
                    j = np.arange(low if nearest else i + 1, high)
                    j = j[g[j] != g[i]]
                    if crossing[i]:
                        j = j[block[j] != block[i]]
                    j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
                    if len(j):
                        most = _most_apart(n[j], n[i], percent)
                        by = np.abs(sketch[j] - sketch[i]).sum(1)
                        j, most, by = j[by <= most], most[by <= most], by[by <= most]
                        if len(whole[i]) > BINS and len(j):
                            by = np.array([_apart_by(whole[i], whole[k]) for k in j])
                            j, by = j[by <= most], by[by <= most]
                        if nearest and len(j):
                            j = j[[np.argmin(by)]]
                        out.append((h[j], np.minimum(c[j], c[i]), np.maximum(c[j], c[i])))
            met = np.unique(np.stack([np.concatenate([o[k] for o in out]) for k in range(3)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in met], ["h", "x", "y"])

    return pairs


def link_components(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _text, n_shingles, component_id, component_text), one row per document.

    Documents link when 100 * shared >= ``percent`` * united n-grams; ``component_id`` is the smallest doc_id that links reach.
    Null texts and texts without words have no n-gram and no link, and are their own component, even if their ids are equal.
    Equal sets link whatever their ids; a null id is not counted as the smallest unless all of a component are null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("_text"), whole.alias("text"))
    keyed = T.StructType([rows.schema["doc_id"], *[T.StructField(name, T.LongType()) for name in ("_text", "n_shingles", "c", "d")]])
    classes = written(rows.mapInArrow(_keys(n), keyed), "sets")
    found = rows.select("text").mapInArrow(_signature_rows(n, percent), "h bigint, c bigint")
    dealt = found.repartition("h").sortWithinPartitions("h", "c")
    buckets = written(dealt.mapInArrow(_shared, "h bigint, c bigint, centre bigint"), "buckets")
    stars = written(buckets.filter("c <> centre").groupBy("centre", "c").agg(F.count("*").alias("n")), "stars")
    kinds = classes.filter("n_shingles > 0").groupBy("c", "d").agg(F.min(F.struct("doc_id", "_text")).alias("one"), F.first("n_shingles").alias("n"))
    wanted = stars.select("c").union(stars.select(F.col("centre").alias("c"))).distinct()
    reps = written(kinds.join(wanted, "c").select(F.col("one.doc_id").alias("_id"), F.col("one._text").alias("_t")).distinct(), "representatives")
    chosen = reps.count()
    near = rows.join(F.broadcast(reps) if chosen <= BROADCAST_SETS else reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left_semi")
    # Equal rows are one before their set is made, as texts take less room than sets.
    whole_sets = near.dropDuplicates(["doc_id", "_text"]).select("text").mapInArrow(
        _sketched(n), "c bigint, d bigint, n bigint, _set array<bigint>, sketch binary")
    sets = written(whole_sets, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, x, y): the linked ones of pairs (x, y) of keys and their nodes."""
        met = (pairs.join(sets.select(F.col("c").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("kx")), "x")
               .join(sets.select(F.col("c").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("ky")), "y")
               .filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))
        fit = written(met.select("x", "y", "nx", "ny", "kx", "ky").mapInArrow(_fits(percent), "x bigint, y bigint").distinct(), "pairs")
        # The set of x goes to each part of its partners, so that a pair costs one set and no centre is one task's alone.
        parts = fit.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts"))
        part = F.xxhash64("x", "part").alias("part")
        node = F.concat_ws(":", F.hex("c"), F.hex("d")).alias("node")
        small = F.broadcast if fit.count() <= BROADCAST_SETS else lambda frame: frame
        centres = sets.join(small(parts), F.col("c") == F.col("x")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        members = sets.join(small(fit.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")))), F.col("c") == F.col("y"))
        both = centres.select(part, F.lit(False).alias("member"), "c", node, "_set").union(members.select(part, F.lit(True), "c", node, "_set"))
        links = written(both.repartition("part").sortWithinPartitions("part", "member").mapInArrow(
            _linked(percent), "a string, b string, x bigint, y bigint"), "links")
        forget(fit)
        return links

    def grouped(*links: DataFrame) -> DataFrame:
        return components(reduce(DataFrame.union, links).select(F.col("x").alias("a"), F.col("y").alias("b")))

    def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component."""
        joined = (pairs.join(groups.select(F.col("id").alias("x"), F.col("component").alias("gx")), "x", "left")
                  .join(groups.select(F.col("id").alias("y"), F.col("component").alias("gy")), "y", "left"))
        return joined.filter(F.coalesce("gx", "x") != F.coalesce("gy", "y"))

    links = []
    if not stars.isEmpty():
        best = stars.groupBy("c").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"))
        links.append(verified(best.select(F.col("centre").alias("x"), F.col("c").alias("y"))))
        rest = stars.join(best, ["c", "centre"], "left_anti").select(F.col("centre").alias("x"), F.col("c").alias("y"))
        links.append(verified(apart(rest, grouped(*links)).select("x", "y")))
        inside = buckets
        for nearest in (True, True, False):
            groups = grouped(*links).select(F.col("id").alias("c"), "component")
            placed = inside.select("h", "c").join(groups, "c", "left").withColumn("g", F.coalesce("component", "c"))
            open_ = placed.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("n"), *[
                F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"x{i}") for i in (0, 1)]).filter("low < high")
            # Classes that share one bucket share many; of buckets of the same classes one will do.
            unsettled = open_.groupBy("n", "x0", "x1").agg(F.min("h").alias("h")).select("h")
            inside = written(placed.join(unsettled, "h").select("h", "c", "g"), "inside")
            if inside.isEmpty():
                break
            placed = number_rows(inside, [F.col("c")], "no", ["h"]).withColumn("block", F.floor((F.col("no") - 1) / BLOCK))
            blocks = placed.groupBy("h").agg((F.max("block") + 1).alias("blocks"))
            both = placed.join(blocks, "h").select("h", "c", "g", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("w"))
            both = both.withColumn("part", F.xxhash64("h", F.least("block", "w"), F.greatest("block", "w"))).withColumn("crossing", F.col("block") != F.col("w"))
            rows = both.join(sets.select("c", "n", "sketch"), "c").select("part", "c", "g", "n", "block", "crossing", "sketch", "h")
            met = written(rows.repartition("part").sortWithinPartitions("part").mapInArrow(_may_link(percent, nearest), "h bigint, x bigint, y bigint"), "met")
            tried = stars.select(F.least("centre", "c").alias("x"), F.greatest("centre", "c").alias("y"))
            links.append(verified(met.select("x", "y").distinct().join(tried, ["x", "y"], "left_anti")))
            # A bucket that let nothing out has nothing that may link: its components can only become fewer.
            inside = inside.join(met.select("h").distinct(), "h", "left_semi")
    node = F.concat_ws(":", F.hex("c"), F.hex("d"))
    if links:
        groups = components(reduce(DataFrame.union, links).select("a", "b"))
    # The first document of a component: the smallest id that is not null, and of equal ids the smallest hash of the text.
    smallest = classes.groupBy("c", "d").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("least"))
    if links:
        smallest = smallest.withColumn("id", node).join(groups, "id", "left").withColumn("g", F.coalesce("component", "id"))
        smallest = smallest.drop("least").join(smallest.groupBy("g").agg(F.min("least").alias("least")), "g")
    smallest = smallest.select(F.col("c").alias("_c"), F.col("d").alias("_d"), "least")
    out = classes.join(smallest, (F.col("c") == F.col("_c")) & (F.col("d") == F.col("_d")))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    least = F.when(F.col("n_shingles") == 0, own).otherwise(F.col("least"))
    forget(buckets, stars, reps, sets)
    return out.select("doc_id", "_text", "n_shingles", least["doc_id"].alias("component_id"), least["_text"].alias("component_text"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are alone or the first of their component, by id and hash of the text; rows that repeat it in full stay too."""
    found = link_components(docs, n, percent, doc_id, text)
    dropped = found.filter("NOT (doc_id <=> component_id AND _text = component_text)").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).distinct()
    return docs.join(dropped, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_t")), "left_anti")


def op8_jaccard_join(spark, folder):
    return link_components(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
