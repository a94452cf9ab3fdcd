"""Suffix-array dedup: removes every byte of a string of ``length`` bytes that also starts earlier.

Earlier is in a document with a smaller id (of equal ids, the smaller hash of the text; null ids come last), or before in the same
one. Strings do not cross documents, and are judged on the texts as they are given.

Equal strings are brought together first. A string of ``length`` bytes holds length - GRAM + 1 grams; the leftmost one of the
smallest hash is its anchor, so equal strings have equal anchors at equal places. Neighbouring strings with one anchor are a piece:
a stretch of text of less than twice the length. Pieces whose anchor is found nowhere else are dropped. Equal pieces are one
piece: all but the earliest occurrence of it go, whole.

Different pieces of an anchor may share strings. They are put into blocks of about BLOCK bytes, the pieces of an anchor into the
same one. In a block, the rotations of its bytes are sorted by their first bytes (at least ``length`` of them), and common
prefixes are derived on the Burrows-Wheeler transform by threshold-bounded interval expansion: from the interval of the empty
string, every interval is extended backwards by each letter that precedes it, breadth first; an end of an interval that nothing
has reached before separates suffixes which share as many letters as there were steps. Steps stop at ``length``: suffixes no step
has separated share that many bytes. Of such a group, all but the earliest start are covered.

An anchor with more pieces than a block holds (a common line, say) is refined first: its strings hold a longer known text, by
half of what is still unknown on the left or else on the right of it, and that becomes their anchor. Refining ends with the
whole string known, so no group of different pieces is ever too large for a task, and no string is left out.

Null texts are empty; those of less than ``length`` bytes are kept whole. Equal rows (same id and text) are one document and get
equal results. Empty tables give none, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import forget, small_batches, table, without, written

GRAM = 32
#: Bytes that are hashed at once, and bytes of a block.
CHUNK, BLOCK = 1 << 20, 2 << 20
#: A byte that no UTF-8 text holds.
BREAK = 0xFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Cuts texts into pieces; hashes are those of polynomials in an odd number, modulo 2 ** 64."""

    def __init__(self, length: int, gram: int = GRAM, chunk: int = CHUNK):
        self.length, self.gram, self.chunk = length, min(gram, length), chunk
        odd = 0x9E3779B97F4A7C15 | 1
        size = chunk + 2 * length + 2

        def powers(of: int) -> np.ndarray:
            steps = np.full(size, of, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        self.up, self.down = powers(odd), powers(pow(odd, -1, 1 << 64))
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64))

    def segments(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, ends, owners, offsets) of parts that together hold every string once; ``ends`` per byte, the others per part."""
        parts, size = [], 0
        for i, text in enumerate(texts):
            for begin in range(0, len(text) - self.length + 1, self.chunk):
                part = text[begin:begin + self.chunk + self.length - 1]
                if size + len(part) > self.chunk + self.length:
                    yield self._together(parts)
                    parts, size = [], 0
                parts.append((i, begin, part))
                size += len(part)
        if parts:
            yield self._together(parts)

    @staticmethod
    def _together(parts):
        sizes = np.array([len(p) for _, _, p in parts])
        return (np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.cumsum(sizes),
                np.array([i for i, _, _ in parts]), np.array([b for _, b, _ in parts]))

    def cut(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, piece, owner, low, high, place) arrays: a piece holds the strings that start from low to high, its anchor is at place."""
        k, width = self.gram, self.length - self.gram + 1
        for data, ends, owners, offsets in self.segments(texts):
            n = len(data)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.up[:n], dtype=np.uint64)))
            grams = _mixed((sums[k:] - sums[:-k]) * self.down[:n - k + 1])
            least, at, size = grams, np.arange(len(grams), dtype=np.int32), 1
            while size < width:  # the leftmost smallest of ``size`` grams from each place on
                step = min(size, width - size)
                right = least[step:] < least[:len(least) - step]
                at = np.where(right, at[step:], at[:len(at) - step])
                least = np.where(right, least[step:], least[:len(least) - step])
                size += step
            part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            start = np.arange(n - self.length + 1)
            inside = start + self.length <= ends[part[:len(start)]]
            start, at = start[inside], at[:n - self.length + 1][inside]
            if not len(start):
                continue
            new = np.ones(len(start), bool)
            new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            low, high, place = start[first], start[np.append(first[1:], len(start)) - 1], at[first]
            piece = _mixed((sums[high + self.length] - sums[low]) * self.down[low] + (high - low).astype(np.uint64))
            own = part[low]
            back = offsets[own] - (ends - np.diff(ends, prepend=0))[own]
            yield grams[place], piece, owners[own], low + back, high + back, place + back


def _cutter(length: int, gram: int, chunk: int, narrow: bool):
    """Rows (.., text) to pieces (anchor, piece, .., low, high, place); narrow ones only tell (anchor, lowest piece, highest piece, n)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Pieces(length, gram, chunk)
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            for anchor, piece, owner, low, high, place in cutter.cut(texts):
                if narrow:
                    a, p = anchor.view(np.int64), piece.view(np.int64)  # signed, as Spark compares them
                    order = np.lexsort((p, a))
                    a, p = a[order], p[order]
                    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                    last = np.append(first[1:], len(a)) - 1
                    columns = [a[first], p[first], p[last], last - first + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "p", "q", "n"])
                else:
                    names = batch.schema.names[:-1]
                    kept = [batch.column(i).take(pa.array(owner)) for i in range(len(names))]
                    columns = [pa.array(c) for c in (anchor.view(np.int64), piece.view(np.int64), low, high, place)]
                    yield pa.RecordBatch.from_arrays([*columns, *kept], ["anchor", "piece", "low", "high", "place", *names])

    return rows


def order_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """A stable argsort of keys of so many bits; plain sorts of packed numbers are several times faster where they fit."""
    places = max(1, int(len(keys) - 1).bit_length())
    if bits + places > 64:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.uint64) << np.uint64(places)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << places) - 1)).astype(np.int64)


def rotations(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of an array of bytes, in the order of the (at least ``depth``) bytes that start there; the array is a ring."""
    n, known = len(data), 5
    words = np.zeros(n, np.uint64)
    for i in range(known):
        words = (words << np.uint64(8)) | np.roll(data, -i).astype(np.uint64)
    bits, of_rank = 8 * known, max(1, int(n - 1).bit_length())
    while True:
        order = order_of(words, bits)
        ordered = words[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))).astype(np.uint64)
        if known >= depth:
            return order
        words = (rank << np.uint64(of_rank)) | np.roll(rank, -known)
        bits, known = 2 * of_rank, 2 * known


def shared_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, how many bytes it shares with the one before; -1 stands for ``length`` or more.

    The values come in increasing order, from backward extension on the Burrows-Wheeler transform.
    """
    n, places = len(order), int(len(order)).bit_length()
    before, letter = data[order - 1], data[order]
    step = np.empty(n, np.int64)  # the place in the order of the rotation one byte to the left
    step[np.argsort(before, kind="stable")] = np.arange(n)
    shared = np.full(n + 1, -1, np.int16)
    shared[0] = shared[n] = 0
    low, high = np.array([0]), np.array([n])
    for value in range(length):
        if not len(low):
            break
        sizes = high - low
        within = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        packed = (step[within] << places) | np.repeat(np.arange(len(low)), sizes)
        packed.sort()
        to, owner = packed >> places, packed & ((1 << places) - 1)
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (letter[to[1:]] != letter[to[:-1]])
        first = np.flatnonzero(new)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = shared[high] < 0
        low, high = low[fresh], high[fresh]
        shared[high] = value
    return shared[:n]


def _covered(texts: list[bytes], owner: np.ndarray, low: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(piece, first start, last start) of the strings that also start earlier, in pieces sorted by (owner, low)."""
    data = np.frombuffer(b"".join(t + bytes([BREAK]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    order = rotations(data, length)
    shared = shared_prefixes(data, order, length)
    group = np.cumsum(shared >= 0)
    piece = np.repeat(np.arange(len(texts)), sizes)
    left = (ends - 1)[piece] - np.arange(len(data))  # bytes to the end of the piece
    whole = left[order] >= length
    places, group = order[whole], group[whole]
    by = order_of(places, len(data).bit_length())  # pieces lie in the order of what is earlier, and so do their strings
    by = by[order_of(group[by], len(data).bit_length())]
    places, group = places[by], group[by]
    where = low[piece[places]] + places - (ends - sizes)[piece[places]]
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(by) else np.zeros(0, np.int64)
    head = np.repeat(lead, np.diff(np.append(lead, len(by))))
    # Of equal rows the same place may stand in two pieces; it is not earlier than itself.
    later = (owner[piece[places]] != owner[piece[places[head]]]) | (where != where[head])
    repeated = np.zeros(len(data) + 1, bool)
    repeated[places[later]] = True
    edge = np.diff(np.concatenate(([False], repeated)).astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        yield int(piece[a]), int(a - (ends - sizes)[piece[a]]), int(b - 1 - (ends - sizes)[piece[a]])


def _blocks(length: int):
    """Spans of repeated strings in rows (block, doc_id, _text, low, bytes) sorted by block and by what is earlier."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, []

        def solved() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                other = [x[1:3] != y[1:3] for x, y in zip(held, held[1:])]
                owner = np.cumsum([0, *other])
                found = list(_covered([row[4] for row in held], owner, np.array([row[3] for row in held]), length))
                columns = ([held[p][1] for p, _, _ in found], [held[p][2] for p, _, _ in found],
                           [held[p][3] + first for p, first, _ in found], [held[p][3] + last + length for p, _, last in found])
                types = (kind, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "_text", "begin", "end"])

        for batch in batches:
            kind = batch.schema.field(1).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[0] != held[0][0]:
                    yield from solved()
                    held = []
                held.append(row)
        yield from solved()

    return rows


def _place(*columns: str) -> Column:
    """What orders occurrences: documents by id (null ids last) and hash of the text, then places."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", *columns)


def _refined(pieces: DataFrame, known: int, half: int, length: int) -> DataFrame:
    """Pieces of hot anchors, divided by the strings that hold ``half`` more bytes left of the known text and the others."""
    size = F.length("bytes")
    left = pieces.filter(F.col("core") >= half).select(
        F.xxhash64(F.lit("left"), "anchor", F.expr(f"substring(bytes, core - {half - 1}, {known + half})")).alias("anchor"), "doc_id", "_text", "low",
        (F.col("core") - half).alias("core"), F.expr(f"substring(bytes, 1, core + {length - half})").alias("bytes"))
    start = F.greatest(F.lit(0), F.col("core") - (half - 1))
    right = pieces.filter(start <= size - length).withColumn("_s", start).select(
        F.xxhash64(F.lit("right"), "anchor", F.expr(f"substring(bytes, core + 1, {known + half})")).alias("anchor"), "doc_id", "_text",
        (F.col("low") + F.col("_s")).alias("low"), (F.col("core") - F.col("_s")).alias("core"), F.expr("substring(bytes, _s + 1)").alias("bytes"))
    return left.union(right)


def repeated_spans(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM,
                   chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, _text, begin, end): stretches of bytes, end exclusive, that are covered by strings which also start earlier.

    Stretches of a document may overlap. ``_text`` is the hash of the text, as ids may repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("_text"), whole.alias("_whole")).filter(F.octet_length("_whole") >= length)
    kind = rows.schema["doc_id"].dataType.simpleString()
    gram = min(gram, length)

    counted = rows.select("_whole").mapInArrow(_cutter(length, gram, chunk, True), "anchor bigint, p bigint, q bigint, n bigint")
    anchors = written(counted.groupBy("anchor").agg(F.min("p").alias("p"), F.max("q").alias("q"), F.sum("n").alias("n"))
                      .filter("n > 1").select("anchor", (F.col("p") != F.col("q")).alias("mixed")), "anchors")
    cut = rows.mapInArrow(_cutter(length, gram, chunk, False),
                          f"anchor bigint, piece bigint, low bigint, high bigint, place bigint, doc_id {kind}, _text bigint")
    pieces = written(cut.join(anchors, "anchor"), "pieces")
    firsts = written(pieces.groupBy("anchor", "piece", "mixed").agg(
        F.min(_place("low", "high", "place")).alias("first"), F.count("*").alias("n")), "firsts")
    others = pieces.join(firsts.filter("n > 1").select("anchor", "piece", F.col("first").alias("f")), ["anchor", "piece"])
    spans = [written(others.filter(~_place("low", "high", "place").eqNullSafe(F.col("f"))).select(
        "doc_id", "_text", F.col("low").alias("begin"), (F.col("high") + length).alias("end")), "spans")]
    forget(anchors, pieces)

    wanted = firsts.filter("mixed").select("first.*", "anchor").groupBy("doc_id", "_text").agg(
        F.collect_list(F.struct("anchor", "low", "high", "place")).alias("_wanted")).withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_t")
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t"))).withColumn("_bytes", F.col("_whole").cast("binary"))
    cutting = F.expr(f"""inline(transform(_wanted, w -> named_struct('anchor', w.anchor, 'low', w.low, 'core', CAST(w.place - w.low AS INT),
        'bytes', substring(_bytes, CAST(w.low AS INT) + 1, CAST(w.high - w.low AS INT) + {length}))))""")
    current = written(held.select("doc_id", "_text", cutting).select("anchor", "doc_id", "_text", "low", "core", "bytes"), "different-pieces")
    forget(firsts)
    known, dealt, tables = gram, [], [current]
    while True:
        sizes = written(current.groupBy("anchor").agg(F.sum(F.length("bytes") + 1).alias("size"), F.count("*").alias("n")), "sizes")
        fit = sizes.filter(f"n > 1 AND size <= {block // 4}").select("anchor", "size")
        dealt.append((current.join(fit.select("anchor"), "anchor"), fit.agg(F.sum("size")).first()[0] or 0))
        hot = sizes.filter(f"n > 1 AND size > {block // 4}").select("anchor")
        tables.append(sizes)
        if known >= length or hot.isEmpty():
            break
        half = (length - known + 1) // 2
        divided = written(_refined(current.join(hot, "anchor"), known, half, length), "divided-pieces")
        known += half
        one = divided.groupBy("anchor", "core", "bytes").agg(F.min(_place("low")).alias("first"))
        current = written(one.select("anchor", "first.doc_id", "first._text", "first.low", "core", "bytes"), "different-pieces")
        again = divided.join(one.select("anchor", "core", "bytes", F.col("first").alias("f")), ["anchor", "core", "bytes"])
        spans.append(written(again.filter(~_place("low").eqNullSafe(F.col("f"))).select(
            "doc_id", "_text", F.col("low").alias("begin"), (F.col("low") + F.length("bytes")).alias("end")), "spans"))
        forget(divided)
        tables.append(current)
    blocks = 1 + 2 * sum(size for _, size in dealt) // block
    placed = reduce(DataFrame.union, [p.select(F.pmod(F.xxhash64("anchor", F.lit(7)), F.lit(blocks)).alias("block"), "doc_id", "_text", "low", "bytes")
                                      for p, _ in dealt])
    sorted_ = placed.repartition("block").sortWithinPartitions("block", F.col("doc_id").isNull(), "doc_id", "_text", "low")
    spans.append(written(sorted_.mapInArrow(_blocks(length), f"doc_id {kind}, _text bigint, begin bigint, end bigint"), "spans"))
    forget(*tables)
    return reduce(DataFrame.union, spans)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last columns (bytes, spans) by the figures and the bytes outside the spans."""
    for batch in batches:
        n, removed, spans, kept = [], [], [], []
        for data, gone in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            data, at, parts, count = data or b"", 0, [], 0
            end = None
            for begin, stop in sorted((g["begin"], g["end"]) for g in gone or []):
                if end is None or begin > end:
                    parts.append(data[at:begin])
                    count, at = count + 1, stop
                end = at = max(at, stop)
            parts.append(data[at:])
            kept.append(b"".join(parts))
            n.append(len(data))
            removed.append(len(data) - len(kept[-1]))
            spans.append(count)
        columns = [pa.array(c, pa.int64()) for c in (n, removed, spans)] + [pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeated_strings(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and ``kept``, the bytes of the text that are left (a letter may be cut in two).

    ``n_spans`` counts stretches of removed bytes; those that touch are one. Columns of the input with these names give way.
    """
    spans = repeated_spans(docs, length, doc_id, text, **options).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).agg(
        F.collect_list(F.struct("begin", "end")).alias("_spans"))
    rows = without(docs, ["n_bytes", "n_removed", "n_spans", "kept", "_h", "_id", "_t", "_bytes", "_spans"])
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = rows.withColumn("_h", F.xxhash64(whole)).join(spans, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")
    packed = joined.select(*[f"`{c}`" for c in rows.columns], whole.cast("binary").alias("_bytes"), "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return packed.mapInArrow(_thinned, f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op12_suffix_dedup(spark, folder):
    found = drop_repeated_strings(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
