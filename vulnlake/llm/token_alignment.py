"""Alignment of two tokenizations of the same texts by pointer jumping.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file), B a BPE of pieces with byte fallback (a ``sentencepiece`` file). A
document's tokens are laid over its UTF-8 bytes, after one leading space. Every token points to the token of the other side that
overlaps it and reaches farthest right; if that reaches no farther, an A token points to itself and a B token to the A token that
ends with it. Doubling all pointers at once (each takes its target's target) converges to the terminal A token of every
component, and so labels the groups: the pieces of the text between places where tokens of both sides end.

Links are all A and B tokens that share a byte. How often each id pair is linked is counted over all documents; a link is a best
one if no other A id is linked more often with its B id. Counts are added up in tasks first. They are sent to all tasks where
they are at most ``broadcast_pairs`` (they cannot exceed the product of the two vocabularies), otherwise joined by pair.

Texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens: zeros and ''. Rows are worked on
alone, whatever their ids: repeated rows count each, empty tables give none. The tokenizers are read by the driver and sent to
the tasks. Where neither tokenizer
reaches over a space between words, a task encodes each word once. It holds the tokens of one text, however long, and of about SLICE
characters of short ones.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import forget, small_batches, table, written

#: Bytes of short texts that are encoded at once.
SLICE = 1 << 18
#: Distinct pairs a task keeps before it passes their counts on.
HELD_PAIRS = 1 << 20
BROADCAST_PAIRS = 4_000_000
TOKENIZERS = "/opt/tokenizers"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_tokens(model: str) -> tuple[object, list[bytes]]:
    """Tokenizer A from the text of its file, and the bytes of each id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.encode_special_tokens = True
    alphabet = byte_level_alphabet()
    names = {i: name for name, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return tokenizer, [bytes(alphabet[c] for c in names[i]) if i in names and all(c in alphabet for c in names[i]) else b""
                       for i in range(max(names) + 1)]


def piece_tokens(model: bytes) -> tuple[object, list[bytes]]:
    """Tokenizer B from the bytes of its file, and the bytes of each id."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return processor, [bytes([int(name[3:5], 16)]) if processor.is_byte(i) else b"" if processor.is_control(i) or processor.is_unknown(i)
                       else name.replace("▁", " ").encode() for i, name in enumerate(names)]


#: A space between two characters that are no white space, where both tokenizers may cut (see `cuts_at_spaces`).
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words of up to this many characters are encoded once and remembered, so many at a time.
WORD, REMEMBERED = 64, 250_000


def cuts_at_spaces(model: str, b_names: list[str]) -> bool:
    """Whether tokens of neither side reach over the beginning of a space inside a text, so that words can be encoded alone.

    A byte-level pattern starts a new stretch at a space between other characters. Pieces do not reach over it if none holds the
    mark of a space after another character.
    """
    settings = json.loads(model)
    splitter = settings.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not settings.get("normalizer")
    return bool(plain) and not any("▁" in name.lstrip("▁") for name in b_names)


class Encoder:
    """Ids of texts by both tokenizers, as bytes of 32-bit numbers; None where the bytes of the text are not given back."""

    def __init__(self, a_model: str, b_model: bytes):
        self.a, self.a_bytes = byte_level_tokens(a_model)
        self.b, self.b_bytes = piece_tokens(b_model)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.by_word = cuts_at_spaces(a_model, [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())])
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.lost: set[str] = set()

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        out = []
        first = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, found, b in zip(texts, first, self.b.encode(texts, num_threads=1), strict=True):
            a, want = found.ids, b" " + text.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else None)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet; those without white space at their ends all at once."""
        plain = [w for w in words if len(w) <= WORD and w and not w[0].isspace() and not w[-1].isspace()]
        left = words
        if plain:
            want = b" " + " ".join(plain).encode()
            a = self.a.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids
            b = self.b.encode(plain, num_threads=1)
            flat = [i for ids in b for i in ids]
            word_ends = np.cumsum([1 + len(w.encode()) for w in plain])
            a_ends = np.cumsum(self.a_size[a])
            last = np.searchsorted(a_ends, word_ends)
            fits = len(a_ends) and a_ends[-1] == len(want) and np.array_equal(a_ends[np.minimum(last, len(a) - 1)], word_ends)
            if fits and b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, flat)):
                for known, ids, stops in ((self.known_a, a, last + 1), (self.known_b, flat, np.cumsum([len(ids) for ids in b]))):
                    packed, begin = np.array(ids, np.int32).tobytes(), 0
                    for word, stop in zip(plain, (4 * stops).tolist(), strict=True):
                        known[word] = packed[begin:stop]
                        begin = stop
                left = [w for w in words if w not in self.known_a]
        for word, found in zip(left, self.whole(left) if left else [], strict=True):
            self.known_a[word], self.known_b[word] = found or (b"", b"")
            if found is None:
                self.lost.add(word)

    def encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        if not self.by_word:
            return [found if text else None for text, found in zip(texts, self.whole(texts), strict=True)]
        if len(self.known_a) > REMEMBERED:
            self.known_a, self.known_b, self.lost = {}, {}, set()
        words = [CUT.split(text) for text in texts]
        fresh = list(set().union(*words).difference(self.known_a))
        self.learn(fresh)
        out = [None if not text or not self.lost.isdisjoint(part) else (
            b"".join(map(self.known_a.__getitem__, part)), b"".join(map(self.known_b.__getitem__, part))) for text, part in zip(texts, words, strict=True)]
        for word in fresh:
            if len(word) > WORD:  # long words come once; they are not worth keeping
                del self.known_a[word], self.known_b[word]
                self.lost.discard(word)
        return out


def _encoder(a_file, b_file):
    """Adds the ids of both tokenizers to rows whose last column is the text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(a_file.value, b_file.value)

        def lists(parts: list[bytes]):
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            done, begin, size = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size > SLICE or i == len(texts) - 1:
                    done.extend(encoder.encoded(texts[begin:i + 1]))
                    begin, size = i + 1, 0
            pairs = [d or (b"", b"") for d in done]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists([a for a, _ in pairs]), lists([b for _, b in pairs])],
                                             [*batch.schema.names[:-1], "a", "b"])

    return rows


class Aligned:
    """Groups and links of token rows laid one after the other; ``a_ends`` and ``b_ends`` are where tokens end, in bytes."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray, a_sizes: np.ndarray):
        n_a = len(a_ends)
        over_a = np.searchsorted(b_ends, a_ends)  # the B token that holds the last byte of each A token
        over_b = np.searchsorted(a_ends, b_ends)
        closing = b_ends[over_a] == a_ends
        points = np.concatenate((np.where(closing, np.arange(n_a), n_a + over_a), over_b))
        while True:
            further = points[points]
            if np.array_equal(further, points):
                break
            points = further
        self.closing = closing
        number = np.cumsum(closing) - 1
        self.a_group, self.b_group = number[points[:n_a]], number[points[n_a:]]
        first = np.searchsorted(b_ends, a_ends - a_sizes, "right")
        self.links_of_a = over_a - first + 1
        begin = np.cumsum(self.links_of_a) - self.links_of_a
        self.link_a = np.repeat(np.arange(n_a), self.links_of_a)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(begin - first, self.links_of_a)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _aligned(batch: pa.RecordBatch, a_size: np.ndarray, b_size: np.ndarray):
    (a, n_a), (b, n_b) = _flat(batch.column("a")), _flat(batch.column("b"))
    return a, n_a, b, n_b, Aligned(np.cumsum(a_size[a]), np.cumsum(b_size[b]), a_size[a])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) + b


def _pair_counts(sizes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = sizes.value
        held, size = [], 0

        def packed():
            pairs = np.concatenate([p for p, _ in held])
            order = np.argsort(pairs, kind="stable")
            pairs, counts = pairs[order], np.concatenate([n for _, n in held])[order]
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(np.add.reduceat(counts, first))], ["pair", "n"])

        for batch in batches:
            a, _, b, _, found = _aligned(batch, a_size, b_size)
            held.append(np.unique(_pair(a[found.link_a], b[found.link_b]), return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return rows


def _texts_of_groups(a, n_a, b, n_b, found: Aligned, names) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` per row. ``names`` holds the decimal ids with each separator, one block of ids after the other."""
    span = len(names) // 3
    groups = int(found.closing.sum())
    b_before = np.concatenate(([0], np.cumsum(np.bincount(found.b_group, minlength=groups))))
    a_before = np.concatenate(([0], np.cumsum(np.bincount(found.a_group, minlength=groups))))
    out = np.empty(len(a) + len(b), object)
    more_a = np.append(found.a_group[1:] == found.a_group[:-1], False) if len(a) else np.zeros(0, bool)
    more_b = np.append(found.b_group[1:] == found.b_group[:-1], False) if len(b) else np.zeros(0, bool)
    out[np.arange(len(a)) + b_before[found.a_group]] = names[a + np.where(more_a, 0, span)]
    out[np.arange(len(b)) + a_before[found.b_group + 1]] = names[b + np.where(more_b, 0, 2 * span)]
    ends = np.cumsum(n_a + n_b)
    return ["".join(out[end - n:end].tolist())[:-1] for end, n in zip(ends, n_a + n_b, strict=True)]


def _per_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive values up to each end."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return np.diff(sums[np.concatenate(([0], ends))])


def _reader(sizes, known):
    """Figures and groups of each row; with ``known`` counts also those of its links, else its pairs and how often it links them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = sizes.value
        pairs, counts, best = known.value if known else (None, None, None)
        names = np.array([f"{i}{mark}" for mark in ",|;" for i in range(max(len(a_size), len(b_size)))], object)
        for batch in batches:
            a, n_a, b, n_b, found = _aligned(batch, a_size, b_size)
            a_ends = np.cumsum(n_a)
            n_links = _per_row(found.links_of_a, a_ends)
            links = _pair(a[found.link_a], b[found.link_b])
            columns = [batch.column("_row"), batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(_per_row(found.closing, a_ends)),
                       pa.array(n_links), pa.array(_texts_of_groups(a, n_a, b, n_b, found, names), pa.string())]
            labels = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
            link_ends = np.cumsum(n_links)
            if known:
                at = np.searchsorted(pairs, links)
                columns += [pa.array(_per_row(best[at], link_ends)), pa.array(_per_row(counts[at], link_ends))]
                labels += ["n_best", "count_sum"]
            else:
                offsets = pa.array(np.concatenate(([0], link_ends)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(links)))
                labels.append("links")
            yield pa.RecordBatch.from_arrays(columns, labels)

    return rows


def align_tokens(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
                 broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum), a row for each row of the input.

    ``groups`` lists the groups as `a1,a2|b1;a3|b2,b3` (decimal ids of A, then of B, in order). ``n_best`` counts links whose pair
    is the most frequent one of its B id, ties included; ``count_sum`` adds the counts of the links' pairs.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=200, size="1m")
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_file, b_file = a.read(), b.read()
    send = spark.sparkContext.broadcast
    sizes = send(tuple(np.array([len(x) for x in tokens], np.int64) for tokens in (byte_level_tokens(a_file)[1], piece_tokens(b_file)[1])))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tokens = written(rows.mapInArrow(_encoder(send(a_file), send(b_file)), f"_row bigint, doc_id {kind}, a array<int>, b array<int>"), "tokens")
    counted = tokens.select("a", "b").mapInArrow(_pair_counts(sizes), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = written(counted, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    rated = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    figures = f"_row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
    if counts.count() <= broadcast_pairs:
        few = rated.toPandas().sort_values("pair")
        known = send(tuple(few[c].to_numpy(np.int64) for c in ("pair", "n", "best")))
        return tokens.mapInArrow(_reader(sizes, known), f"{figures}, n_best bigint, count_sum bigint").drop("_row")
    found = written(tokens.mapInArrow(_reader(sizes, None), f"{figures}, links array<bigint>"), "alignments")
    links = found.select("_row", F.explode("links").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("times"))
    sums = links.join(rated, "pair").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = found.drop("links").join(sums, "_row", "left").drop("_row").fillna(0, ["n_best", "count_sum"])
    forget(tokens)
    return out


def op13_token_alignment(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = align_tokens(docs, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(
        F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))
