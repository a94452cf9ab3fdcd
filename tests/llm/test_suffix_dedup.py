"""Removal of repeated byte strings against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import suffix_dedup as sd

FOLDER = "/root/testdata/sf0.01"


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of texts in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(data), len(data) - len(kept), spans, kept))
    return out


def result(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect()}


def corpus(seed, n=120):
    """Texts with shared passages, edits, periodic stretches and a line that stands in most of them in changing surroundings."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(6)]
    line = "the same line stands in most of these texts, whatever is around it; "
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice([line, line, rng.choice(passages), "ab" * rng.randint(1, 90), word() + rng.choice(passages)[3:]]))
            parts.append(word())
        texts.append("".join(parts))
    return [*texts, texts[3], texts[5], texts[3], None, ""]


@pytest.mark.parametrize("length,options", [
    (100, {}), (40, {"block": 2000, "chunk": 300}), (40, {"block": 40, "chunk": 100, "gram": 8}), (12, {"gram": 32})])
def test_removed_bytes_equal_brute_force(spark, length, options):
    texts = corpus(length)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = result(sd.drop_repeated_strings(frame, length, **options))
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000 and any(0 < w[1] < w[0] for w in want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op12_suffix_dedup(spark, FOLDER).collect()}
    want = {d.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, brute([d.text for d in docs], 100), strict=True)}
    assert got == want


def test_common_prefixes_equal_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        letters, length = rng.choice([b"ab", b"abcd", b"a"]), rng.choice([3, 8, 20, 50])
        data = [rng.choice(letters) for _ in range(rng.randint(20, 300))]
        for _ in range(3):
            i, j, n = rng.randrange(len(data)), rng.randrange(len(data)), rng.randint(5, 80)
            data[j:j + n] = data[i:i + n]
        data = np.array([*data, sd.BREAK], np.uint8)
        order = sd.rotations(data, length)
        turned = [bytes(np.roll(data, -i)) for i in order]
        shared = sd.shared_prefixes(data, order, length)
        for k in range(1, len(data)):
            same = next((z for z in range(len(data)) if turned[k - 1][z] != turned[k][z]), len(data))
            assert shared[k] == (same if same < length else -1)


def test_odd_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    long = "a" + long[1:]
    rows = [(None, long), (7, long), (7, long), (7, "x" + long), (3, None), (4, ""), (5, "short"), (None, None), (9, "z" * 500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("kept", "n_spans", "_spans", "place", "anchor"):
        frame = frame.withColumn(name, F.lit("taken"))
    out = sd.drop_repeated_strings(frame)
    assert set(out.columns) == {"doc_id", "text", "place", "anchor", "n_bytes", "n_removed", "n_spans", "kept"}
    got = sorted((str(r.doc_id), (r.text or "")[:1], r.n_bytes, r.n_removed, r.n_spans) for r in out.collect())
    # Of document 7's two texts the one with the smaller hash comes first; equal rows are one document.
    first = spark.sql(f"SELECT xxhash64('{long}') < xxhash64('x{long}') AS p").first().p
    sevens = [("7", "a", 300, 0, 0), ("7", "a", 300, 0, 0), ("7", "x", 301, 300, 1)] if first else [
        ("7", "a", 300, 300, 1), ("7", "a", 300, 300, 1), ("7", "x", 301, 0, 0)]
    assert got == sorted([("None", "a", 300, 300, 1), *sevens, ("3", "", 0, 0, 0), ("4", "", 0, 0, 0), ("5", "s", 5, 0, 0), ("None", "", 0, 0, 0),
                          ("9", "z", 500, 499, 1)])
    assert sd.drop_repeated_strings(frame.limit(0)).collect() == []
    named = sd.drop_repeated_strings(frame.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body")), 100, "name", "body")
    assert named.count() == 9
