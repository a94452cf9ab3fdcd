"""Periodic runs against brute force, on whole tables and on odd rows."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vulnlake.llm import periodic_runs

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, times * q):
                stretch = words[start:start + length]
                if not any(all(x == y for x, y in zip(stretch, stretch[r:])) for r in range(1, q)):
                    out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.choice(rng.choice(["ab", "abc", "abcdefghijkl"])) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            if len(words) > 5:
                start, p = rng.randrange(len(words)), rng.randint(1, 16)
                for i in range(start, min(len(words), start + rng.randint(4, 80))):
                    words[i] = words[start + (i - start) % p]
        yield " ".join(words)


@pytest.mark.parametrize("least,times", [(6, 4), (3, 3), (20, 5)])
def test_runs_equal_brute_force(spark, least, times):
    texts = list(random_texts(least, 500))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    total = 0
    for r in periodic_runs.find_runs(frame, least, times).collect():
        words = texts[r.doc_id].split()
        want = brute(words, least, times)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words) and r.collapsed == collapsed(words, want)
        total += len(want)
    assert total > 20


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    found = 0
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 3000 else None
        if runs is None:
            continue  # the naive search takes minutes on these; random texts above cover long runs
        found += len(runs)
        r = got[doc_id]
        text_of_runs = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(text_of_runs.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        if runs:
            s, length, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert found > 50


def test_strongest_takes_exact_quotients_and_first_of_ties(spark):
    rows = [([(0, 9, 2), (3, 13, 3), (20, 18, 4)],), ([(5, 8, 2), (6, 12, 3), (9, 4, 1)],), ([],)]
    frame = spark.createDataFrame(rows, f"runs {periodic_runs.RUNS}")
    assert [r.b and tuple(r.b) for r in frame.select(periodic_runs.strongest(F.col("runs")).alias("b")).collect()] == [(0, 9, 2), (5, 8, 2), None]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a a a a a a"), (5, "x y " * 40000), (6, "é é " * 7), (6, "é é " * 7), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("taken")).withColumn("n_words", F.lit("taken"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(frame).collect()), key=str)
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 6, [(0, 6, 1)], "a"), (5, 80000, [(0, 80000, 2)], "x y"),
        (6, 7, [(0, 7, 1)], "é é"), (6, 7, [(0, 7, 1)], "é é"), (None, 0, [], "")], key=str)
    assert periodic_runs.find_runs(frame.limit(0)).collect() == []
    with pytest.raises(Exception, match="three periods"):
        periodic_runs.find_runs(frame, times=2).collect()
