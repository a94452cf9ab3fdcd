"""Token alignment against brute force over byte ranges."""

import collections
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import token_alignment as ta

FOLDER = "/root/testdata/sf0.01"
A_FILE, B_FILE = (f"{ta.TOKENIZERS}/{name}" for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
pytestmark = pytest.mark.skipif(not os.path.isdir(ta.TOKENIZERS), reason="tokenizers are not there")


def brute(docs):
    """Figures per row from plain loops; [(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)]."""
    with open(A_FILE, encoding="utf-8") as f:
        a_side, a_bytes = ta.byte_level_tokens(f.read())
    with open(B_FILE, "rb") as f:
        b_side, b_bytes = ta.piece_tokens(f.read())
    rows, total = [], collections.Counter()
    for text in docs:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            rows.append(([], [], [], []))
            continue
        spans = []
        for ids, sizes in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(sizes[i])))
                at = own[-1][1]
            spans.append(own)
        links, j = [], 0
        for i, (low, high) in enumerate(spans[0]):
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < high:
                links.append((i, k))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = _walked(a, b, spans, cuts)
        rows.append((a, b, groups, [(a[i], b[k]) for i, k in links]))
        total.update(rows[-1][3])
    best = collections.Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(groups), len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links),
             ";".join("|".join(g) for g in groups)) for a, b, groups, links in rows]


def _walked(a, b, spans, cuts):
    out, i, j = [], 0, 0
    for cut in cuts:
        left, right = [], []
        while i < len(a) and spans[0][i][1] <= cut:
            left.append(str(a[i]))
            i += 1
        while j < len(b) and spans[1][j][1] <= cut:
            right.append(str(b[j]))
            j += 1
        out.append((",".join(left), ",".join(right)))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
TEXTS = ["plain words and a_long_identifier42", None, "", " ", "  two  spaces\n\ttabs", "<|endoftext|> and <s> </s> <unk>", "naïve café 東京 😀 ﬁ x́",
         "▁ a piece's own mark", "  wide", "a" * 700, "0x" + "0123456789abcdef" * 30, "same same same", "same same same", "e\u0000f", "<0x41> byte"]


@pytest.mark.parametrize("most", [ta.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, most):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in ta.align_tokens(frame, A_FILE, B_FILE, broadcast_pairs=most).collect()}
    want = brute(TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == want
    assert got[1] == got[2] == got[7] == (0, 0, 0, 0, 0, 0, "") and got[5][0] > 0 and got[11] == got[12]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in ta.op13_token_alignment(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for (doc_id, _), want in zip(docs, brute([t for _, t in docs]), strict=True):
        r = got[doc_id]
        assert tuple(r[n] for n in NAMES[:-1]) == want[:-1]
        assert r.groups_sha256 == (hashlib.sha256(want[-1].encode()).hexdigest() if want[0] else "")


def test_long_components_converge():
    """Tokens of 2 bytes against tokens of 2 bytes shifted by one: one component over the whole text."""
    n = 5000
    a, b = np.full(n, 2), np.concatenate(([1], np.full(n - 1, 2), [1]))
    found = ta.Aligned(np.cumsum(a), np.cumsum(b), a)
    assert found.closing.sum() == 1 and set(found.a_group) == set(found.b_group) == {0} and found.links_of_a.sum() == 2 * n


def test_odd_tables(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("groups", F.lit("taken")).withColumn("_row", F.lit("taken"))
    out = ta.align_tokens(frame, A_FILE, B_FILE)
    assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in out.collect()) == [("1", 0, 0), ("1", 2, 6), ("1", 2, 6), ("None", 2, 6)]
    for most in (10, 0):
        assert ta.align_tokens(frame.limit(0), A_FILE, B_FILE, broadcast_pairs=most).collect() == []
    named = ta.align_tokens(frame.select(F.lit("x").alias("name"), F.col("text").alias("body")), A_FILE, B_FILE, "name", "body")
    assert {r.doc_id for r in named.collect()} == {"x"}
