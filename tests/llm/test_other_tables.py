"""The operators on pages, embeddings and conversations, and the pipeline."""

import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vulnlake.llm import chat, embedding_dedup, queries, url_filter, warc
from vulnlake.llm.common import table

PAGES = "page_id bigint, url string, html string"
FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


# URL filter

def test_longest_rule_wins_on_hosts_and_subdomains(spark):
    urls = {"http://a.example.net/en/1": ("example.net/en/", "allow"), "http://EXAMPLE.net/de/1?x=/en/": ("net/", "block"),
            "https://www.example.com/de/3#t": ("example.com/de/", "block"), "http://notexample.com/de/": (None, "allow"),
            "http://example.org/fr/9": ("org/fr/", "allow"), "http://example.org/en/9": (None, "allow"), "no scheme": (None, "allow"),
            "x://net?a/b": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "ftp://b.net/": ("net/", "block")}
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge_urls(frame).collect()}
    assert got == urls
    parts = {r.url: (r.host, r.path) for r in url_filter.judge_urls(frame).collect()}
    assert parts["x://net?a/b"] == ("net", "") and parts[None] == ("", "") and parts["http://EXAMPLE.net/de/1?x=/en/"] == ("example.net", "/de/1")


def test_templates_generalise_merge_and_reject(spark):
    rows = []
    for i in range(300):
        rows += [(f"http://shop.test/item/{i}", 0), (f"http://shop.test/spam/{i}/buy", 1), (f"http://shop.test/junk/{i}/buy", 1),
                 (f"http://shop.test/user/u{chr(97 + i % 26)}{i}x/home", None)]
    frame = spark.createDataFrame(rows, "url string, bad int")
    got = {r.url: r for r in url_filter.judge_urls(frame, rules=(), label="bad").collect()}
    assert got["http://shop.test/spam/7/buy"].template == got["http://shop.test/junk/9/buy"].template == "/{junk|spam}/<n>/buy"
    assert got["http://shop.test/spam/7/buy"].verdict == "block" and got["http://shop.test/item/7"].verdict == "allow"
    assert got["http://shop.test/user/ua0x/home"].template == "/user/*/home" and got["http://shop.test/user/ua0x/home"].verdict == "allow"


def test_urls_of_odd_tables(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
    clash = spark.createDataFrame([(1, "http://a.net/" + "x/" * 5000, "h")] * 2, PAGES).withColumn("host", F.lit(1)).withColumn("Verdict", F.lit(2))
    got = url_filter.judge_urls(clash)
    assert [r.verdict for r in got.select("verdict").collect()] == ["block"] * 2


# Archives

def test_archives_round_trip(spark, tmp_path):
    long, longer = "é" * 600, "<html>" + "x" * 300000
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (3, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (None, "u", long), (None, "v", longer), (8, "w", "a\r\n\r\nb" * 300), (9, "w", "a\r\n\r\nb" * 300), (9, "w", "a\r\n\r\nb" * 300)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/w", file_bytes=2000)
    got = warc.read_records(index, f"file://{tmp_path}/w").collect()
    want = []
    for i, url, html in rows:
        body = (html or "").encode()
        largest = max((p for p, _, h in rows if h == html and p is not None), default=None)
        revisit = len(body) >= 1000 and largest is not None and i != largest
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", largest if revisit else None, None if revisit else body.decode()))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got], key=key) == sorted(want, key=key)
    for entry in index.collect():
        with open(f"{tmp_path}/w/{entry.file}", "rb") as f:
            f.seek(entry.offset)
            assert gzip.decompress(f.read(entry.length)).startswith(b"WARC/1.1\r\nWARC-Type: ")
    some = warc.read_records(index.filter("page_id IN (2, 9)"), f"file://{tmp_path}/w").collect()
    assert sorted(r.page_id for r in some) == [2, 9, 9]
    assert warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e").count() == 0


def test_neighbours_share_a_read():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"file": ["a"] * 4 + ["b"], "offset": [0, 10, 100, 130, 0], "length": [10, 10, 30, 10, 5]})
    assert list(warc._ranges(iter([batch]), gap=5, most=50)) == [
        ("a", 0, [(0, 10), (10, 10)]), ("a", 100, [(100, 30), (130, 10)]), ("b", 0, [(0, 5)])]


# Embeddings

def brute_links(rows, threshold):
    usable = {i: (lab, np.array(v, np.float32).astype(float)) for i, v, lab in rows
              if lab is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v) != 0)}
    links = {i: set() for i, _, _ in rows}
    for a, (la, x) in usable.items():
        for b, (lb, y) in usable.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def test_links_equal_brute_force(spark):
    rng, rows = np.random.default_rng(1), []
    for label in (1, 2):
        for _ in range(60):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((len(rows), [float(x) for x in base + rng.standard_normal(16) * rng.choice([0, 0.02, 0.06])], label))
    base = rng.standard_normal(16)
    rows += [(1000 + i, [float(x) for x in base + rng.standard_normal(16) * 0.05], 1) for i in range(150)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] + [None] * 15, 1), (2004, rows[0][1], None),
             (2005, [float("inf")] * 16, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, rows[-5][1], 2), (2009, [], 1)]
    want = brute_links(rows, 0.98)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert {i: got[i].n_links for i in want} == {i: len(x) for i, x in want.items()}
    for i in want:
        reached, new = {i}, {i}
        while new:
            new = {y for x in new for y in want[x]} - reached
            reached |= new
        assert got[i].component_id == min(reached) and got[i].kept == (min(reached) == i)


def test_embeddings_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int, n_links string"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, 1, "x"), (None, [1.0], None, "y")], schema)).collect()
    assert [(r.n_links, r.component_id) for r in sorted(got, key=str)] == [(0, 1), (0, None)]
    same = embedding_dedup.near_duplicates(spark.createDataFrame([(i, [1.0, 0.5], 1, "x") for i in (3, 4, 4, 9)], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in same} == {(3, 3, 3), (4, 3, 3), (9, 3, 3)}


# Chat

def test_chunked_viterbi_equals_plain(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            text = "\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 50 if role == "assistant" else 8))) for _ in range(rng.randint(1, 3)))
            rows.append((c, t, role, text + ("?" if role == "user" else "")))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    lines = chat.transcript_lines(turns).cache()
    model = chat.fit(lines)
    monkeypatch.setattr(chat, "CHUNK", 4)
    got = {(r.conv_id, r.line_no): r for r in chat.tag_lines(lines.select("conv_id", "line_no", "text"), model).collect()}
    known = lines.collect()
    assert len(got) == len(known)
    for c in range(12):
        own = sorted((r for r in known if r.conv_id == c), key=lambda r: r.line_no)
        assert [r.line_no for r in own] == list(range(len(own)))
        codes = np.array([chat.features(r.text) for r in own])
        states = model.path(codes, True, 0, int(model.product(codes, True)[0].argmax()))
        assert [got[c, r.line_no].role for r in own] == [chat.STATES[s][0] for s in states]
    right = sum(got[r.conv_id, r.line_no].role == r.role for r in known)
    assert right >= 0.9 * len(known)


def test_turns_are_rendered(spark):
    tagged = spark.createDataFrame([(1, 0, "User: hi", "user", True), (1, 1, "there", "user", False), (1, 2, "", "user", False),
                                    (1, 3, "### AI: hello", "assistant", True), (None, 0, None, "user", False)],
                                   "conv_id bigint, line_no bigint, text string, role string, start boolean")
    got = {(r.conv_id, r.turn): r.rendered for r in chat.render_turns(tagged).collect()}
    assert got == {(1, 0): "<|user|>\nhi\nthere\n<|end|>", (1, 1): "<|assistant|>\nhello\n<|end|>", (None, 0): "<|user|>\n\n<|end|>"}


def test_chat_of_odd_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    odd = spark.createDataFrame([(None, 0, "user", "a"), (1, None, None, None), (1, 1, "tool", ""), (2, 1, "user", "x\n" * 3000), (2, 1, "user", "x\n" * 3000)], schema)
    lines = chat.transcript_lines(odd)
    tagged = chat.tag_lines(lines.select("conv_id", "line_no", "text"), chat.fit(lines))
    assert tagged.count() == lines.count() == 1 + 1 + 1 + 6002
    none = chat.transcript_lines(spark.createDataFrame([], schema))
    assert chat.render_turns(chat.tag_lines(none.select("conv_id", "line_no", "text"), chat.fit(none))).count() == 0


# Pipeline and queries

@with_tables
def test_pipeline_stages_do_their_work(spark, tmp_path):
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passage = prose(60)
    question = prose(40)
    clean = {i: prose(80) for i in range(1, 200)}
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in clean.items()]
    toxic = {i: prose(50) + " vileness vilest zounds vileness " + prose(30) for i in range(300, 360)}
    docs += [(i, t, "en", "s0", len(t)) for i, t in toxic.items()]
    near = clean[5].split()
    near[40] = "changed"
    docs += [(400, clean[4], "en", "s1", 1), (401, " ".join(near), "en", "s1", 1), (402, f"{prose(70)}\n{passage}", "en", "s1", 1),
             (403, f"{prose(70)}\n{passage}", "en", "s2", 1), (404, f"{prose(60)} {question} {prose(60)}", "en", "s2", 1), (405, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i in toxic)) for i, *_ in docs if i < 400]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, left = table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path)).cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id: r.text for r in frame.collect()}
    assert not set(left["drop_toxic"]) & set(toxic) and set(clean) < set(left["drop_toxic"])
    lines = left["drop_repeated_lines"]
    assert 400 not in lines and passage in lines[402] and passage not in lines[403] and all(lines[i] == t for i, t in clean.items())
    assert set(lines) - set(left["keep_one_of_near_copies"]) == {401}
    assert set(left["keep_one_of_near_copies"]) - set(left["drop_benchmark_leaks"]) == {404}
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in mixed.select("doc_id").distinct().collect()} <= set(left["drop_benchmark_leaks"])
    plan = mixed.groupBy("source").agg(F.sum("size").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r.taken == pytest.approx(r.target, rel=0.2) for r in plan if r.target > 2000)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_turns_that_tie_keep_their_lines_together(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line of A"), (1, 0, "user", "Other message\nsecond line of B"), (1, 1, "assistant", "x\ny"), (1, 1, "assistant", "x\ny")]
    lines = chat.transcript_lines(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"), marked=0.0)
    texts = [r.text for r in lines.orderBy("line_no").collect()]
    first = [texts[0:2], texts[2:4]]
    assert sorted(first) == [["Hello there", "second line of A"], ["Other message", "second line of B"]] and texts[4:] == ["x", "y", "x", "y"]
