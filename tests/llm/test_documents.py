"""The operators on documents against brute force, and on odd rows."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vulnlake.llm import decontaminate, jaccard_join, line_dedup, mixing, pii, toxicity

DOCS = "doc_id bigint, text string, source string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long text, repeated rows, equal ids, and columns with the names of results."""
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (None, "word", "b"), (None, None, None), (5, "x y " * 20000, "b"),
            (6, "same text here now", "b"), (6, "same text here now", "b"), (6, "another one", "c")]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("size", "score", "copies", "n_lines", "contaminated", "spans", "emptied", "covered"):
        frame = frame.withColumn(name, F.lit("taken"))
    return frame


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# Mixing

def test_targets_are_filled_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, None: 500, "d": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    total, capped = 1511, set()
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(3 * sizes[s] for s in capped)
        want = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s, t in want.items() if t > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want |= {s: 3 * sizes[s] for s in capped}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_mix_is_repeatable_and_near_its_targets(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(1, 40)), rng.choice("aaaab")) for i in range(4000)], DOCS)
    plan = mixing.mixing_plan(docs).toPandas()
    assert plan.equals(mixing.mixing_plan(docs.repartition(7)).toPandas().set_index("doc_id").loc[plan.doc_id].reset_index()[plan.columns])
    for _, rows in plan.groupby("source"):
        assert (rows["size"] * rows["copies"]).sum() == pytest.approx(rows["target"].iloc[0], rel=0.05)
    assert (plan["copies"] <= 3).all()
    assert mixing.mix_sources(docs).count() == plan["copies"].sum()


def test_mix_of_odd_rows(spark, odd):
    plan = mixing.mixing_plan(odd)
    assert plan.count() == 9 and plan.filter("size = 0 AND text IS NULL").count() == 2
    assert set(plan.columns) >= {"copies", "score"} and dict(plan.dtypes)["copies"] == "bigint"
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, "a")], DOCS)).count() == 0


# Line dedup

def test_banded_distance_equals_levenshtein(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(600):
        a = [rng.choice("abcß😀") for _ in range(rng.randint(5, 30))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "😀"])
            b = b or ["a"]
        pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        rows = frame.filter((F.abs(F.length("a") - F.length("b")) <= t) & (F.length("a") > t) & (F.length("b") > t)).select(
            F.levenshtein("a", "b").alias("want"), line_dedup.banded_distance(F.col("a"), F.col("b"), t).alias("got")).collect()
        assert len(rows) > 200 and all(r.got == r.want if r.want <= t else r.got > t for r in rows)


def test_edit_join_loses_no_pair(spark):
    rng = random.Random(2)
    lines = set()
    for _ in range(80):
        base = [rng.choice("ab ") for _ in range(rng.randint(24, 40))]
        for _ in range(4):
            b = base[:]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(b))
                b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
            lines.add("".join(b))
    frame = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64("line", F.lit(1)))
    got = {(r.a, r.a2) for r in line_dedup.similar_lines(frame, 2).collect()}
    other = frame.select(F.col("a").alias("a2"), F.col("line").alias("m"))
    want = {(r.a, r.a2) for r in frame.join(other, F.abs(F.length("line") - F.length("m")) <= 2).filter("a < a2 AND levenshtein(line, m) <= 2").collect()}
    assert want and got == want


def test_links_of_large_groups_join_what_all_pairs_join(spark):
    """Pairs grow with a group's lines; variants of one line and lines that only share a part made all pairs before."""
    rng = random.Random(9)
    base = [rng.choice("abcdefgh ") for _ in range(90)]
    lines = {"".join(base)}
    for i in range(300):
        line, at = base[:], rng.randrange(30, 85)
        if i % 2:  # one edit off the base
            line[at] = rng.choice("xyzuvw")
        else:  # farther off, alike in letters
            line[at], line[(at + 17) % 55 + 30] = "q", "r"
            line[(at + 31) % 55 + 30] = rng.choice("ab")
        lines.add("".join(line))
    frame = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64("line", F.lit(1)))
    links = line_dedup.linked_lines(frame, 2)
    all_pairs = line_dedup.similar_lines(frame, 2)
    classes = [{r.id: r.component for r in line_dedup.components(pairs.select("a", F.col("a2").alias("b"))).collect()} for pairs in (links, all_pairs)]
    assert classes[0] == classes[1] and len(classes[0]) > 100
    assert links.count() <= 6 * len(lines) < all_pairs.count() / 2


def test_repeated_lines_go_and_first_stays(spark):
    first, near = "the very first line of some length", "the very first lines of some length"
    docs = [(1, f"{first}\nshort\nanother line that nobody else has", "a"), (2, f"short\n{near}\nand a line that is long and its own", "a"),
            (3, f"{first}\n{near} \n", "b"), (4, None, "b"), (5, "short", "b")]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert [got[i].text for i in range(1, 6)] == [docs[0][1], "short\nand a line that is long and its own", "", None, "short"]
    assert [got[i].n_removed for i in range(1, 6)] == [0, 1, 2, 0, 0] and [i for i in got if got[i].emptied] == [3]


def test_short_lines_go_if_they_are_equal(spark, tmp_path):
    docs = [(1, "Share\n\nHome\nits own text", "a"), (2, " Share \n\nShame\nother text", "a"), (3, "x\nShare\nx", "b"), (4, "\n \n", "b"), (5, None, "b")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(1, 6)] == [docs[0][1], "\nShame\nother text", "x", "\n \n", None]
    assert [got[i].n_removed for i in range(1, 6)] == [0, 1, 2, 0, 0]
    left = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(docs, DOCS), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in left} == {i: r.text for i, r in got.items()}


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.drop_repeated_lines(odd)
    assert got.count() == 9 and got.filter("n_removed > 0").count() == 0 and len(set(got.columns)) == len(got.columns)
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a line that is repeated in the table", "a")] * 3, DOCS)
    assert [r.n_removed for r in line_dedup.drop_repeated_lines(twice).collect()] == [0, 0, 0]


# Jaccard join

def brute_components(docs, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in docs:
        words = [w for w in SPACE.split((text or "").translate(low)) if w]
        sets[i] = {tuple(words[j:j + n]) for j in range(max(1, len(words) - n + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    docs, i = [], 0
    for _ in range(60):
        words = prose(rng, rng.choice([1, 3, 6, 9, 14, 30, 60, 120, 300]), "abc").split()
        for _ in range(rng.randint(1, 5)):
            copy = words[:]
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            if rng.random() < 0.3:
                words = copy
            docs.append((i, " ".join(copy), "a"))
            i += 1
    docs += [(i, None, "a"), (i + 1, " \n", "a"), (i + 2, docs[0][1].upper(), "b")]
    want = brute_components([(d, t) for d, t, _ in docs], n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(docs, DOCS), n, percent).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(docs) - 20


def test_large_group_is_one_component_and_one_stays(spark):
    rng = random.Random(9)
    base = prose(rng, 100).split()
    docs = []
    for i in range(300):
        words = base[:]
        words[rng.randrange(100)] = prose(rng, 1)
        docs.append((i, " ".join(words), "a"))
    frame = spark.createDataFrame(docs, DOCS)
    assert {r.component_id for r in jaccard_join.link_components(frame, 4, 85).collect()} == {r[1] for r in brute_components(
        [(d, t) for d, t, _ in docs], 4, 85).values()}
    assert [r.doc_id for r in jaccard_join.keep_one(frame).collect()][0] == 0


def test_allowances_cover_the_largest_difference():
    lows, choices = jaccard_join.bands(85, 5000)
    for low, high, (m, d, largest) in zip(lows, [*lows[1:], 2 * lows[-1]], choices, strict=True):
        most = max(jaccard_join.largest_difference(a, b, 85) for b in range(low, high) for a in range(max(1, b * 80 // 100), b + 1)) if high < 600 else None
        if most is not None:
            assert largest == high - 1 and (m + d > most if most > 0 else m == 0)


def test_jaccard_of_odd_rows(spark, odd):
    got = jaccard_join.link_components(odd).collect()
    assert len(got) == 9 and sum(r.n_shingles == 0 for r in got) == 4
    assert jaccard_join.link_components(empty(spark)).count() == 0 and jaccard_join.keep_one(odd).count() == 9


# Decontamination

QUESTION = "A farmer named Ada sells 12 eggs and 30 apples each day at the market, then walks 5 km home. How many things does Ada sell in 7 days?"


def test_verbatim_and_changed_questions_leak(spark):
    changed = QUESTION.replace("12", "15").replace("30", "44").replace("Ada", "Bea").replace("km", "miles")
    torn = QUESTION.replace("Ada sells", "Ada sells").replace("does Ada", "does Bea")
    other = prose(random.Random(3), 60)
    docs = spark.createDataFrame([(1, f"intro words here. {QUESTION.upper()} more", "a"), (2, f"{other} {changed} {other}", "a"), (3, other, "a"),
                                  (4, None, "a"), (5, "12 30 5 7 12 30 5 7 12 30 5 7", "a")], DOCS)
    bench = spark.createDataFrame([(10, QUESTION), (11, None), (12, "1 2 3 4 5 6 7 8 9"), (13, "too short"), (14, "5 7 12 31")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.flag_leaks(docs, bench).collect()}
    assert [got[i].contaminated for i in range(1, 6)] == [True, True, False, False, False]
    assert got[2].changed and list(got[2]["items"]) == [10]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [3, 4, 5]
    assert torn != QUESTION


def test_slots_have_to_be_consistent(spark):
    item = "take 12 red cups and put 12 blue cups beside the 12 green cups on that table"
    good, bad = item.replace("12", "9"), "take 9 red cups and put 8 blue cups beside the 7 green cups on that table"
    docs = spark.createDataFrame([(1, good, "a"), (2, bad, "a")], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same text here now")], "item_id bigint, text string")
    got = decontaminate.flag_leaks(odd, bench)
    assert got.count() == 9 and got.filter("contaminated").count() == 2 and len(set(got.columns)) == len(got.columns)
    nothing = empty(spark, "item_id bigint, text string")
    assert decontaminate.decontaminate(odd, nothing).count() == 9 and decontaminate.flag_leaks(empty(spark), bench).count() == 0


def test_verbatim_quotes_are_found_whatever_they_hold(spark):
    """Items of 3 to 200 words, prose and arithmetic; documents with a whole item, with a run of its words, or with shorter runs only."""
    rng = random.Random(9)
    signs = lambda n: " ".join(rng.choice(["+", "*", "=", "?", "x", str(rng.randint(0, 99)), f"{rng.randint(2, 9)}x"]) for _ in range(n))
    items = [(0, "What is 12 * 7 ?"), (1, "Solve 2 x + 3 = 11")]
    items += [(i, f"{prose(rng, 1)} {signs(n - 1)}" if i % 3 == 0 else prose(rng, n)) for i, n in enumerate([3, 4, 5, 7, 8, 9, 12, 20, 59, 120, 200] * 3, 2)]
    docs, want = [], set()
    for i, text in items:
        words, around = text.split(" "), (prose(rng, 20), prose(rng, 20))
        docs.append((10 * i, f"{around[0]} {text} {around[1]}", "whole"))
        want.add((10 * i, i))
        if len(words) >= 50:
            at = rng.randrange(len(words) - 50)
            docs += [(10 * i + 1, f"{around[1]} {' '.join(words[at:at + 13])} {around[0]}", "run"), (10 * i + 2, f"{around[1]} {' '.join(words[at:at + 7])} {around[0]}", "short")]
            want.add((10 * i + 1, i))
        docs.append((10 * i + 3, " ".join(around), "clean"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    texts = {i: t for i, t, _ in docs}
    # What was not put there on purpose may still stand there: short items in longer ones.
    extra = {(d, i) for d, i in got - want if f" {dict(items)[i]} " not in f" {texts[d]} "}
    assert want <= got and not extra


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
    found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if holds(k, m[0]))
    return ",".join(x[2] for x in found)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "a@b.c+x@d.e", "ü😀", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.4",
             "+1 (743) 555-3824", "+12", "99999999999", "x@y", "@", ".", "+", "-", " ", "5", "a.b@c-d.ef.", "12345678901234567890123"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 12))), "a") for i in range(800)]
    docs += [(900, None, "a"), (901, "1" * 50000, "a"), (902, "a" * 50000, "a"), (903, "5 " * 30000 + "b@c.d", "a"), (904, "1.2.3.4 " * 700, "a")]
    got = spark.createDataFrame(docs, DOCS).select("doc_id", pii.digest_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: brute_spans(t) for i, t, _ in docs}


def test_disclosing_terms_are_added_and_generalised(spark):
    rng = random.Random(6)
    docs = [(i, f"{prose(rng, 30)} write the unicornist at some@one.org {prose(rng, 30)}", "a") for i in range(5)]
    docs += [(10 + i, f"{prose(rng, 40)} write the person at u{i}@other.net {prose(rng, 40)}", "a") for i in range(60)]
    docs += [(200, None, None)]
    frame = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in pii.find_spans(frame).collect()}
    for i, text, _ in docs[:5]:
        terms = {s["value"] for s in got[i].spans if s["kind"] == "term"}
        assert terms == {"unicornist"} and all(text[s["start"]:s["end"]] == s["value"] for s in got[i].spans)
    assert not any(s["kind"] == "term" for i in got if i >= 10 for s in got[i].spans)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "[term] at [email]" in clean[0] and "person at [email]" in clean[10] and clean[200] is None and len(clean) == len(docs)


def test_terms_of_entities_with_few_documents_are_found_far_away(spark):
    rng = random.Random(16)
    docs = [(i, ". ".join(prose(rng, 12) for _ in range(8)), "a") for i in range(200)]
    far = ". ".join(prose(rng, 12) for _ in range(6))
    docs += [(500, f"The falconeress wrote. {far}. Ask at one@place.org today. {far[::-1]}. Then the Falconeress left. A falconeress.", "a"),
             (501, f"Write two@place.org now. {far[5:]}. Nobody saw the zitherist", "a"), (502, f"A zitherist plays. {far[9:]}. On two@place.org", "a"),
             (503, "two@place.org", "a"), (504, f"{prose(rng, 30)} once@place.org {prose(rng, 30)} singular", "a")]
    got = {r.doc_id: [s["value"] for s in r.spans if s["kind"] == "term"] for r in pii.find_spans(spark.createDataFrame(docs, DOCS)).collect()}
    assert [x for x in got[500] if x.lower() == "falconeress"] == ["falconeress", "Falconeress", "falconeress"]
    assert "zitherist" in got[501] and "zitherist" in got[502] and got[503] == got[504] == [] and not any(got[i] for i in range(200))


def test_copies_of_a_text_do_not_change_its_terms(spark):
    rng = random.Random(17)
    docs = [(i, ". ".join(prose(rng, 12) for _ in range(8)), "a") for i in range(100)]
    plain = f"A falconeress. {prose(rng, 40)}. Ask one@place.org. The falconeress"
    once = pii.find_spans(spark.createDataFrame([*docs, (500, plain, "a")], DOCS)).filter("doc_id = 500").collect()
    many = pii.find_spans(spark.createDataFrame([*docs, *[(500 + i, plain, "a") for i in range(40)]], DOCS)).filter("doc_id >= 500").collect()
    assert len(many) == 40 and len(once[0].spans) > 1 and all(r.spans == once[0].spans for r in many)


def test_personal_data_of_odd_rows(spark, odd):
    assert pii.find_spans(odd).count() == 9 and pii.find_spans(empty(spark)).count() == 0
    assert pii.sanitise(odd).count() == 9


# Toxicity

def toxic_fixture(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, 60, "aeioursn").split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(60)] = rng.choice(["zounds", "vileling", "vilest", "cretinous"])
        docs.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_held_out_accuracy_and_odd_rows(spark, odd):
    docs, labels, truth = toxic_fixture(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 1"))
    rows = toxicity.score_texts(docs, model).collect()
    held = [r for r in rows if r.doc_id % 3 == 1]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert not [r.doc_id for r in held if r.predicted and not truth[r.doc_id]]
    assert all(0 <= r.score <= 1 for r in rows)
    scored = toxicity.score_texts(odd, model)
    assert scored.count() == 9 and dict(scored.dtypes)["score"] == "double"
    assert toxicity.score_texts(empty(spark), model).count() == 0
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score for r in toxicity.score_texts(odd, toxicity.fit(docs, none)).collect()} == {0.5}
    toxicity.score_texts(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).collect()


def test_block_max_search_equals_all_comparisons():
    import numpy as np
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        places = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        weights = rng.random(len(places))
        vectors.append((places, weights / np.sqrt((weights ** 2).sum())))
    index = toxicity.Index(list(range(700)), vectors, [int(x) for x in rng.integers(0, 2, 700)], 60)
    dense = np.zeros((700, 60))
    for i, (p, w) in enumerate(vectors):
        dense[i, p] = w
    for p, w in vectors[:100]:
        q = np.zeros(60)
        q[p] = w
        all_scores = (dense @ q)[index.ids]
        want = np.lexsort((np.arange(700), -all_scores))[:25]
        rows, scores = index.nearest(p, w, 25)
        keep = all_scores[want] > 0
        assert np.allclose(np.sort(scores)[::-1], all_scores[want][keep])


def test_isotonic_rises():
    import numpy as np
    raw = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    steps, levels = toxicity.isotonic(raw, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(steps) > 0).all() and (np.diff(levels) >= 0).all()


# What they share

def test_components_equal_union_find(spark):
    from vulnlake.llm.common import components
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)]
    parent = collections.defaultdict(lambda: None)

    def root(x):
        while parent[x] is not None:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_prefix_sums_of_long_arrays(spark):
    from vulnlake.llm.common import prefix_sums
    frame = spark.range(3).select(F.when(F.col("id") == 0, F.array().cast("array<bigint>")).when(
        F.col("id") == 1, F.sequence(F.lit(1), F.lit(1000))).otherwise(F.array(F.lit(7).cast("bigint"))).cast("array<bigint>").alias("a"))
    rows = frame.select("a", prefix_sums(F.col("a")).alias("p")).collect()
    assert all(r.p == [sum(r.a[:i]) for i in range(len(r.a))] for r in rows)


def test_digest_is_of_the_joined_spans(spark):
    text = "mail a@b.c now"
    row = spark.createDataFrame([(text,)], "text string").select(F.sha2(pii.digest_text(pii.base_spans(F.col("text"))), 256).alias("d")).first()
    assert row.d == hashlib.sha256(b"email:5:10").hexdigest()


def test_one_of_near_copies_under_one_id_stays(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(7, base, "a"), (7, base + " more", "a"), (7, base + " other end", "b"), (None, "x " + base, "b"), (8, "alone here", "b"), (None, None, None), (None, "", None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect()) == [("7", "word0"), ("8", "alone"), ("None", ""), ("None", "")]
    nulls = jaccard_join.keep_one(spark.createDataFrame([(None, base, "a"), (None, base + " more", "a")], DOCS))
    assert nulls.count() == 1


def test_ids_of_examples_may_be_strings(spark):
    docs, labels, _ = toxic_fixture(spark)
    named = [f.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))) for f in (docs, labels)]
    rows = toxicity.score_texts(named[0], toxicity.fit(*named)).filter("size(evidence) > 0").collect()
    assert rows and all(e.startswith("d") for r in rows for e in r.evidence)
