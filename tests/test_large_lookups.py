"""Lookups in large tables: catalogues of parts of texts, and version ranges."""

import random

from pyspark.sql import functions as F

from vulnlake.operators import lookups


def test_first_contained_part_of_a_large_catalogue(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé-") for _ in range(n))
    parts = [(i, word(rng.choice([1, 2, 3, 4, 5, 6])), f"c{i}") for i in rng.sample(range(100000), 1500)]
    parts = [p for p in parts if len(p[1]) > 2 or rng.random() < 0.01]
    texts = [word(rng.randint(0, 14)).upper() for _ in range(600)] + ["", None, "zzz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50]])], "id int, text string").repartition(4)
    got = {r.id: r.category for r in lookups.first_contained(rows, "text", spark.createDataFrame(parts, "place int, part string, category string")).collect()}
    ordered = sorted(parts)
    want = {i: next((c for _, p, c in ordered if t is not None and p in t.lower()), None) for i, t in enumerate([*texts, *texts[:50]])}
    assert got == want and len({v for v in want.values()}) > 50 and want[0] == want[len(texts)]


def numbers(version):
    parts = "".join(c if c.isdigit() else "." for c in version.lstrip("~^>=<")).split(".")
    return [int(p) for p in parts if p]


def meets(version, affected):
    v = numbers(version)
    for bound in affected.split(","):
        op = bound[:len(bound) - len(bound.lstrip("<>="))]
        limit = numbers(bound)
        if not {"<": v < limit, "<=": v <= limit, ">": v > limit, ">=": v >= limit, "=": v == limit, "": v == limit}[op]:
            return False
    return True


def test_ranges_of_a_hot_package(spark):
    rng = random.Random(8)
    version = lambda: ".".join(str(rng.choice([0, 1, 2, 3, 10, 12])) for _ in range(rng.randint(1, 3)))
    ranges = []
    for i in range(500):
        package = "hot" if i % 5 else rng.choice(["a", "b", "rare"])
        affected = rng.choice([lambda: "<" + version(), lambda: f">={version()},<{version()}", lambda: "=" + version(), version, lambda: "<=" + version(),
                               lambda: f">{version()},<={version()},<{version()}"])()
        ranges.append((package, affected, f"CVE-{i}"))
    names = ["Hot", "hot", "a", "b", "unknown"]
    deps = [(i, rng.choice(names), rng.choice([version(), "^" + version(), "*", "latest"])) for i in range(400)] + [(900, None, "1"), (901, "hot", None)]
    frame = spark.createDataFrame(deps, "id int, name string, version string").repartition(3)
    table = spark.createDataFrame(ranges, "package string, affected string, cve_id string")
    got = lookups.match_advisory_ranges(frame, table).select("id", "cve_id").collect()
    want = {(i, c) for i, n, v in deps if n and v for p, a, c in ranges if p == n.lower() and meets(v, a)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 5000
    plain = lookups.match_advisories(frame, table)
    assert {tuple(r) for r in plain.select("id", "cve_id").collect()} == want and set(plain.columns) == set(lookups.match_advisory_ranges(frame, table).columns)
    assert lookups.match_advisory_ranges(frame, table.limit(0)).collect() == [] and lookups.match_advisory_ranges(frame.limit(0), table).collect() == []


def test_blocks_make_up_the_interval(spark):
    rows = [(a, b) for a in range(0, 20) for b in range(0, 20)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint")
    for r in frame.select("a", "b", lookups._dyadic(F.col("a"), F.col("b"), 5).alias("blocks")).collect():
        covered = [n for x in r.blocks for n in range(x.block << x.level, (x.block + 1) << x.level)]
        assert sorted(covered) == list(range(r.a, r.b + 1))


def test_parts_that_differ_in_their_last_letters_meet_few_texts(spark):
    """Each part has a gram of its own, so the texts make about as many pairs as they have hits; a gram of three bytes met a tenth of all."""
    from vulnlake.operators import grams

    n = 3000
    parts = spark.range(n).select(F.concat(F.lit("issue "), (F.col("id") + 10000).cast("string")).alias("part"))
    index = grams.rarest_grams(parts.select("part", F.explode(grams.long_grams(F.col("part"))).alias("gram")), ["part"])
    texts = parts.select(F.concat("part", F.lit(" in module module é")).alias("text"), "part")
    met = texts.select("text", F.explode(grams.grams_of(F.col("text"), 8)).alias("gram")).join(index, "gram")
    assert met.count() <= 3 * n and met.filter(F.col("text").contains(F.col("part"))).count() == n


def test_parts_of_every_length_are_found(spark):
    names = ["", "é", "abc", "abcd", "abcde", "x" * 8, "y" * 15 + "z", "q" * 100, "Ä" * 20]
    catalogue = spark.createDataFrame([(i, p, f"c{i}") for i, p in enumerate(names) if p], "place int, part string, category string")
    texts = [f"-{p.upper()}-" for p in names] + ["", "abce", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.category for r in lookups.first_contained(rows, "text", catalogue).collect()}
    want = {i: None if t is None else next((f"c{j}" for j, p in enumerate(names) if p and p.lower() in t.lower()), None) for i, t in enumerate(texts)}
    assert got == want


def test_equal_ranges_are_met_once(spark, tmp_path, monkeypatch):
    """Ranges that differ in their number only are one row of the join; their number still counts."""
    from vulnlake.plans import catalog, tables

    lines = [(k, p, s, n) for k, (p, s, n) in enumerate((p, s, n) for p in (1, 7, 29) for s in (3, 4) for n in (1, 2))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, match = [], lookups.match_advisory_ranges
    monkeypatch.setattr(lookups, "match_advisory_ranges", lambda names, ranges: seen.append(ranges.count()) or match(names, ranges))
    results = []
    period = 60 * 37 * len(tables.PACKAGES)  # part keys this far apart have equal ranges of one package
    for copies in (1, 3):
        parts = spark.range(600).crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
        parts.select((F.col("id") + F.col("copy") * period).alias("p_partkey")).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        results.append({(r.name, r.version): r.hits for r in catalog.QUERIES["x8_advisory_ranges"](spark, str(tmp_path)).collect()})
    assert results[0] and results[1] == {k: 3 * n for k, n in results[0].items()}
    assert seen[0] == seen[1] <= 600


def test_exploded_grams_are_not_broadcast(spark, tmp_path):
    """The plan takes the grams of a packed table for a few bytes; they went through the driver."""
    from vulnlake.operators import grams

    spark.range(5000).select(F.concat(F.lit("issue "), (F.col("id") + 10000).cast("string")).alias("part")).write.parquet(str(tmp_path / "parts"))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    index = grams.rarest_grams(parts.select("part", F.explode(grams.long_grams(F.col("part"))).alias("gram")), ["part"])
    assert index.count() == 5000
    assert "Broadcast" not in index._jdf.queryExecution().executedPlan().toString()


def test_parts_of_one_place_are_told_apart_by_value(spark):
    texts = spark.createDataFrame([(0, "aaaa bbbb cccc"), (1, "cccc bbbb"), (2, "cccc")], "id int, text string")
    rows = [(7, "cccc", "c"), (7, "aaaa", "a"), (7, "bbbb", "b")]
    for ordered in (rows, rows[::-1]):
        parts = spark.createDataFrame(ordered, "place int, part string, category string").coalesce(1)
        assert {r.id: r.category for r in lookups.first_contained(texts, "text", parts).collect()} == {0: "a", 1: "b", 2: "c"}
