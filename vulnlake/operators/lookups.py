"""Joins of findings, dependencies and samples against lookup tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import dimensions as dim
from vulnlake.functions.severity import mapped
from vulnlake.functions.text import computed_once, contains_any
from vulnlake.functions.versions import bounds_of, parse_version, within_bounds
from vulnlake.operators.grams import EVERY_TEXT, LENGTHS, grams_of, long_grams, rarest_grams, sent_if_small
from vulnlake.operators.scale import kept, number_rows


def with_asvs(findings: DataFrame) -> DataFrame:
    """Adds the ASVS columns by finding type (left join to a fixed 13-row table)."""
    return findings.join(F.broadcast(dim.asvs_table(findings.sparkSession)), "type", "left")


def with_pci(findings: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(dim.pci_table(findings.sparkSession)), "type", "left")


def with_owasp_2021(findings: DataFrame) -> DataFrame:
    """Adds ``owasp_2021`` and its id by CWE."""
    joined = findings.join(F.broadcast(dim.cwe_owasp_table(findings.sparkSession)), "cwe", "left")
    return joined.withColumn("owasp_id", F.element_at(F.split("owasp_2021", " - "), 1))


def _first_contained(text: Column, parts: dict[str, str], fallbacks) -> Column:
    """Category of the first listed part that occurs in the text, then of the fallback words."""
    low = F.lower(text)
    cases = reduce(lambda chain, item: chain.when(low.contains(item[0]), item[1]), list(parts.items())[1:],
                   F.when(low.contains(next(iter(parts))), next(iter(parts.values()))))
    return reduce(lambda chain, item: chain.when(contains_any(low, item[0]), item[1]), fallbacks, cases)


def _parts(index: int) -> dict[str, str]:
    lookup: dict[str, str] = {}
    for category, row in dim.OWASP_CATEGORIES.items():
        for part in row[index]:
            lookup[part.lower()] = category
    return lookup


def owasp_of_rule_id(rule_id: Column) -> Column:
    """OWASP category of a rule id by containment; first match in table order wins.

    A case chain stops at the first hit, where a join on containment would compare every
    pair and then pick the lowest place per row.
    """
    return _first_contained(rule_id, _parts(2), dim.RULE_ID_FALLBACKS)


def owasp_of_type(kind: Column) -> Column:
    return _first_contained(kind, _parts(4), dim.TYPE_FALLBACKS)


def first_contained(rows: DataFrame, text: str, catalogue: DataFrame, result: str = "category") -> DataFrame:
    """Adds the category of the first part, by ``place`` and then by value, that a text holds in any case; null if it holds none.

    ``catalogue`` (place, part, category) may have any number of parts. Each stands in an index under its rarest gram of the
    greatest length (`grams.LENGTHS`) that fits into it, so that parts that differ in their last letters only do not share one; a
    part shorter than all of them stands under a gram of every text. Equal texts are looked up once, and meet only parts whose
    gram they hold.
    """
    parts = catalogue.select("place", F.lower("part").alias("part"), F.col("category").alias("_category"))
    short = F.octet_length("part") < LENGTHS[0]
    long = rarest_grams(parts.filter(~short).select("*", F.explode(long_grams(F.col("part"))).alias("gram")), parts.columns)
    index = kept(long.unionByName(parts.filter(short).withColumn("gram", F.lit(EVERY_TEXT))), "index")
    sizes = sorted(r[0] for r in index.select(F.octet_length("part").alias("n")).distinct().select(
        F.greatest(*[F.when(F.col("n") >= m, m).otherwise(0) for m in (0, *LENGTHS)])).distinct().collect())
    texts = computed_once(rows.select(F.lower(text).alias("_text")).distinct(), _low=F.col("_text"))
    asked = F.concat(F.array(F.lit(EVERY_TEXT).cast("bigint")), *[grams_of(F.col("_low"), n) for n in sizes if n])
    met = texts.select("_low", F.explode(asked).alias("gram")).join(sent_if_small(index), "gram").filter(F.col("_low").contains(F.col("part")))
    found = met.groupBy("_low").agg(F.min_by("_category", F.struct("place", "part")).alias(result))
    return rows.join(found, F.lower(text) == F.col("_low"), "left").drop("_low")


def owasp_of_test(test_id: Column) -> Column:
    lookup = {test: category for category, row in dim.OWASP_CATEGORIES.items() for test in row[3]}
    return mapped(test_id, lookup)


def with_cwe_group(samples: DataFrame, default: str | None = None, keep_unmapped: bool = False) -> DataFrame:
    """OWASP group of a CWE number; unmapped rows are dropped, kept as null or given a default."""
    how = "left" if default or keep_unmapped else "inner"
    joined = samples.join(F.broadcast(dim.cwe_group_table(samples.sparkSession)), "cwe_id", how)
    if default:
        joined = joined.withColumn("owasp_category", F.coalesce("owasp_category", F.lit(default)))
    return joined


def with_remediation(findings: DataFrame) -> DataFrame:
    """Adds OWASP label and advice by ``cwe_id``, with the defaults of the finding view."""
    table = F.broadcast(dim.remediation_table(findings.sparkSession))
    advice = F.concat(F.lit("Review and fix the security issue at line "), F.col("start_line").cast("string"),
                      F.lit(". Consult the CWE database for more information."))
    return (findings.withColumn("cwe_id", F.coalesce("cwe_id", F.lit("CWE-UNKNOWN"))).join(table, "cwe_id", "left")
            .withColumn("owasp_label", F.coalesce("owasp_label", F.lit("Unknown Category")))
            .withColumn("recommendation", F.coalesce("recommendation", advice)))


def match_advisories(dependencies: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Dependencies hit by an advisory: same name in lower case and version in the range.

    The built-in table has 17 rows and is broadcast. For a table handed in, Spark chooses
    the join by its size; the equi-join on the name works at any size.
    """
    builtin = advisories is None
    adv = dim.advisory_table(dependencies.sparkSession) if builtin else advisories
    adv = adv.withColumnRenamed("package", "_package").withColumn("_bounds", bounds_of(F.col("affected")))
    parsed = computed_once(dependencies, _version=parse_version(F.col("version")))
    joined = parsed.join(F.broadcast(adv) if builtin else adv, F.lower("name") == F.col("_package"))
    return (joined.filter(within_bounds(F.col("_version"), F.col("_bounds")))
            .withColumn("fixed_version", F.replace("affected", F.lit("<"), F.lit("")))
            .drop("_package", "_bounds", "_version"))


def _version_key(numbers: Column) -> Column:
    """A text that sorts as the numbers of a version do: digits of equal width, so a version comes before those it begins."""
    return F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 16, "0")), "")


def _interval(bounds: Column) -> list[Column]:
    """(low, low_open, high, high_open) of bounds that hold together, as version keys; null where there is no bound."""
    def tightest(ops: tuple[str, ...], choose, open_op: str):
        limits = F.transform(F.filter(bounds, lambda b: b["op"].isin(*ops)), lambda b: F.struct(
            _version_key(b["numbers"]).alias("key"), (b["op"] == open_op).cast("int").alias("open")))
        return choose(limits)

    # Of equal limits the open one is the tighter: it sorts last among low ones, and first among high ones when turned round.
    low = tightest((">", ">=", "=", ""), F.array_max, ">")
    high = F.array_min(F.transform(F.filter(bounds, lambda b: b["op"].isin("<", "<=", "=", "")), lambda b: F.struct(
        _version_key(b["numbers"]).alias("key"), (b["op"] != "<").cast("int").alias("closed"))))
    return [low["key"].alias("_low"), low["open"].alias("_low_open"), high["key"].alias("_high"), (1 - high["closed"]).alias("_high_open")]


def _dyadic(low: Column, high: Column, levels: int) -> Column:
    """Blocks (level, block) of 2 ** level numbers that together are the numbers from low to high, each once."""
    start = F.struct(low.alias("a"), high.alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(state, level):
        a, b, none = state["a"], state["b"], F.array().cast("array<struct<level:int,block:bigint>>")
        block = lambda n: F.array(F.struct(level.alias("level"), n.alias("block")))
        left = F.when((a <= b) & (a % 2 == 1), block(a)).otherwise(none)
        right = F.when((a <= b) & (b % 2 == 0) & ~((a == b) & (a % 2 == 1)), block(b)).otherwise(none)
        return F.struct(F.shiftright(a + 1, 1).alias("a"), F.shiftright(b - 1, 1).alias("b"), F.concat(state["out"], left, right).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["out"])


def match_advisory_ranges(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """As `match_advisories` for large tables: a package may have any number of ranges and versions, and only pairs that match are made.

    Versions become texts that sort like them. The versions and limits of a package are numbered in order; a range is then an
    interval of numbers, cut into the few blocks of a binary tree that make it up, and a version asks for the block of each
    level it lies in. The join on (package, level, block) so yields each matching pair once and no other. Equal versions of a
    package ask once.
    """
    adv = advisories.withColumnRenamed("package", "_package").filter(F.col("_package").isNotNull())
    ranges = kept(adv.select("*", *_interval(bounds_of(F.col("affected")))), "ranges")
    points = dependencies.select(F.lower("name").alias("_package"), F.col("version").alias("_version")).distinct().withColumn(
        "_key", _version_key(parse_version(F.col("_version")))).filter("_key IS NOT NULL").join(ranges.select("_package").distinct(), "_package", "left_semi")
    points = kept(points, "versions")
    marks = points.select("_package", "_key")
    for limit in ("_low", "_high"):
        marks = marks.unionByName(ranges.filter(F.col(limit).isNotNull()).select("_package", F.col(limit).alias("_key")))
    places = kept(number_rows(marks.distinct(), [F.col("_key")], "_no", ["_package"]), "places")
    most = places.agg(F.max("_no")).first()[0] or 0
    levels = int(most).bit_length()
    known = ranges
    for limit in ("_low", "_high"):
        at = places.select("_package", F.col("_key").alias(limit), F.col("_no").alias(f"{limit}_no"))
        known = known.join(at, ["_package", limit], "left")
    first = F.coalesce(F.col("_low_no") + F.col("_low_open"), F.lit(1)).cast("bigint")
    last = F.coalesce(F.col("_high_no") - F.col("_high_open"), F.lit((1 << levels) - 1)).cast("bigint")
    blocks = known.select(*adv.columns, F.inline(_dyadic(first, last, levels)))
    asking = points.join(places, ["_package", "_key"]).select("_package", "_version", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "_no")
    asking = asking.withColumn("block", F.call_function("shiftright", "_no", "level").cast("bigint")).drop("_no")
    hits = asking.join(blocks, ["_package", "level", "block"]).drop("level", "block")
    out = dependencies.join(hits, (F.lower("name") == F.col("_package")) & (F.col("version") == F.col("_version")))
    return out.withColumn("fixed_version", F.replace("affected", F.lit("<"), F.lit(""))).drop("_package", "_version")


def merge_findings(base: DataFrame, extra: DataFrame, keys=("file_path", "start_line", "cwe_id"),
                   order: str = "rule_no") -> DataFrame:
    """All base findings plus those of other tools whose key the base lacks, one per key.

    Null keys compare equal. Duplicates among the added ones are removed by an aggregate
    before the join, so no key is gathered whole in one task.
    """
    rest = [c for c in extra.columns if c not in keys]
    first = (extra.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f"))
             .select(*keys, "_f.*"))
    seen = base.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return base.unionByName(first.join(seen, same, "left_anti"), allowMissingColumns=True)


def drop_expired(scans: DataFrame, findings: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Scans not older than the cutoff, and the findings of no older scan."""
    old = scans.filter(F.col("ts") < cutoff).select("scan_id")
    return scans.filter(F.col("ts") >= cutoff), findings.join(old, "scan_id", "left_anti")


def changed_files(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose path or content was not in the previous scan.

    ``previous`` holds (path, digest) as written by ``file_digests``.
    """
    return file_digests(files).join(previous.select("path", "digest"), ["path", "digest"], "left_anti")


def file_digests(files: DataFrame) -> DataFrame:
    return files.withColumn("digest", F.sha2(F.col("text"), 256))


def split_overlap(left: DataFrame, right: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows of one split whose fingerprint also occurs in the other."""
    return left.join(right.select(fingerprint).distinct(), fingerprint, "left_semi")
