"""URL filters: stated rules first, then path templates learnt per host.

Paths become templates segment by segment: typed wildcards for numbers, hashes and dates, then, level by level, a plain
wildcard for every segment that is too rare below its node to be a fixed word of the site. Branches of a node whose share of
bad pages does not differ significantly are merged. A template is rejected when its share of bad pages among the labelled
ones, smoothed towards the host's and that towards the overall share, is high. Everything is DataFrame operations on counts
of shapes; a segment kept below a node holds a fixed share of its pages, so a node has a bounded number of branches.

A null url or one without ``://`` has an empty host and path, and so is judged as the template of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.llm.common import forget, lower_ascii, table, without, written

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a rule fits its host, all subdomains, and paths that start with its own."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=False):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path with numbers, dates, hashes and identifiers as typed wildcards."""
    for pattern, name in ((r"(?<=[/_.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[/_.-]|$)", "<date>"),
                          (r"(?i)(?<=/)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?=[/.]|$)", "<uuid>"),
                          (r"(?<=[/_.-])[0-9]+(?=[/_.-]|$)", "<n>"),
                          (r"(?<=/)(?=[a-z]*[0-9])[0-9a-z]{12,}(?=[/.]|$)", "<id>")):
        path = F.regexp_replace(path, pattern, name)
    return path


def templates(labelled: DataFrame, depth: int = 6, least: int = 5, share: float = 0.02, z: float = 1.96, strength: float = 4.0) -> DataFrame:
    """(host, shape, template, n, n_labelled, n_bad, purity) from (host, shape, bad), bad being 1, 0 or null.

    ``depth`` levels are told apart, what is below is one wildcard. A segment stays if at least ``least`` pages and the given
    share of its node's pages have it. ``purity`` is the smoothed share of bad pages; ``strength`` labelled pages weigh as much
    as what it is smoothed towards.
    """
    counts = [F.sum(c).alias(c) for c in ("n", "n_labelled", "n_bad")]
    shapes = labelled.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    level = written(shapes.withColumn("_s", F.split("shape", "/")).withColumn("_node", F.lit("")), "shapes")
    plain = level
    for i in range(1, depth + 1):
        part = F.get("_s", F.lit(i)) if i < depth else F.when(F.size("_s") > depth, F.lit("**"))
        level = plain.withColumn("_part", part)
        # A node's totals ride along with the counts of its segments.
        segments = written(level.filter("_part IS NOT NULL").groupBy("host", "_node", "_part").agg(*counts), "segments")
        nodes = segments.groupBy("host", "_node").agg(F.sum("n").alias("_total"))
        typed = F.col("_part").rlike("<(date|uuid|n|id)>|^$|^[*][*]$")
        kept = segments.join(nodes, ["host", "_node"]).withColumn("_name", F.when(
            typed | ((F.col("n") >= least) & (F.col("n") >= share * F.col("_total"))), F.col("_part")).otherwise("*"))
        names = _merged(kept.groupBy("host", "_node", "_name").agg(*counts), z)
        chosen = kept.select("host", "_node", "_part", "_name").join(names, ["host", "_node", "_name"]).select(
            "host", "_node", "_part", "_branch")
        deeper = written(level.join(chosen, ["host", "_node", "_part"], "left").withColumn("_node", F.when(
            F.col("_part").isNull(), F.col("_node")).otherwise(F.concat("_node", F.lit("/"), "_branch"))).drop("_branch", "_part"), "shapes")
        forget(plain, segments)
        plain = level = deeper
    leaves = level.select("host", "shape", F.col("_node").alias("template"), "n", "n_labelled", "n_bad")
    by_template = leaves.groupBy("host", "template").agg(*counts)
    hosts = by_template.groupBy("host").agg(F.sum("n_labelled").alias("_hl"), F.sum("n_bad").alias("_hb"))
    overall = hosts.agg(F.sum("_hl").alias("_al"), F.sum("_hb").alias("_ab"))
    base = (F.coalesce("_ab", F.lit(0)) + 1) / (F.coalesce("_al", F.lit(0)) + 2)
    rated = by_template.join(hosts, "host").join(F.broadcast(overall)).withColumn(
        "_host", (F.col("_hb") + strength * base) / (F.col("_hl") + strength)).withColumn(
        "purity", (F.col("n_bad") + strength * F.col("_host")) / (F.col("n_labelled") + strength))
    rated = rated.select("host", "template", "n", "n_labelled", "n_bad", "purity")
    return leaves.select("host", "shape", "template").join(rated, ["host", "template"])


def _merged(branches: DataFrame, z: float) -> DataFrame:
    """(host, _node, _name, _branch): fixed branches of a node, sorted by their share of bad pages, are merged with the one
    before as long as a two-proportion test does not tell them apart. Typed wildcards stay by themselves."""
    fixed = ~F.col("_name").rlike("<(date|uuid|n|id)>|^$|^[*]+$") & (F.col("n_labelled") > 0)
    order = Window.partitionBy("host", "_node", "_fixed").orderBy("_rate", "_name")
    rate = (F.col("n_bad") + 0.5) / (F.col("n_labelled") + 1)
    rows = branches.withColumn("_fixed", fixed).withColumn("_rate", rate)
    rows = rows.withColumn("_b", F.lag("n_bad").over(order)).withColumn("_l", F.lag("n_labelled").over(order))
    both = (F.col("n_bad") + F.col("_b") + 1) / (F.col("n_labelled") + F.col("_l") + 2)
    spread = F.sqrt(both * (1 - both) * (1 / F.col("n_labelled") + 1 / F.col("_l")))
    apart = ~F.col("_fixed") | F.col("_l").isNull() | (F.abs(F.col("_rate") - (F.col("_b") + 0.5) / (F.col("_l") + 1)) > z * spread)
    rows = rows.withColumn("_group", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "_node", "_fixed", "_group").orderBy("_name").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    members = F.collect_list("_name").over(group)
    return rows.select("host", "_node", "_name", F.when(F.size(members) > 1, F.concat(
        F.lit("{"), F.array_join(members, "|"), F.lit("}"))).otherwise(F.col("_name")).alias("_branch"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None, threshold: float = 0.8,
               least_labels: int = 5, url: str = "url", **options) -> DataFrame:
    """The pages with host, path, rule, verdict, template and purity.

    ``label`` names a column that is 1 for bad pages, 0 for good ones and null for unknown; where it is null or not given, the
    verdict of a rule labels its pages. A page without a rule is blocked if its template has at least ``least_labels`` labelled
    pages and a purity of at least ``threshold``. Columns of the input that bear a result's name give way to it.
    """
    rows = without(pages, ["host", "path", "rule", "verdict", "template", "purity", "shape", "_bad", "_said"])
    rows = rows.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_said", said).withColumn("shape", shape_of(F.col("path")))
    bad = F.when(F.col("_said") == "block", 1).when(F.col("_said") == "allow", 0)
    rows = rows.withColumn("_bad", F.coalesce(F.col(label).cast("int"), bad) if label else bad)
    learnt = templates(rows.select("host", "shape", F.col("_bad").alias("bad")), **options).select(
        "host", "shape", "template", "purity", (F.col("n_labelled") >= least_labels).alias("_known"))
    method = F.when(F.col("_known") & (F.col("purity") >= threshold), "block").otherwise("allow")
    return rows.join(learnt, ["host", "shape"], "left").withColumn("verdict", F.coalesce("_said", method)).drop(
        "_said", "_bad", "_known", "shape")


def op1_url_filter(spark, folder):
    return judge_urls(table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity")
