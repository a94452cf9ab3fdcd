"""Versions, ranges, dependency lines and licenses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.dimensions import LICENSE_CLASSES
from vulnlake.functions.text import contains_any, strip


def parse_version(version: Column) -> Column:
    """Numbers of a version as an array; arrays compare element by element, shorter first."""
    clean = F.regexp_replace(version, r"^[~^>=<]+", "")
    parts = F.filter(F.split(clean, "[.a-zA-Z]+"), lambda p: p.rlike("^[0-9]+$"))
    return F.transform(parts, lambda p: p.cast("bigint"))


def bounds_of(affected: Column) -> Column:
    """array<struct(op, numbers)> of a comma-separated range; a bare version means equality."""
    def bound(text):
        text = strip(text)
        return F.struct(F.regexp_extract(text, "^([<>]=?)?", 1).alias("op"), parse_version(text).alias("numbers"))

    return F.transform(F.split(affected, ","), bound)


def within_bounds(current: Column, bounds: Column) -> Column:
    """Whether a parsed version meets every bound."""
    def met(bound):
        op, limit = bound["op"], bound["numbers"]
        return (F.when(op == "<", current < limit).when(op == "<=", current <= limit)
                .when(op == ">", current > limit).when(op == ">=", current >= limit).otherwise(current == limit))

    return F.forall(bounds, met)


def in_range(current: Column, affected: Column) -> Column:
    return within_bounds(current, bounds_of(affected))


# Shapes of a dependency line.
PINNED = r"^([a-zA-Z0-9_-]+)\s*([=<>!~]+)\s*([0-9a-zA-Z._-]+)"
BARE = r"^[a-zA-Z0-9_-]+$"


def requirement(line: Column) -> Column:
    """struct(name, version) of a requirements line; null for comments, options and other shapes."""
    text = strip(line)
    skipped = (text == "") | text.startswith("#") | text.startswith("-")
    pinned = F.struct(F.lower(F.regexp_extract(text, PINNED, 1)).alias("name"),
                      F.regexp_extract(text, PINNED, 3).alias("version"))
    bare = F.struct(F.lower(text).alias("name"), F.lit("*").alias("version"))
    return F.when(skipped, None).when(text.rlike(PINNED), pinned).when(text.rlike(BARE), bare)


def package_entries(manifest: Column) -> Column:
    """array<struct(name, version)> of a package manifest; dev entries override, bad JSON gives none."""
    shape = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = F.from_json(manifest, shape)
    none = F.create_map().cast("map<string,string>")
    main = F.coalesce(parsed["dependencies"], none)
    dev = F.coalesce(parsed["devDependencies"], none)
    kept = F.map_filter(main, lambda k, v: ~F.map_contains_key(dev, k))
    return F.transform(
        F.concat(F.map_entries(kept), F.map_entries(dev)),
        lambda e: F.struct(F.lower(e["key"]).alias("name"),
                           F.regexp_replace(e["value"], r"^[~^>=<]+", "").alias("version")))


def license_class(text: Column) -> Column:
    """permissive, copyleft, restrictive or unknown; the first class with a contained name wins."""
    upper = F.upper(text)
    cases = None
    for name, licenses in LICENSE_CLASSES.items():
        test = contains_any(upper, [item.upper() for item in licenses])
        cases = F.when(test, name) if cases is None else cases.when(test, name)
    return cases.otherwise("unknown")


def package_url(name: Column, version: Column, ecosystem: str = "python") -> Column:
    kind = "pypi" if ecosystem == "python" else "npm"
    return F.concat(F.lit(f"pkg:{kind}/"), name, F.lit("@"), version)
