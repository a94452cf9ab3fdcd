"""Benchmark decontamination by templates.

Numbers, units after them and names inside sentences become typed placeholders; case and punctuation go. Windows of template
words are hashed and looked up among the benchmark's windows, so a question is found verbatim and with other values put in.
Windows of one item on one diagonal (same shift between item and document) are an alignment. Along it every value of a slot
has to be replaced by one value throughout; alignments that fail this are no match. An item leaks into a document when the
windows of its good alignments cover a given share of the item's windows, or ``least_run`` consecutive words of it.

Null texts have no words. Windows that are mostly placeholders and signs identify nothing as templates and are looked up word for
word instead, but for case. Items shorter than a window are looked for by a window of their own length, those with fewer than
``least_words`` words not at all. Equal rows of the documents (same id and text) get equal results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.bitmaps import bitmap
from vulnlake.llm.common import SPACE, table, without, written

WINDOW = 8
BROADCAST_WINDOWS = 300_000
#: Units that may follow a number.
UNITS = ("mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hour hours day days week weeks month months year years "
         "percent usd eur dollar dollars euro euros cent cents mph kmh w kw v hz mb gb tb").split()
_MARKS = r"""!"#$%&'()*+,-./:;=?@[\]^_`{|}~"""


def spaced(text: Column) -> Column:
    """The text with single spaces between words and none at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def template(plain: Column) -> Column:
    """Word for word the template of a text from `spaced`; words of punctuation alone become empty."""
    named = F.regexp_replace(plain, r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}++(?![\p{L}])", "<name>")
    numbered = F.when(named.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(
        named, r"[0-9]++(?:[.,:/][0-9]++)*+", "<num>"), rf"(?i)(?<=<num> ?)(?:{'|'.join(UNITS)}|[%€$£°])(?![\p{{L}}\p{{N}}])", "<unit>")).otherwise(named)
    return F.translate(F.lower(numbered), _MARKS, "")


def _hash(form: Column, raw: Column) -> Column:
    """Of a window's template if at least half of its words are fixed ones, else of the words themselves."""
    fixed = F.aggregate(form, F.lit(0), lambda n, w: n + F.when(w.startswith("<") | (w == ""), 0).otherwise(1))
    return F.when(2 * fixed >= F.size(form), F.xxhash64(form)).otherwise(F.xxhash64(F.lit("words"), F.transform(raw, F.lower)))


def _start(hashes: Column, at: Column, words: int) -> Column:
    """A hash of the first words of a window from the hashes of single words."""
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(words)])


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _known_starts(known: DataFrame, words: int) -> Callable[[Column], Column]:
    """Whether a window from place ``at`` of a text with ``_fh`` and ``_rh`` may be known; it is hashed whole only then.

    Templates begin like known templates, windows looked up word for word like those, of which there may be none.
    """
    tests = []
    for kind, column, own in ((F.col("h") == F.xxhash64("form"), F.col("form"), "_fh"), (F.col("h") != F.xxhash64("form"), F.transform("raw", F.lower), "_rh")):
        starts = known.filter(kind).select(_start(_hashes(column), F.lit(0), words).alias("start")).distinct()
        count = starts.count()
        if count:
            tests.append((bitmap(starts, count), own))
    return lambda at: reduce(lambda p, q: p | q, [test(_start(F.col(own), at - 1, words)) for test, own in tests])


def _windows(length: int, may_be_known: Callable[[Column], Column] | None) -> Column:
    """(length, at, h) of all windows of a length that may be known, ``at`` counted from 1."""
    places = F.sequence(F.lit(1), F.size("_form") - (length - 1))
    places = places if may_be_known is None else F.filter(places, may_be_known)
    return F.when(F.size("_form") >= length, F.transform(places, lambda i: F.struct(
        F.lit(length).alias("length"), i.alias("at"), _hash(F.slice("_form", i, length), F.slice("_raw", i, length)).alias("h")))).otherwise(
        F.array().cast("array<struct<length:int,at:int,h:bigint>>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, least_words: int = 3, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, length, item_id, pos, n_windows, form, raw): the windows of distinct items."""
    plain = spaced(F.col(text))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.split(plain, " ").alias("_raw"), F.split(template(plain), " ").alias("_form"))
    items = items.distinct().filter(F.size("_form") >= least_words).withColumn("length", F.least(F.lit(window), F.size("_form")))
    at = F.explode(F.sequence(F.lit(1), F.size("_form") - F.col("length") + 1))
    rows = items.select("item_id", "length", "_raw", "_form", at.alias("pos")).select(
        "item_id", "length", "pos", F.slice("_form", F.col("pos"), F.col("length")).alias("form"), F.slice("_raw", F.col("pos"), F.col("length")).alias("raw"))
    counts = rows.groupBy("item_id").agg(F.countDistinct("pos").alias("n_windows"))
    return rows.withColumn("h", _hash(F.col("form"), F.col("raw"))).join(counts, "item_id").select("h", "length", "item_id", "pos", "n_windows", "form", "raw")


def _longest(places: Column) -> Column:
    """The most consecutive numbers in a sorted array."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state, place):
        run = F.when(place == state["last"] + 1, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(place.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(places, start, step, lambda state: state["most"])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.3, least_run: int = 13, window: int = WINDOW, doc_id: str = "doc_id",
          text: str = "text", **options) -> DataFrame:
    """(doc_id, _text, item_id, covered, changed, start, end): items of which a document covers a share ``coverage`` or a run of words.

    ``covered`` is the share of the item's windows, ``changed`` tells that a slot holds another value than the item's, and
    ``start`` and ``end`` are the first and last word of the passage in the document. ``_text`` is a hash of the text.
    """
    known = written(benchmark_windows(benchmark, window, **options), "windows")
    lengths = [r["length"] for r in known.select("length").distinct().collect()]  # window lengths up to `window`
    plain = spaced(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
                       F.split(plain, " ").alias("_raw"), F.split(template(plain), " ").alias("_form"))
    if not lengths:
        return rows.limit(0).select("doc_id", "_text", F.lit(None).cast("bigint").alias("item_id"), F.lit(0.0).alias("covered"),
                                    F.lit(False).alias("changed"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    small = known.count() <= BROADCAST_WINDOWS
    rows = rows.withColumn("_fh", _hashes(F.col("_form"))).withColumn("_rh", _hashes(F.split(F.lower(F.array_join("_raw", " ")), " ")))
    may_be_known = _known_starts(known, min(3, *lengths)) if small else None
    seen = rows.select("doc_id", "_text", "_raw", F.inline(F.concat(*[_windows(length, may_be_known) for length in sorted(lengths)])))
    found = seen.join(F.broadcast(known) if small else known, ["h", "length"])
    hits = found.select("doc_id", "_text", "item_id", "pos", "n_windows", "form", "raw", "length", (F.col("at") - F.col("pos")).alias("shift"),
                        F.slice("_raw", F.col("at"), F.col("length")).alias("here"))
    bare = lambda w: F.translate(w, _MARKS, "")
    slots = F.filter(F.zip_with("form", F.arrays_zip("raw", "here"), lambda w, p: F.when(
        w.startswith("<"), F.struct(bare(p["raw"]).alias("item"), bare(p["here"]).alias("doc")))), lambda s: s.isNotNull())
    aligned = (hits.withColumn("_slots", slots).groupBy("doc_id", "_text", "item_id", "shift").agg(
        F.sort_array(F.collect_set("pos")).alias("_pos"), F.array_distinct(F.flatten(F.collect_set("_slots"))).alias("_slots"),
        F.first("n_windows").alias("n_windows"), F.min(F.col("pos") + F.col("shift")).alias("start"),
        F.max(F.col("pos") + F.col("shift") + F.col("length") - 1).alias("end"), F.first("length").alias("length"))
        .withColumn("_run", _longest(F.col("_pos")) + F.col("length") - 1).filter(F.size("_slots") == F.size(F.array_distinct(F.transform("_slots", lambda s: s["item"])))))
    changed = F.exists("_slots", lambda s: s["item"] != s["doc"])
    return (aligned.groupBy("doc_id", "_text", "item_id").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("_pos")))) / F.first("n_windows")).alias("covered"),
        F.max(changed).alias("changed"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("_run").alias("_run"))
        .filter((F.col("covered") >= coverage) | (F.col("_run") >= least_run)).drop("_run"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents into which no item leaks."""
    found = leaks(docs, benchmark, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).distinct()
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_t")), "left_anti")


def flag_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with contaminated, n_items, items (ids, sorted), covered (the most) and changed."""
    found = leaks(docs, benchmark, doc_id=doc_id, text=text, **options)
    per_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("covered").alias("covered"), F.max("changed").alias("changed"))
    rows = without(docs, ["contaminated", "n_items", "items", "covered", "changed", "_h"])
    rows = rows.withColumn("_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(per_doc, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")
    return joined.withColumn("contaminated", F.col("items").isNotNull()).withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)).cast("bigint")).drop(
        "_id", "_t", "_h")


def op6_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return flag_leaks(docs, table(spark, folder, "benchmark")).select(
        "doc_id", "contaminated", F.when(F.col("contaminated"), F.col("n_items")).otherwise(F.lit(0)).cast("bigint").alias("n_items"),
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "covered", "changed")
