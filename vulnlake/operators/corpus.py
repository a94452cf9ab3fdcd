"""Labelled samples: harmonising, filtering, duplicates, splits, vocabulary, encoding, statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.functions.code import normalize_identifiers, without_comments
from vulnlake.functions.severity import mapped
from vulnlake.functions.text import contains_any
from vulnlake.operators.filters import CONTENT_LANGUAGE_SHORT, language_by_content, length_within
from vulnlake.operators.lookups import with_cwe_group
from vulnlake.operators.scale import cap_per_group, first_per_group, hash_of, is_bounded, number_rows, shuffled_rank

# Language of a file extension in fix records; heuristics for weak labels.
FIX_EXTENSIONS = {"js": "javascript", "py": "python", "c": "c", "cpp": "cpp", "java": "java", "jsx": "javascript"}
WEAK_DEFAULT_GROUP = "A05"
SPLIT_SHARES = (("train", 0.7), ("val", 0.15), ("test", 0.15))
READY_SAMPLES = 3000
UNSAFE_LABEL, SAFE_LABEL = 1, 0


def union_samples(*frames: DataFrame) -> DataFrame:
    """Union of corpora with differing columns; what a corpus lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def binary_label(label: Column, vuln_type: Column, vulnerabilities: Column, vulnerable: Column) -> Column:
    """0/1 from mixed schemas: label, then type, then the list, then the flag."""
    return (F.when(label.isNotNull(), F.coalesce(label.cast("string").try_cast("double"), F.lit(0.0)))
            .when(F.trim(vuln_type) != "", F.when(F.lower(vuln_type) == "none", 0.0).otherwise(1.0))
            .when(vulnerabilities.isNotNull(), (F.size(vulnerabilities) > 0).cast("double"))
            .otherwise(F.coalesce(vulnerable, F.lit(False)).cast("double")))


def fix_pairs(fixes: DataFrame, source: str, before: str = "func_before", after: str = "func_after",
              kind: Column | None = None, language: Column | None = None) -> DataFrame:
    """Two samples per fix: the text before (label 1) and after (label 0), each above 20 characters."""
    kept = [c for c in fixes.columns if c not in (before, after)]
    kind = F.coalesce(kind if kind is not None else F.col("cwe_id"), F.lit("unknown"))
    if language is None:
        language = mapped(F.lower(F.coalesce("extension", F.lit("js"))), FIX_EXTENSIONS, "javascript")
    pair = F.array(
        F.struct(F.col(before).alias("code"), F.lit(UNSAFE_LABEL).alias("label"), kind.alias("vulnerability_type"),
                 F.lit(False).alias("is_fixed_version")),
        F.struct(F.col(after).alias("code"), F.lit(SAFE_LABEL).alias("label"), F.lit("none").alias("vulnerability_type"),
                 F.lit(True).alias("is_fixed_version")))
    rows = fixes.select(*kept, language.alias("language"), F.lit(source).alias("source"), F.inline(pair))
    return rows.filter(F.char_length("code") > 20)


def weak_labels(files: DataFrame) -> DataFrame:
    """Labels by three ordered heuristics; rows whose CWE belongs to no group drop out.

    Wants ``text``; only texts of the production length are kept.
    """
    text = F.col("text")
    cwe = (F.when(contains_any(text, ("eval(", "exec(")), 95)
           .when(text.rlike(r"(?i)password\s*=\s*[\"']"), 798)
           .when(contains_any(text, ("hashlib.md5", "hashlib.sha1")), 327).otherwise(0))
    rows = files.filter(length_within(text, "production")).withColumn("cwe_id", cwe)
    grouped = with_cwe_group(rows, keep_unmapped=True)
    group = F.when(F.col("cwe_id") == 0, F.lit(WEAK_DEFAULT_GROUP)).otherwise(F.col("owasp_category"))
    return (grouped.withColumn("owasp_category", group).filter(F.col("owasp_category").isNotNull())
            .withColumn("is_vulnerable", F.col("cwe_id") != 0))


def labelled_functions(rows: DataFrame, max_samples: int | None = None, order: str | None = None) -> DataFrame:
    """Rows with code and target, of usable length and known language, with CWE group and default."""
    kept = rows.filter(F.col("target").isNotNull() & F.col("code").isNotNull() & length_within(F.col("code"), "csv"))
    kept = kept.withColumn("language", language_by_content(F.col("code"), CONTENT_LANGUAGE_SHORT)).filter(F.col("language") != "unknown")
    kept = kept.withColumn("cwe_id", F.coalesce(F.col("cwe_id").cast("int"), F.lit(0)))
    out = with_cwe_group(kept, default="A05").withColumn("is_vulnerable", F.col("target").cast("int") != 0)
    return out.orderBy(order).limit(max_samples) if max_samples else out


def prepare(samples: DataFrame) -> DataFrame:
    """Comments and blank lines out, length limits, identifiers normalised."""
    cleaned = samples.withColumn("code", without_comments(F.col("code"), F.col("language")))
    return cleaned.filter(length_within(F.col("code"), "cleaned")).withColumn("code", normalize_identifiers(F.col("code")))


def first_of_prefix(samples: DataFrame, order: str, length: int = 200, code: str = "code") -> DataFrame:
    """The first sample per prefix of its text (the prefix itself is compared, not a hash)."""
    keyed = samples.withColumn("_prefix", F.substring(code, 1, length))
    return first_per_group(keyed, ["_prefix"], F.col(order)).drop("_prefix")


def distinct_texts(samples: DataFrame, order: str, code: str = "code") -> DataFrame:
    """The first sample of each distinct text. The digest, not the text, is shuffled as key."""
    keyed = samples.withColumn("_digest", F.sha2(F.col(code), 256))
    return first_per_group(keyed, ["_digest"], F.col(order)).drop("_digest")


# --------------------------------------------------------------------- splits


def split_by_hash(samples: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Split by a hash of the fingerprint: no shuffle, and equal texts stay in one split."""
    place = F.pmod(hash_of(F.col(key)), F.lit(10000))
    return samples.withColumn("split", F.when(place < 7000, "train").when(place < 8500, "val").otherwise("test"))


def split_by_rank(samples: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Exact 70/15/15 split of a reproducible shuffle; sizes of the first two are cut down to integers."""
    ranked = shuffled_rank(samples, key, "_rank", seed)
    train, val = F.floor(F.col("_total") * 0.7), F.floor(F.col("_total") * 0.15)
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rank", "_total")


def split_in_order(samples: DataFrame, order: list[str]) -> DataFrame:
    """Exact 70/15/15 split in the given order."""
    total = samples.agg(F.count("*")).scalar()
    ranked = number_rows(samples, [F.col(c) for c in order], "_rank")
    train, val = F.floor(total * 0.7), F.floor(total * 0.15)
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rank")


def shuffle_samples(samples: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return samples.orderBy(hash_of(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key)


def cap_per_source(samples: DataFrame, limit: int, order: str, source: str = "source") -> DataFrame:
    return cap_per_group(samples, source, limit, [order])


# ----------------------------------------------------------------- vocabulary

SPECIALS_A = ("<PAD>", "<UNK>", "<START>", "<END>")
SPECIALS_B = ("<PAD>", "<UNK>", "<BOS>", "<EOS>")


def token_counts(samples: DataFrame, tokens: Column) -> DataFrame:
    return samples.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count"))


def vocabulary(samples: DataFrame, tokens: Column, size: int = 10000, specials=SPECIALS_A) -> DataFrame:
    """(token, count, token_id): the most frequent tokens after the specials, ties by token.

    Only the top ``size`` rows are numbered, so that step is small whatever the input.
    """
    room = size - len(specials)
    top = (token_counts(samples, tokens).filter(~F.col("token").isin(*specials))
           .orderBy(F.desc("count"), "token").limit(room))
    place = F.row_number().over(Window.orderBy(F.desc("count"), "token"))
    return top.withColumn("token_id", place + len(specials) - 1)


def full_vocabulary(samples: DataFrame, tokens: Column) -> DataFrame:
    """All distinct tokens in order, numbered from 2 (0 and 1 stand for padding and unknown)."""
    distinct = samples.select(F.explode(tokens).alias("token")).distinct()
    return number_rows(distinct, [F.col("token")], "_n").select("token", (F.col("_n") + 1).alias("token_id"))


def _looked_up(lists: Column, keys: pa.Array, values: pa.Array, default, kind: str) -> Column:
    """Each element's value of a small table, or the default; elements stay in their list, so nothing is shuffled."""
    @F.arrow_udf(f"array<{kind}>")
    def found(batch: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))
        places = pc.index_in(batch.flatten(), value_set=keys)
        given = pc.take(values, pc.fill_null(places, 0)) if len(values) else pa.nulls(len(places), values.type)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pc.if_else(pc.is_valid(places), given, pa.scalar(default, values.type)))

    return found(lists)


def _vocabulary_arrays(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    rows = vocab.select("token", F.col("token_id").cast("int")).toArrow()
    return rows.column("token").combine_chunks(), rows.column("token_id").combine_chunks()


def encode(samples: DataFrame, tokens: Column, vocab: DataFrame, key: str, max_length: int = 512,
           keep_end: bool = False, pad: bool = True) -> DataFrame:
    """(key, ids, mask): start mark, token ids (unknown 1), end mark, cut and padded.

    With ``keep_end`` the end mark survives the cut. Tokens beyond the cut are dropped before
    the lookup. In a vocabulary of limited size the tokens of a text are looked up where they are; any other is joined as
    Spark sees fit.
    """
    n = F.size("_t")
    marked = F.concat(F.array(F.lit(2)), F.col("_ids"), F.array(F.lit(3)))
    whole = samples.select(key, tokens.alias("_t"))
    if is_bounded(vocab):
        words, numbers = _vocabulary_arrays(vocab)
        ids = whole.select(key, n.alias("_n"), _looked_up(F.slice("_t", 1, max_length), words, numbers, 1, "int").alias("_ids"))
    else:
        cut = whole.select(key, n.alias("_n"), F.posexplode_outer(F.slice("_t", 1, max_length)).alias("_p", "token"))
        known = cut.join(vocab.select("token", F.col("token_id").cast("int")), "token", "left")
        ids = known.groupBy(key, "_n").agg(F.array_sort(F.collect_list(
            F.when(F.col("_p").isNotNull(), F.struct("_p", F.coalesce("token_id", F.lit(1)).alias("id"))))).alias("_s"))
        ids = ids.select(key, "_n", F.transform("_s", lambda s: s["id"]).alias("_ids"))
    full = F.slice(marked, 1, max_length)
    if keep_end:
        full = F.when(F.col("_n") + 2 > max_length,
                      F.concat(F.slice(marked, 1, max_length - 1), F.array(F.lit(3)))).otherwise(marked)
    ids = ids.select(key, full.alias("ids"))
    if not pad:
        return ids
    gap = F.lit(max_length) - F.size("ids")
    return ids.select(key, F.concat("ids", F.array_repeat(F.lit(0), gap)).alias("ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), gap)).alias("mask"))


def decode(encoded: DataFrame, vocab: DataFrame, key: str, specials=SPECIALS_B,
           dropped=("<PAD>", "<BOS>", "<EOS>")) -> DataFrame:
    """(key, text): tokens of the ids joined by spaces, without the dropped specials."""
    left_out = [i for i, s in enumerate(specials) if s in dropped]
    if is_bounded(vocab):
        words, numbers = _vocabulary_arrays(vocab)
        names = {**dict(zip(numbers.to_pylist(), words.to_pylist())), **dict(enumerate(specials))}
        values = pa.array([None if w in dropped else w for w in names.values()], pa.string())
        ids = F.filter("ids", lambda i: ~i.isin(*left_out)) if left_out else F.col("ids")
        found = _looked_up(ids, pa.array(list(names), pa.int32()), values, "<UNK>", "string")
        return encoded.select(key, found.alias("_w")).filter(F.exists("_w", lambda w: w.isNotNull())).select(key, F.array_join("_w", " ").alias("text"))
    names = F.array(*[F.lit(s) for s in specials])
    rows = encoded.select(key, F.posexplode("ids").alias("_p", "token_id"))
    joined = rows.join(vocab.select("token", F.col("token_id").cast("int")), "token_id", "left")
    token = F.coalesce(F.when(F.col("token_id") < len(specials), F.get(names, F.col("token_id"))), "token", F.lit("<UNK>"))
    kept = joined.withColumn("_w", token).filter(~F.col("_w").isin(*dropped))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("_p", "_w"))), lambda s: s["_w"]), " ").alias("text"))


# ----------------------------------------------------------------- statistics


def label_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by label with percent and whether the classes are balanced within a tenth."""
    vulnerable, total = F.col("vulnerable"), F.col("total")
    counted = samples.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("vulnerable"))
    return counted.select(
        *keys, "total", "vulnerable", (total - vulnerable).alias("safe"),
        (vulnerable * 100 / total).alias("vulnerable_percent"), ((total - vulnerable) * 100 / total).alias("safe_percent"),
        (F.abs(vulnerable - (total - vulnerable)) / total < 0.1).alias("balanced"))


def share_by(samples: DataFrame, column: str) -> DataFrame:
    """Count and percent of all rows per value."""
    counts = samples.groupBy(F.coalesce(column, F.lit("Unknown")).alias(column)).agg(F.count("*").alias("count"))
    total = samples.agg(F.count("*")).scalar()
    return counts.select(column, "count", (F.col("count") * 100 / total).alias("percent"))


def top_types_of_vulnerable(samples: DataFrame, limit: int = 5) -> DataFrame:
    kind = F.when(F.col("vulnerability_type") != "", F.col("vulnerability_type"))
    bad = samples.filter(F.col("label") == 1).withColumn("vulnerability_type", F.coalesce(kind, F.lit("Unknown")))
    return share_by(bad, "vulnerability_type").orderBy(F.desc("count"), "vulnerability_type").limit(limit)


def category_distribution(samples: DataFrame, column: str = "owasp_category") -> DataFrame:
    return samples.groupBy(column).agg(F.count("*").alias("count")).orderBy(column)


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: all / (classes * rows of the class)."""
    counts = samples.groupBy(label).agg(F.count("*").alias("count"))
    rows, classes = samples.agg(F.count(label)).scalar(), samples.agg(F.count_distinct(label)).scalar()
    return counts.select(label, "count", (rows / (classes * F.col("count"))).alias("weight"))


def with_class_weight(samples: DataFrame, label: str = "label") -> DataFrame:
    """Adds the balanced weight of each sample of a binary corpus, without a join."""
    total, positive = samples.agg(F.count(label)).scalar(), samples.agg(F.count_if(F.col(label) == 1)).scalar()
    weight = F.when(F.col(label) == 1, total / (2 * positive)).otherwise(total / (2 * (total - positive)))
    return samples.withColumn("weight", weight)


def positive_weight(samples: DataFrame, label: str = "label") -> DataFrame:
    """safe / vulnerable where safe samples prevail, else null."""
    counts = samples.agg(F.count_if(F.col(label) == 1).alias("vulnerable"), F.count_if(F.col(label) != 1).alias("safe"))
    return counts.withColumn("pos_weight", F.when(
        (F.col("safe") > F.col("vulnerable")) & (F.col("vulnerable") > 0), F.col("safe") / F.col("vulnerable")))


def split_readiness(samples: DataFrame, least: int = READY_SAMPLES) -> DataFrame:
    """Samples and share per split, and whether the whole set is large enough."""
    return share_by(samples, "split").withColumn("ready", samples.agg(F.count("*") >= least).scalar())
