"""The corpus pipeline: documents in, the training mix out.

Each stage works on all that its predecessor kept and returns the columns of documents; the last one repeats documents, one
row per copy, with the figures of the mix. Stages are written as Parquet and read again, so each starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from vulnlake.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the label table, does not call toxic."""
    scored = toxicity.score_texts(docs, toxicity.learnt(spark, sf_dir, docs))
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, too, exactly or nearly; those of which nothing is left go."""
    thinned = line_dedup.drop_repeated_lines(docs, least_exact=1).filter("NOT emptied")
    if "n_chars" in docs.columns:
        thinned = thinned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return thinned.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles of a Jaccard similarity of 0.8 or more join, the one with the smallest id."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question of the benchmark, verbatim or with other values."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins every source towards its weight; one row per copy."""
    return mixing.mix_sources(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("drop_repeated_lines", drop_repeated_lines),
    ("keep_one_of_near_copies", keep_one_of_near_copies),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("mix_to_weights", mix_to_weights),
]

#: The stages train a classifier and follow chains of near copies, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), name)
