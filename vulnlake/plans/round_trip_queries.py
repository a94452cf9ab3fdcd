"""Queries that write the derived tables in a format and read them back with the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vulnlake.functions import code as code_fn
from vulnlake.operators import corpus
from vulnlake.plans import tables as t
from vulnlake.plans.corpus_queries import SQL_SPLIT
from vulnlake.plans.registry import query
from vulnlake.plans.scan_queries import SQL_STRIPPED, sql_strip
from vulnlake.plans.tables import read, with_tables
from vulnlake.session import ensure_checkpoint_dir
from vulnlake.sources import corpora, documents, sinks
from vulnlake.streaming import jobs


def _folder(spark, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("s3_json_corpus", with_tables(t.CODE_FILES, body="SELECT text AS code, CAST(file_id % 2 AS VARCHAR) AS label, language FROM code_files"))
def json_corpus(spark, sf):
    """Samples in wrapped lists, one file for each of eight shares of the files."""
    files = t.code_files(spark, sf).select((F.col("file_id") % 8).alias("share"), "file_id", F.to_json(F.struct(
        F.col("text").alias("code"), (F.col("file_id") % 2).cast("string").alias("label"), "language")).alias("item"))
    lines = documents.frame_lines(files.select("share").distinct(), "share", {0: '{"samples":[', 2: "]}"}).unionByName(
        documents.lines(files, "share", 1, F.col("item"), F.col("file_id")))
    folder = _folder(spark, "corpus")
    documents.write_documents(lines, folder)
    return corpora.read_json_corpus(spark, f"{folder}/*.json").select("code", "label", "language")


@query("s4_jsonl_corpus", with_tables(t.CODE_FILES, body=f"""SELECT text AS code, CAST(file_id % 2 AS INTEGER) AS label, 'codexglue' AS source, 'p' || CAST(file_id % 5 AS VARCHAR) AS project
  FROM code_files WHERE file_id % 11 > 0 AND length({sql_strip('text')}) >= 20 AND len({SQL_STRIPPED}) >= 2 AND
  len(list_filter({SQL_STRIPPED}, lambda x: NOT (starts_with(x, 'import') OR starts_with(x, 'from ') OR starts_with(x, '#include') OR starts_with(x, 'using')))) >= 1
  UNION ALL SELECT '{{"func": torn ' || CAST(file_id AS VARCHAR), NULL, 'bad line', NULL FROM code_files WHERE file_id % 11 = 0"""))
def jsonl_corpus(spark, sf):
    """Samples line by line; every eleventh line is torn and comes back as a bad line."""
    i = F.col("file_id")
    good = F.to_json(F.struct(F.col("text").alias("func"), (i % 2).alias("target"), F.concat(F.lit("p"), (i % 5).cast("string")).alias("project")))
    torn = F.concat(F.lit('{"func": torn '), i.cast("string"))
    folder = _folder(spark, "jsonl")
    t.code_files(spark, sf).select(F.when(i % 11 == 0, torn).otherwise(good).alias("value")).write.text(folder)
    samples, bad = corpora.read_jsonl(spark, folder)
    return samples.select("code", "label", "source", F.col("metadata")["project"].alias("project")).unionByName(
        bad.select(F.col("line").alias("code"), F.lit(None).cast("int").alias("label"), F.lit("bad line").alias("source"), F.lit(None).cast("string").alias("project")))


@query("s18_written_splits", f"""SELECT split, count(*) AS samples, count(*) FILTER (doc_id % 2 = 1) AS positive, CAST(sum(doc_id) AS BIGINT) AS ids,
  count(*) AS in_metadata FROM ({SQL_SPLIT}) GROUP BY split""")
def written_splits(spark, sf):
    """Splits written by partition with their totals beside them, both read back."""
    docs = read(spark, sf, "documents").select("doc_id", code_fn.fingerprint(F.col("text")).alias("fingerprint"), (F.col("doc_id") % 2).cast("int").alias("label"))
    folder = _folder(spark, "splits")
    sinks.write_splits(corpus.split_by_hash(docs), folder)
    samples = spark.read.parquet(f"{folder}/samples").groupBy("split").agg(
        F.count("*").alias("samples"), F.sum("label").alias("positive"), F.sum("doc_id").alias("ids"))
    metadata = spark.read.schema("split string, samples bigint").json(f"{folder}/metadata").withColumnRenamed("samples", "in_metadata")
    return samples.join(metadata, "split")


@query("t8_retention_stream", with_tables(t.SCANS, body="SELECT scan_id FROM scans WHERE ts >= (SELECT max(ts) FROM scans) - INTERVAL 365 DAY"))
def retention_stream(spark, sf):
    """The scans that are left when the stream has pruned what is older than a year before its newest one."""
    scans = t.scans(spark, sf).select("scan_id", "ts")
    folder = _folder(spark, "retention")
    scans.write.parquet(f"{folder}/in")
    newest = []
    jobs.retention_stream(spark.readStream.schema(scans.schema).parquet(f"{folder}/in"), f"{folder}/state", newest.append).awaitTermination()
    return scans.filter(F.col("ts") >= F.lit(max(newest)) - F.expr("INTERVAL 365 DAYS")).select("scan_id")
