"""Windows are hashed whole only where they begin like a known one."""

from pyspark.sql import functions as F

from vulnlake.llm import decontaminate


def test_few_windows_are_hashed_whole(spark):
    """Both kinds of windows, templates and those looked up word for word, are let through; windows of other texts are not."""
    items = ["what is the sum of all the odd numbers under ninety", "12 + 34 = 46 , 5 * 6 = Thirty"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    other = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    docs = spark.createDataFrame([(i, f"{other} {t.upper() if i else t} {other}") for i, t in enumerate(items)], "doc_id bigint, text string")
    known = decontaminate.benchmark_windows(benchmark)
    assert known.filter(F.col("h") == F.xxhash64("form")).count() and known.filter(F.col("h") != F.xxhash64("form")).count()
    found = decontaminate.leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 0), (1, 1)}
    plain = decontaminate.spaced(F.col("text"))
    rows = docs.select(F.split(plain, " ").alias("_raw"), F.split(decontaminate.template(plain), " ").alias("_form"))
    rows = rows.select("*", decontaminate._hashes(F.col("_form")).alias("_fh"), decontaminate._hashes(F.transform("_raw", F.lower)).alias("_rh"))
    assert rows.select(F.explode(decontaminate._windows(8, decontaminate._known_starts(known, 3)))).count() < 40
