"""Bitmaps of hashes: no known hash is lost, and few others pass on to the lookups."""

from pyspark.sql import functions as F

from vulnlake.functions.bitmaps import bitmap
from vulnlake.operators import grams


def test_bitmap_holds_what_it_was_made_of(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    test = bitmap(hashes, 3000)
    rows = spark.range(30000).select("id", test(F.xxhash64("id")).alias("held"))
    assert rows.filter("id < 3000 AND held").count() == 3000 and rows.filter("id >= 3000 AND held").count() < 2700
    assert spark.range(9).filter(bitmap(hashes.limit(0), 0)(F.xxhash64("id"))).count() == 0


def test_a_line_asks_for_grams_of_a_small_index_only(spark):
    index = spark.createDataFrame([("eva",), ("yam",)], "text string").select(F.explode(grams.grams(F.col("text"))).alias("gram"))
    lines = spark.createDataFrame([("nothing of interest stands in here",), ("x = eval(y)",), ("",)], "line string")
    asked = [r.n for r in lines.select(F.size(grams.looked_up(F.col("line"), index)).alias("n")).collect()]
    assert asked[0] <= 2 and 1 <= asked[1] <= 3 and asked[2] == 0
    every = index.union(spark.range(1).select(F.lit(grams.EVERY_TEXT).cast("bigint")))
    assert [r.n for r in lines.select(F.size(grams.looked_up(F.lit(""), every)).alias("n")).collect()] == [1, 1, 1]
