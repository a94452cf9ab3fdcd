"""Anchors of near lines, composed over pieces of a file, against the serial fold."""

import random

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import near_lines as nl


def serial(lines):
    """The anchor of each line, in order of arrival."""
    anchors, out = [], {}
    for line in lines:
        near = [a for a in anchors if abs(a - line) <= 2]
        out[line] = near[0] if near else line
        if not near:
            anchors.append(line)
    return out


def files(seed):
    """Runs without a gap in rising, falling and random order, sparse ones, and single lines at the edges of pieces."""
    rng = random.Random(seed)
    out = {"rising": list(range(1, 120)), "falling": list(range(150, 0, -1)), "edges": [7, 8, 15, 16, 23, 24, 31, 100, 104], "one": [5]}
    for i in range(12):
        lines = [x for x in range(200) if rng.random() < rng.choice([0.3, 0.7, 1.0])] or [0]
        rng.shuffle(lines)
        out[f"random {i}"] = lines
    return out


@pytest.mark.parametrize("size,group", [(4, 2), (8, 3), (16, 1024), (4096, 1024)])
def test_anchors_equal_serial_fold(spark, size, group):
    known = files(size)
    rows = [(name, line, i) for name, lines in known.items() for i, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "file_id string, line int, at int").repartition(7)
    got = nl.with_anchors(frame, F.col("at"), size, group)
    assert got.columns == ["file_id", "line", "at", "anchor"] and dict(got.dtypes)["anchor"] == "int"
    found = {}
    for r in got.collect():
        found.setdefault(r.file_id, {})[r.line] = r.anchor
    assert found == {name: serial(lines) for name, lines in known.items()}


def test_composition_is_associative_and_right():
    rng = random.Random(3)
    for _ in range(40):
        lines = [x for x in range(24) if rng.random() < 0.8]
        rng.shuffle(lines)

        def function(piece, size, lines=lines):
            own = [x for x in lines if piece * size - 2 <= x < (piece + 1) * size + 2]
            return nl.function_of(own, piece, size)

        a, b, c = (function(i, 8) for i in range(3))
        assert nl.composed(nl.composed(a, b), c) == nl.composed(a, nl.composed(b, c)) == function(0, 24)


def test_odd_lines(spark):
    rows = [("a", None, 1), ("a", -3, 2), ("a", -1, 3), ("a", 0, 4), ("a", 2, 5), (None, 1, 1), (None, 3, 2)]
    got = nl.with_anchors(spark.createDataFrame(rows, "file_id string, line int, at int"), F.col("at"), 4, 2)
    assert sorted((str(r.file_id), r.at, r.anchor) for r in got.collect()) == [
        ("None", 1, 1), ("None", 2, 1), ("a", 1, None), ("a", 2, -3), ("a", 3, -3), ("a", 4, 0), ("a", 5, 0)]
    assert nl.with_anchors(spark.createDataFrame([], "file_id string, line int, at int"), F.col("at")).collect() == []


def test_no_task_holds_a_file(spark):
    """A file of one run of lines is grouped by pieces, never by the file alone, except for what stands for whole pieces."""
    frame = spark.range(20000).select(F.lit("a").alias("file_id"), F.col("id").cast("int").alias("line"), F.col("id").alias("at"))
    got = nl.with_anchors(frame, F.col("at"), 512, 8)
    assert got.filter(F.col("line") % 3 == 0).filter("anchor <> line").count() == 0
    assert got.filter(F.col("line") % 3 > 0).filter("anchor <> line - line % 3").count() == 0
