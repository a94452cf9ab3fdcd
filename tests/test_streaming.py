"""Streams run to the end and are compared with the batch form or brute force."""

import datetime as dt
import random
from collections import deque

from pyspark.sql import functions as F

from vulnlake.streaming import admission, jobs

BASE = dt.datetime(2024, 1, 1)


def brute(times, limit, window):
    accepted, out = deque(), []
    for now in times:
        live = [a for a in accepted if a > now - window]
        if len(live) >= limit:
            out.append((False, 0, max(1, int(min(live) + window - now))))
        else:
            accepted.append(now)
            out.append((True, limit - len(live) - 1, 0))
    return out


def requests(spark, n=400):
    rng = random.Random(2)
    at, rows = {0: 0, 1: 0, 2: 0}, []
    for i in range(n):
        key = rng.choice([0, 0, 1, 2])
        at[key] += rng.choice([0, 1, 1, 3, 20]) * 1000
        rows.append((i, key, BASE + dt.timedelta(milliseconds=at[key])))
    return spark.createDataFrame(rows, "request_id int, client int, ts timestamp"), rows


def expected(rows, limit, window):
    out = {}
    for client in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == client), key=lambda r: (r[2], r[0]))
        decisions = brute([(r[2] - BASE).total_seconds() for r in own], limit, window)
        out |= {r[0]: d for r, d in zip(own, decisions)}
    return out


def test_exact_admission(spark):
    frame, rows = requests(spark)
    got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in admission.decide(frame, ["client"], 4, 10, "request_id").collect()}
    assert got == expected(rows, 4, 10)
    assert {d[0] for d in got.values()} == {True, False}


def test_admission_of_clients_that_never_pause(spark):
    """Slices that guess their first state wrong are run again: a busy client always over its limit, one now and then, one never."""
    rng = random.Random(4)
    rows = []
    for client, step in ((0, 300), (1, 2400), (2, 9000), (None, 1500)):
        at = 0
        for _ in range(700):
            at += rng.randint(1, 2 * step)
            rows.append((len(rows), client, BASE + dt.timedelta(milliseconds=at)))
    frame = spark.createDataFrame(rows, "request_id int, client int, ts timestamp").repartition(5)
    for slices in (1, 3):
        got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in admission.decide(frame, ["client"], 5, 10, "request_id", slices).collect()}
        assert got == expected(rows, 5, 10)
    assert admission.decide(frame.limit(0), ["client"], 5, 10, "request_id").collect() == []


def test_requests_in_window(spark):
    frame, rows = requests(spark)
    got = {r.request_id: r.requests for r in admission.requests_in_window(frame, ["client"], 10).collect()}
    for i, client, ts in rows:
        assert got[i] == sum(1 for r in rows if r[1] == client and dt.timedelta(0) <= ts - r[2] < dt.timedelta(seconds=10))


def stream_of(spark, frame, folder, parts=3):
    """The rows as a stream whose files arrive in the order of ``_part``."""
    for i in range(parts):
        frame.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{folder}/in/p{i}")
    return spark.readStream.schema(frame.drop("_part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def far_row(frame, part):
    """A request of nobody, long after all others, whose arrival lets the watermark pass these."""
    row = frame.limit(1).withColumn("client", F.lit(-1).cast("int")).withColumn("request_id", F.lit(-1).cast("int"))
    return row.withColumn("ts", F.lit(BASE + dt.timedelta(days=2))).withColumn("_part", F.lit(part).cast("bigint"))


def test_admission_stream_over_batches(spark, tmp_path):
    """Three micro-batches, each of which also holds rows that are up to 10 seconds older than those of the one before."""
    frame, rows = requests(spark)
    last = max(r[2] for r in rows)
    span = (last - BASE).total_seconds() / 3 + 1
    late = (F.col("request_id") % 7 == 0).cast("int") * 10
    at = F.unix_micros("ts") / 1e6 - F.lit((BASE - dt.datetime(1970, 1, 1)).total_seconds())
    frame = frame.withColumn("_part", F.least(F.lit(2), F.floor((at + late) / span)))
    frame = frame.unionByName(far_row(frame, 3))
    stream = stream_of(spark, frame.repartition(3), tmp_path, 4).withWatermark("ts", "1 minute")
    jobs.start(admission.decide_stream(stream, ["client"], 4, 10, "request_id"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected(rows, 4, 10)


def test_state_is_kept_over_a_restart_and_expires_after_an_hour(spark, tmp_path):
    rows = [(0, 1, BASE, 0), (1, 1, BASE + dt.timedelta(seconds=1), 0), (2, 2, BASE + dt.timedelta(seconds=30), 1),
            (3, 1, BASE + dt.timedelta(seconds=3), 1), (4, 2, BASE + dt.timedelta(minutes=50), 2), (5, 2, BASE + dt.timedelta(hours=3), 3),
            (6, 2, BASE + dt.timedelta(hours=3, minutes=2), 4), (7, 2, BASE + dt.timedelta(hours=3, minutes=4), 5)]
    frame = spark.createDataFrame(rows, "request_id int, client int, ts timestamp, _part int")
    entries = []
    for part in range(6):  # a new run for every file: all that is known of the ones before is in the state
        frame.filter(F.col("_part") == part).drop("_part").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
        source = spark.readStream.schema(frame.drop("_part").schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stream = admission.decide_stream(source.withWatermark("ts", "20 seconds"), ["client"], 2, 60, "request_id")
        query = jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        entries.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (True, 1, 0), 1: (True, 0, 0), 3: (False, 0, 57), 2: (True, 1, 0), 4: (True, 1, 0), 5: (True, 1, 0), 6: (True, 1, 0)}
    # The accepted times of client 1 are gone in the end, those of client 2 are not.
    assert entries[-1] < entries[2]


def test_new_files_once(spark, tmp_path):
    rows = [("a.py", "python", "eval(x)", BASE, 0), ("a.py", "python", "eval(x)", BASE + dt.timedelta(hours=1), 1), ("a.py", "python", "exec(x)", BASE + dt.timedelta(hours=2), 2)]
    frame = spark.createDataFrame(rows, "path string, language string, text string, arrived timestamp, _part int")
    jobs.start(jobs.file_findings(stream_of(spark, frame, tmp_path)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.code_snippet for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["eval(x)", "exec(x)"]


def test_request_rates(spark, tmp_path):
    frame, rows = requests(spark, 120)
    batch = jobs.request_rates(frame, ["client"], 3, "10 seconds", "5 seconds")
    stream = stream_of(spark, frame.withColumn("_part", F.lit(0)), tmp_path, 1)
    query = (jobs.request_rates(stream, ["client"], 3, "10 seconds", "5 seconds").writeStream.outputMode("complete").format("memory")
             .queryName("rates").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_secret_stream_and_retention(spark, tmp_path):
    rows = [("a", "python", "password: abcdefgh", BASE, 0)]
    frame = spark.createDataFrame(rows, "path string, language string, text string, arrived timestamp, _part int")
    source = stream_of(spark, frame, tmp_path, 1)
    jobs.start(jobs.file_secrets(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["SECRET002"]
    seen = []
    ticks = spark.readStream.schema("path string, language string, text string, arrived timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    jobs.retention_stream(ticks.withColumnRenamed("arrived", "ts"), str(tmp_path / "r"), seen.append).awaitTermination()
    assert seen == [BASE]


def test_a_client_has_one_timer_however_many_seconds_wait(spark, tmp_path):
    """Each second of a client had a timer, state reads and a frame of its own; what arrives together is now decided together, in any chunks."""
    frame, rows = requests(spark)
    frame = frame.withColumn("_part", F.lit(0).cast("bigint")).unionByName(far_row(frame, 1))
    source = stream_of(spark, frame.repartition(3), tmp_path, 2).withWatermark("ts", "1 minute")
    for seconds in (7, 86400):
        query = jobs.start(admission.decide_stream(source, ["client"], 4, 10, "request_id", chunk_seconds=seconds), str(tmp_path / f"out{seconds}"), str(tmp_path / f"state{seconds}"))
        query.awaitTermination()
        got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(str(tmp_path / f"out{seconds}")).collect()}
        assert got == expected(rows, 4, 10)
        timers = sum(o["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress for o in p["stateOperators"])
        assert 0 < timers <= 3 * 4  # an arrival, a decision and a drop for each of four clients


def test_slices_of_few_rows_leave_a_task_together(spark, monkeypatch):
    """A task sends one batch with the states of all slices that ended in its batch, not one batch for each."""
    import pyarrow as pa

    rows = [(i, f"c{i % 500}", 1704067200 + i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "request_id int, client string, s long").select("request_id", "client", F.timestamp_seconds("s").alias("ts"))
    run = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, function, schema: run.append((self, function)) or self)
    lent = frame.selectExpr("*", "0L AS _own", "unix_micros(ts) / 1e6 AS _s", "0L AS _slice", "CAST(NULL AS array<double>) AS _from")
    admission._sliced(lent, frame, ["client", "_slice"], "request_id", 4, 10)
    ordered, function = run[0]
    batch = ordered.toArrow().sort_by([("client", "ascending"), ("_s", "ascending")]).combine_chunks().to_batches()
    out = list(function(iter(batch)))
    ends = pa.Table.from_batches(out).column("_end")
    assert len(ends) - ends.null_count == 500 and len(out) <= 3 * len(batch)


def test_clients_share_the_timers_of_their_bucket(spark, tmp_path):
    """Each client had timers, frames and state reads of its own, however few its rows; a window may be longer than clients are kept."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        client = rng.choice([None, *range(60)])
        rows.append((i, client, BASE + dt.timedelta(milliseconds=rng.randrange(6 * 3600 * 1000))))
    frame = spark.createDataFrame(rows, "request_id int, client int, ts timestamp").withColumn("_part", F.floor((F.unix_micros("ts") / 1e6) % 86400 / 10800))
    source = stream_of(spark, frame.unionByName(far_row(frame, 2)).repartition(3), tmp_path).withWatermark("ts", "1 minute")
    stream = admission.decide_stream(source.withColumn("path", F.when(F.col("client") % 2 == 0, "/a")), ["client", "path"], 2, 7200, "request_id", buckets=4)
    query = jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected(rows, 2, 7200)
    assert {d[0] for d in got.values()} == {True, False}
    assert 0 < max(o["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress for o in p["stateOperators"]) <= 2 * 4
