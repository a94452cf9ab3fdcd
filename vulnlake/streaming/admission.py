"""Exact sliding-window admission, as a batch job and as a stateful stream."""

from __future__ import annotations

import math
import pickle
from collections import deque
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vulnlake.dimensions import DEFAULT_RATE_LIMIT, RATE_LIMITS
from vulnlake.operators.scale import kept as kept_table

RESULT = "allowed boolean, remaining int, retry_after int"
KEEP_SECONDS = 3600  # fixed value: state of a client is dropped after an hour
PART_ROWS = 50_000  # rows that a task of the stream holds before it writes them to its state
CLIENT, BUCKET = "_client", "_bucket"


def client_key(forwarded: Column, real_ip: Column, host: Column) -> Column:
    """First forwarded address, else the proxy's, else the host, else unknown."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(forwarded != "", first), F.when(real_ip != "", real_ip), host, F.lit("unknown"))


def rate_limit(path: Column) -> tuple[Column, Column]:
    """(requests, seconds) by path prefix in table order."""
    requests, seconds = F.lit(DEFAULT_RATE_LIMIT[0]), F.lit(DEFAULT_RATE_LIMIT[1])
    for prefix, n, s in reversed(RATE_LIMITS):
        requests = F.when(path.startswith(prefix), n).otherwise(requests)
        seconds = F.when(path.startswith(prefix), s).otherwise(seconds)
    return requests, seconds


def admit(times, accepted: deque, limit: int, window: float):
    """Decisions for ordered times (seconds). ``accepted`` holds the accepted times still in the window."""
    out = []
    for now in times:
        while accepted and accepted[0] <= now - window:
            accepted.popleft()
        if len(accepted) >= limit:
            out.append((False, 0, max(1, math.trunc(accepted[0] + window - now))))
        else:
            accepted.append(now)
            out.append((True, limit - len(accepted), 0))
    return out


def _lent(requests: DataFrame, window: int) -> DataFrame:
    """Each row in its own time slice of the window's length and once more in the next one.

    What lies up to a window back is then found in the same slice, so a busy key is spread
    over as many tasks as it has slices.
    """
    own = F.floor(F.unix_micros("ts") / (window * 1_000_000))
    return requests.withColumn("_own", own).withColumn("_slice", F.explode(F.array(own, own + 1)))


def _returned(lent: DataFrame) -> DataFrame:
    return lent.filter(F.col("_own") == F.col("_slice")).drop("_own", "_slice")


def requests_in_window(requests: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Requests of the key in the last ``window`` seconds, rejected ones included: an upper bound."""
    recent = Window.partitionBy(*keys, "_slice").orderBy(F.unix_micros("ts")).rangeBetween(-window * 1_000_000 + 1, 0)
    return _returned(_lent(requests, window).withColumn("requests", F.count("*").over(recent)))


def decide(requests: DataFrame, keys: list[str], limit: int, window: int, order: str, slices: int = 8) -> DataFrame:
    """Exact decisions over a whole request log; a client that never pauses is spread over many tasks, too.

    Decisions depend on the accepted times of the last window only. The log of a key is cut into slices of ``slices``
    windows, and all slices run at once: each guesses its first state from the rows of one window before it, taken as if the key
    had been silent until then. Where the state at the end of a slice is what the next one guessed, the next one is right.
    Slices that guessed wrong run again from the state their neighbour ended with, until no state changes. After a
    pause, or a window in which the key stayed below its limit, every guess is right; only a key that is over its limit all
    the time takes a round for each slice. A task streams the rows of a slice in order, with its accepted times as only state.
    """
    size = slices * window
    own = F.floor(F.unix_micros("ts") / (size * 1_000_000)).cast("bigint")
    soon = F.pmod(F.unix_micros("ts"), F.lit(size * 1_000_000)) >= (size - window) * 1_000_000
    lent = requests.withColumn("_own", own).withColumn("_s", F.unix_micros("ts") / 1e6).withColumn(
        "_slice", F.explode(F.when(soon, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    rows = kept_table(lent, "requests")
    names = [*keys, "_slice"]
    same = lambda left, right: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    no_state = F.lit(None).cast("array<double>")
    decided = kept_table(_sliced(rows.withColumn("_from", no_state), requests, names, order, limit, window), "decisions")
    while True:
        states = decided.filter("_end IS NOT NULL").select(*names, "_first", "_start", "_end")
        # What the slice before ended with, as far as it counts at the first row; nothing if there is no slice before.
        live = F.filter(F.coalesce(F.col("b._end"), F.array().cast("array<double>")), lambda t: t > F.col("a._first") - window)
        wrong = states.alias("a").join(states.alias("b"), reduce(and_, same("a", "b")) & (F.col("a._slice") == F.col("b._slice") + 1), "left").withColumn(
            "_from", live).filter(F.filter("a._start", lambda t: t > F.col("a._first") - window) != F.col("_from"))
        wrong = kept_table(wrong.select(*[F.col(f"a.{n}").alias(f"_k{i}") for i, n in enumerate(names)], "_from"), "wrong")
        if wrong.isEmpty():
            return decided.filter("allowed IS NOT NULL").select(*requests.columns, "allowed", "remaining", "retry_after")
        matches = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(names)])
        again = rows.filter("_slice = _own").join(wrong, matches).select(*rows.columns, "_from")
        again = _sliced(again, requests, names, order, limit, window)
        decided = kept_table(decided.join(wrong.drop("_from"), matches, "left_anti").unionByName(again), "decisions")


def _sliced(rows: DataFrame, requests: DataFrame, names: list[str], order: str, limit: int, window: float) -> DataFrame:
    """Decisions of the rows of each slice, from the state ``_from`` or else from the lent rows before the slice.

    One more row per slice has only its key and tells the time of its first row, and the states before that and at its end.
    """
    ordered = rows.repartition(*names).sortWithinPartitions(*names, "ts", order)
    kept = [*requests.columns, "_slice"]
    states = pa.list_(pa.float64())
    added = [("allowed", pa.bool_()), ("remaining", pa.int32()), ("retry_after", pa.int32()),
             ("_first", pa.float64()), ("_start", states), ("_end", states)]

    def run(batches):
        current = first = start = types = None
        accepted, closed = deque(), []

        def end():
            closed.append((current, first, start, list(accepted)))

        def ended():
            """The rows of the slices that ended since the last batch, as one batch: most slices have few rows."""
            own = dict(zip(names, zip(*[c[0] for c in closed]), strict=True))
            figures = dict(zip(("_first", "_start", "_end"), list(zip(*closed))[1:], strict=True))
            columns = [pa.array(own[c], t) if c in own else pa.nulls(len(closed), t) for c, t in types]
            columns += [pa.array(figures[c], t) if c in figures else pa.nulls(len(closed), t) for c, t in added]
            closed.clear()
            return pa.RecordBatch.from_arrays(columns, [*kept, *(c for c, _ in added)])

        for batch in batches:
            types = [(c, batch.schema.field(c).type) for c in kept]
            keys = zip(*[batch.column(n).to_pylist() for n in names], strict=True)
            places, decisions = [], []
            for i, (key, now, own) in enumerate(zip(keys, batch.column("_s").to_pylist(), batch.column("_own").to_pylist(), strict=True)):
                if key != current:
                    if first is not None:
                        end()
                    given = batch.column("_from")[i].as_py()
                    current, first, accepted = key, None, deque(given or [])
                if own < key[-1]:
                    admit([now], accepted, limit, window)
                    continue
                if first is None:
                    first, start = now, list(accepted)
                decisions += admit([now], accepted, limit, window)
                places.append(i)
            figures = list(zip(*decisions, strict=True)) or [(), (), ()]
            taken = batch.take(pa.array(places, pa.int64()))
            columns = [taken.column(c) for c in kept] + [pa.array(v, t) for v, (_, t) in zip(figures, added)]
            columns += [pa.nulls(len(places), t) for _, t in added[3:]]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *(c for c, _ in added)])
            if closed:
                yield ended()
        if first is not None:
            end()
            yield ended()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return ordered.mapInArrow(run, f"{fields}, _slice bigint, {RESULT}, _first double, _start array<double>, _end array<double>")


class Admission(StatefulProcessor):
    """Decides the requests of a bucket of clients in order of time, whatever the order and the micro-batches in which they come.

    Rows wait in state, by chunks of ``chunk_ms`` of their time, until the watermark has passed their slice; what arrives together
    is one part of a chunk. A bucket has one timer for decisions, at the end of the first slice that waits; when it fires, all slices that the
    watermark has passed are decided in order, chunk by chunk. Kept are the waiting rows and the accepted times of each client; another
    timer drops those of clients that paused for an hour. In memory are one chunk of one bucket and the accepted times it needs.
    """

    def __init__(self, columns: list[str], limit: int, window: float, order: str, slice_ms: int, chunk_ms: int):
        self.columns, self.limit, self.window, self.order, self.slice_ms, self.chunk_ms = columns, limit, window, order, slice_ms, chunk_ms
        self.keep_ms = math.ceil(max(KEEP_SECONDS, window) * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk long, number long", "part binary")
        self.parts = handle.getValueState("parts", "number long")
        self.accepted = handle.getMapState("accepted", "client string", "times binary")
        self.due = handle.getValueState("due", "time long")
        self.idle = handle.getValueState("idle", "time long")

    def _ends(self, rows: pd.DataFrame):
        """When the slices of the rows end, in milliseconds."""
        return (rows["ts"].astype("datetime64[us]").astype("int64").to_numpy() // (self.slice_ms * 1000) + 1) * self.slice_ms

    def _expect(self, time: int) -> None:
        self.handle.registerTimer(time)
        self.due.update((time,))

    def _drop_at(self, time: int) -> None:
        self.handle.registerTimer(time)
        self.idle.update((time,))

    def _store(self, frames: list[pd.DataFrame], number: int) -> tuple[int, int]:
        """Adds rows to their chunks; returns the end of their first slice and the next number of a part."""
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        ends = self._ends(frame)
        chunks = (ends - self.slice_ms) // self.chunk_ms
        for chunk, part in [(chunks[0], frame)] if (chunks == chunks[0]).all() else frame.groupby(chunks):
            self.waiting.updateValue((int(chunk), number), (pickle.dumps(part, 5),))
            number += 1
        return int(ends.min()), number

    def handleInputRows(self, key, rows, timerValues):
        firsts, frames, size = [], [], 0
        before = self.parts.get()
        number = before[0] if before is not None else 0
        for frame in rows:
            if len(frame):
                frames.append(frame.set_axis(self.columns, axis=1).drop(columns=BUCKET))  # Spark does not tell the names of computed columns
                size += len(frame)
            if size >= PART_ROWS:
                first, number = self._store(frames, number)
                firsts.append(first)
                frames, size = [], 0
        if frames:
            first, number = self._store(frames, number)
            firsts.append(first)
        if firsts:
            self.parts.update((number,))
            due, first = self.due.get(), min(firsts)
            if due is None or first < due[0]:
                idle = self.idle.get()
                if due is not None and due != idle:
                    self.handle.deleteTimer(due[0])
                self._expect(first)
        return iter(())

    def _decided(self, rows: pd.DataFrame, held: dict) -> pd.DataFrame:
        """The rows of one chunk with their decisions; ``held`` gathers the accepted times of their clients."""
        rows = rows.sort_values(["ts", self.order], kind="stable").reset_index(drop=True)
        seconds = (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        decisions = []
        for client, now in zip(rows.pop(CLIENT).tolist(), seconds, strict=True):
            accepted = held.get(client)
            if accepted is None:
                before = self.accepted.getValue((client,))
                accepted = held[client] = deque(pickle.loads(before[0]) if before is not None else ())
            decisions += admit((now,), accepted, self.limit, self.window)
        return pd.concat([rows, pd.DataFrame(decisions, columns=["allowed", "remaining", "retry_after"])], axis=1)

    def _decide(self, watermark: int):
        parts, held = {}, {}
        for chunk, number in self.waiting.keys():
            parts.setdefault(chunk, []).append(number)
        for chunk in sorted(parts):
            numbers = sorted(parts[chunk])
            frames = [pickle.loads(self.waiting.getValue((chunk, n))[0]) for n in numbers]
            rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
            passed = self._ends(rows) < watermark
            left = rows[~passed]
            if len(left) < len(rows):
                yield self._decided(rows[passed], held)
                for n in numbers:
                    self.waiting.removeKey((chunk, n))
                if len(left):
                    self.waiting.updateValue((chunk, numbers[0]), (pickle.dumps(left, 5),))
            if len(left):
                self._expect(int(self._ends(left).min()))
                break
        for client, accepted in held.items():
            if accepted:
                self.accepted.updateValue((client,), (pickle.dumps(list(accepted), 5),))
        last = max((accepted[-1] for accepted in held.values() if accepted), default=None)
        if last is not None and self.idle.get() is None:
            self._drop_at(math.ceil(last * 1000) + self.keep_ms)

    def _drop_idle(self, now: int) -> None:
        """Drops clients without an accepted request in the last hour; looks again when the last of the others may have to go."""
        last = {client[0]: pickle.loads(times[0])[-1] for client, times in self.accepted.iterator()}
        for client, time in last.items():
            if time * 1000 <= now - self.keep_ms:
                self.accepted.removeKey((client,))
        active = [time for time in last.values() if time * 1000 > now - self.keep_ms]
        if active:
            self._drop_at(math.ceil(max(active) * 1000) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        due, idle = self.due.get(), self.idle.get()
        if idle is not None and idle[0] == now:
            self.idle.clear()
            self._drop_idle(now)
        if due is not None and due[0] == now:
            self.due.clear()
            yield from self._decide(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def decide_stream(requests: DataFrame, keys: list[str], limit: int, window: int, order: str, slice_seconds: float = 1,
                  chunk_seconds: float = 86400, buckets: int = 256) -> DataFrame:
    """Exact decisions on a stream with an event-time watermark, equal to those of `decide` over the same rows.

    A request is decided when the watermark has passed the end of its slice; rows that come later than the watermark are dropped
    by Spark. Clients are dealt to ``buckets``, whose rows wait, have a timer and are decided together: what a task does for a key
    of its state costs far more than a row, and most clients have few rows. Rows wait in chunks of ``chunk_seconds``, of
    which one is in memory at a time. Like the partitions of the state, the number of buckets must stay the same for
    a checkpoint. Needs the RocksDB state store, which this sets for the session.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    dealt = requests.withColumn(CLIENT, F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))).withColumn(
        BUCKET, F.pmod(F.xxhash64(CLIENT), F.lit(buckets)))
    return dealt.groupBy(BUCKET).transformWithStateInPandas(
        Admission(dealt.columns, limit, window, order, int(slice_seconds * 1000), int(chunk_seconds * 1000)), f"{fields}, {RESULT}", "append", "eventTime")
