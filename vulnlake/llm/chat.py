"""Chat formatting: roles of transcript lines by a hidden Markov model, then turns in one canonical form.

A transcript is a sequence of lines of which only some name their speaker. The hidden states are the roles, at the start of a
turn and inside it; observations are features of a line: the marker it starts with, whether it asks, opens a block of code,
is long or short, is blank, or follows a blank one. Probabilities are counted on labelled transcripts with smoothing. Viterbi
finds the likeliest roles. It is a product of matrices over (max, +), so a transcript is cut into chunks of bounded length,
their matrices into chunks again, until one is left of each transcript; then each chunk is traced back between its known
ends, from the top down. No task needs a whole transcript.

Null and empty lines are blank lines. Equal rows of a transcript all stay. Rows with a null transcript are one transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import sent, table, without, written
from vulnlake.operators.scale import number_rows, running_sums

ROLES = ("system", "user", "assistant")
#: Words that name a role in front of a line.
MARKERS = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "q", "question", "me"),
           "assistant": ("assistant", "ai", "bot", "a", "answer", "model")}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|<\|?|\[|\*\*)?(" + "|".join(w for ws in MARKERS.values() for w in ws) + r")(?:\*\*)?(?:\|?>|\]|\s*:)+(?:\*\*)?\s*", re.I)
_ROLE_OF = {w: r for r, ws in MARKERS.items() for w in ws}
STATES = tuple((r, p) for r in ROLES for p in ("start", "inside"))
CHUNK = 256


def marker(line: str | None) -> tuple[str | None, str]:
    """The role that a line names, and the line without the marker."""
    found = _MARKER.match(line or "")
    return (_ROLE_OF[found[1].lower()], line[found.end():]) if found else (None, line or "")


def features(line: str | None) -> int:
    """The observation of a line as a number below 4 * 2 ** 5: its marker, and five yes-or-no features."""
    role, rest = marker(line)
    words = len(rest.split())
    bits = ("?" in rest, "```" in rest or rest.startswith("    "), words > 40, words < 6, not rest.strip())
    return (ROLES.index(role) + 1 if role else 0) * 32 + sum(b << i for i, b in enumerate(bits))


class Model:
    """Log probabilities of roles; features are independent given the state."""

    def __init__(self, first: np.ndarray, step: np.ndarray, marks: np.ndarray, bits: np.ndarray):
        self.first, self.step = np.log(first / first.sum()), np.log(step / step.sum(1, keepdims=True))
        mark, bit = np.log(marks / marks.sum(1, keepdims=True)), np.log(bits / bits.sum(2, keepdims=True))
        codes = np.arange(4 * 32)
        self.emission = mark[:, codes // 32] + sum(bit[:, i, (codes >> i) & 1] for i in range(5))

    def product(self, codes: np.ndarray, opening: bool) -> np.ndarray:
        """Best log probability of a chunk from each state before it to each state at its end; an opening one has none before it."""
        best = np.repeat(self.first[None], len(STATES), 0) if opening else self.step.copy()
        best = best + self.emission[:, codes[0]]
        for c in codes[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + self.emission[:, c]
        return best

    def path(self, codes: np.ndarray, opening: bool, begin: int, end: int) -> list[int]:
        """The likeliest states of a chunk between the state before it and the one at its end."""
        score, back = (self.first if opening else self.step[begin]) + self.emission[:, codes[0]], []
        for c in codes[1:]:
            reach = score[:, None] + self.step
            back.append(reach.argmax(0))
            score = reach.max(0) + self.emission[:, c]
        states = [end]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def _multiplied(matrices: np.ndarray) -> np.ndarray:
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None]).max(1)
    return best


def _between(matrices: np.ndarray, begin: int, end: int) -> list[int]:
    """The likeliest states at the end of each matrix."""
    score, back = matrices[0][begin], []
    for m in matrices[1:]:
        reach = score[:, None] + m
        back.append(reach.argmax(0))
        score = reach.max(0)
    states = [end]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _coded(lines: DataFrame) -> DataFrame:
    @F.pandas_udf("int")
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(features).astype("int32")

    return lines.withColumn("_code", codes("text"))


def fit(lines: DataFrame, smoothing: float = 0.5) -> Model:
    """Counts over labelled lines (conv_id, line_no, role, start, text); roles other than the three are left out.

    Counts of starts, steps and features are aggregates with map-side reduction; the steps come from a window over the
    neighbouring line number, joined, so that a long transcript is not sorted by one task.
    """
    known = _coded(lines.filter(F.col("role").isin(*ROLES))).withColumn("_state", _state())
    n = len(STATES)
    first, step, marks, bits = np.full(n, smoothing), np.full((n, n), smoothing), np.full((n, 4), smoothing), np.full((n, 5, 2), smoothing)
    for r in known.groupBy("_state", "_code").count().collect():  # at most 6 x 128 rows
        marks[r["_state"], r["_code"] // 32] += r["count"]
        for i in range(5):
            bits[r["_state"], i, (r["_code"] >> i) & 1] += r["count"]
    after = known.select("conv_id", (F.col("line_no") + 1).alias("line_no"), F.col("_state").alias("_before"))
    for r in known.join(after, ["conv_id", "line_no"], "left").groupBy("_before", "_state").count().collect():
        if r["_before"] is None:
            first[r["_state"]] += r["count"]
        else:
            step[r["_before"], r["_state"]] += r["count"]
    return Model(first, step, marks, bits)


def _state() -> Column:
    role = F.when(F.col("role") == ROLES[0], 0).when(F.col("role") == ROLES[1], 2).otherwise(4)
    return (role + F.when(F.col("start"), 0).otherwise(1)).cast("int")


def tag_lines(lines: DataFrame, model: Model) -> DataFrame:
    """The lines (conv_id, line_no, text) with role and start; line numbers count from 0 without gaps in each transcript."""
    spark = lines.sparkSession
    shared, size = sent(spark, model), len(STATES)
    kind = dict(lines.dtypes)["conv_id"]
    lines = without(lines, ["role", "start", "_pos", "_state", "_code"])
    key = f"conv_id {kind}, pos bigint"

    def chunked(frame: DataFrame, item: str) -> DataFrame:
        """(conv_id, pos, items) from (conv_id, pos, item), CHUNK at a time and in order."""
        dealt = frame.groupBy("conv_id", F.floor(F.col("pos") / CHUNK).alias("pos_")).agg(
            F.sort_array(F.collect_list(F.struct("pos", item))).alias("_i"))
        return written(dealt.select("conv_id", F.col("pos_").alias("pos"), F.transform("_i", lambda x: x[item]).alias("items")), "chunks")

    def of_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared()
        for batch in batches:
            yield batch[["conv_id", "pos"]].assign(matrix=[
                known.product(np.array(c), p == 0).ravel() for c, p in zip(batch["items"], batch["pos"], strict=True)])

    def of_matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["conv_id", "pos"]].assign(matrix=[
                _multiplied(np.array([np.array(m) for m in ms]).reshape(-1, size, size)).ravel() for ms in batch["items"]])

    coded = _coded(lines).select("conv_id", F.col("line_no").alias("pos"), F.col("_code").alias("code"))
    levels = [chunked(coded, "code")]
    while not levels[-1].filter("pos > 0").isEmpty():
        levels.append(chunked(levels[-1].mapInPandas(of_codes if len(levels) == 1 else of_matrices, f"{key}, matrix array<double>"), "matrix"))

    topmost = of_codes if len(levels) == 1 else of_matrices

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The states around each transcript: any before it, and the likeliest at its end."""
        for batch in topmost(batches):
            yield batch[["conv_id", "pos"]].assign(before=0, after=[int(m.reshape(size, size)[0].argmax()) for m in batch["matrix"]])

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for conv, pos, items, before, after in batch[["conv_id", "pos", "items", "before", "after"]].itertuples(index=False):
                ends = _between(np.array([np.array(m) for m in items]).reshape(-1, size, size), before, after)
                parts.append(pd.DataFrame({"conv_id": conv, "pos": pos * CHUNK + np.arange(len(ends)), "before": [before, *ends[:-1]], "after": ends}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["conv_id", "pos", "before", "after"])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared()
        for batch in batches:
            parts = []
            for conv, pos, items, before, after in batch[["conv_id", "pos", "items", "before", "after"]].itertuples(index=False):
                states = known.path(np.array(items), pos == 0, before, after)
                parts.append(pd.DataFrame({"conv_id": conv, "pos": pos * CHUNK + np.arange(len(states)), "state": states}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["conv_id", "pos", "state"])

    around = f"{key}, before int, after int"
    ends = levels[-1].mapInPandas(last, around)
    for level in reversed(levels[1:]):
        ends = _with_ends(level, ends).mapInPandas(down, around)
    states = _with_ends(levels[0], ends).mapInPandas(traced, f"{key}, state int").select(
        F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), "state")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("state") / 2) + 1).cast("int"))
    return lines.join(states, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("line_no") == F.col("_p"))).withColumn("role", role).withColumn(
        "start", F.col("state") % 2 == 0).drop("_c", "_p", "state")


def _with_ends(level: DataFrame, ends: DataFrame) -> DataFrame:
    known = ends.select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), "before", "after")
    return level.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p"))).drop("_c", "_p")


def bare_line(text: Column) -> Column:
    """A line without its marker."""
    @F.pandas_udf("string")
    def bare(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: marker(t)[1])

    return bare(text)


def render_turns(tagged: DataFrame, form: str = "<|{role}|>\n{text}\n<|end|>") -> DataFrame:
    """(conv_id, turn, role, text, rendered): runs of lines from one start to the next, numbered from 0, in one form.

    Turns are numbered by running sums that split long transcripts. Lines lose their markers, a turn the blank lines at its ends.
    """
    first = (F.col("line_no") == 0) | F.col("start")
    numbers = running_sums(
        tagged.select("conv_id", F.xxhash64("conv_id").alias("_key"), "line_no", first.alias("_first")), [F.col("line_no")],
        {"turn": F.col("_first").cast("bigint")}, ["_key"])
    numbers = numbers.select(F.col("conv_id").alias("_c"), F.col("line_no").alias("_n"), (F.col("turn") - 1).alias("turn"))
    rows = tagged.join(numbers, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("line_no") == F.col("_n")))
    turns = rows.withColumn("_bare", bare_line(F.col("text"))).groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "_bare"))).alias("_l"), F.min_by("role", "line_no").alias("role"))
    text = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["_bare"]), "\n"), r"^\s+|\s+$", "")
    parts = re.split(r"(\{role\}|\{text\})", form)
    filled = F.concat(*[F.col(p[1:-1]) if p in ("{role}", "{text}") else F.lit(p) for p in parts])
    return turns.select("conv_id", "turn", "role", text.alias("text")).withColumn("rendered", filled)


def transcript_lines(turns: DataFrame, marked: float = 0.7) -> DataFrame:
    """Plain transcripts of known turns (conv_id, turn, role, text): lines with role and start, numbered from 0.

    A share ``marked`` of the turns, drawn by hash, name their speaker in front, in one of several ways.
    """
    draw = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1000))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    name = F.when(style == 0, F.concat(F.initcap("role"), F.lit(": "))).when(style == 1, F.concat(
        F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("System"), F.lit(": "))).otherwise(
        F.concat(F.lit("### "), F.initcap("role"), F.lit(": ")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.withColumn("_t", F.when(draw < 1000 * marked, F.concat(F.coalesce(name, F.lit("")), text)).otherwise(text))
    # Turns that tie are told apart by their texts, and repeated rows by a running number, so no turn's lines are mixed with another's.
    rows = rows.withColumn("_message", F.struct(F.xxhash64("_t").alias("h"), F.monotonically_increasing_id().alias("n")))
    lines = rows.select("conv_id", "turn", "role", "_message", F.posexplode(F.split("_t", "\n", -1)).alias("_k", "text"))
    keyed = lines.withColumn("start", F.col("_k") == 0).withColumn("_key", F.xxhash64("conv_id"))
    order = ["turn", "role", "_message.h", "_message.n", "_k"]
    numbered = number_rows(keyed, [F.col(c) for c in order], "line_no", ["_key"])
    return numbered.select("conv_id", (F.col("line_no") - 1).alias("line_no"), "turn", "role", "start", "text")


def op4_chat_format(spark, folder):
    lines = written(transcript_lines(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")), "lines")
    known = lines.filter(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 3 != 1)
    return render_turns(tag_lines(lines.select("conv_id", "line_no", "text"), fit(known)))
