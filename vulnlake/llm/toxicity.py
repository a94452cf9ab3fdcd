"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are words and their beginnings of four and five letters. On a bounded sample of the labelled rows the features that
tell the labels apart are chosen; their document frequencies are counted over all documents. Examples are rows of the sample
with chosen features, in an inverted index by blocks: for each feature the largest weight in each block bounds what a block
can score, so blocks are visited from the highest bound down until no block can reach the nearest found so far. That finds
the same neighbours as comparing with all examples. A constant component stands for the rest of a text, so that texts with
little evidence are near others with little. Votes weigh by closeness, against a prior for texts without evidence, and are
calibrated on the other half of the sample by isotonic regression.

The index is bounded by its parameters and travels to the tasks; documents are scored where they are, without a shuffle. A
null or empty text has no features and gets the rate of labelled texts without features. Without labelled rows every score
is 0.5. Labels that are null are not used; several labels of an id are one, 1 if their mean is at least one half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import sent, small_batches, table, without, written

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.7


class Features:
    """Feature counts of texts, over a chosen vocabulary of tagged words (``w:``) and beginnings (``4:``, ``5:``)."""

    def __init__(self, vocabulary: list[str]):
        self.places = {name: i for i, name in enumerate(vocabulary)}
        self.starts = {name[2:6] for name in vocabulary}  # a word that begins otherwise has no feature

    def of_word(self, word: str) -> list[int]:
        names = (f"w:{word}", f"4:{word[:4]}" if len(word) >= 4 else "", f"5:{word[:5]}" if len(word) >= 5 else "")
        return [self.places[n] for n in names if n in self.places]

    def counts(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        starts = self.starts
        for word, times in Counter(WORD.findall((text or "").lower())).items():
            if word[:4] in starts:
                for p in self.of_word(word):
                    found[p] = found.get(p, 0) + times
        return found


class Index:
    """Examples with unit TF-IDF vectors in blocks, each with its largest weight per feature."""

    def __init__(self, ids: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int, block: int = 256):
        order = sorted(range(len(ids)), key=lambda i: (labels[i], int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i]))
        self.ids = np.array([ids[i] for i in order])
        self.labels = np.array([labels[i] for i in order], float)
        self.blocks = []
        for at in range(0, len(order), block):
            part = [vectors[i] for i in order[at:at + block]]
            lengths = np.array([len(v[0]) for v in part])
            self.blocks.append((at, np.concatenate([v[0] for v in part]), np.concatenate([v[1] for v in part]),
                                np.concatenate(([0], np.cumsum(lengths)[:-1]))))
        self.most = np.zeros((size, len(self.blocks)), np.float32)
        for b, (_, places, weights, _) in enumerate(self.blocks):
            np.maximum.at(self.most[:, b], places, weights.astype(np.float32) * np.float32(1 + 1e-6))

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest, ties by row; a cosine of 0 is no neighbour."""
        if not len(self.blocks) or not len(places):
            return np.zeros(0, np.int64), np.zeros(0)
        query = np.zeros(len(self.most))
        query[places] = weights
        bounds = weights @ self.most[places]
        rows, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or (len(rows) >= k and bounds[b] < least):
                break
            at, terms, values, starts = self.blocks[b]
            found = np.add.reduceat(values * query[terms], starts)
            here = np.flatnonzero(found > 0)
            if skip is not None:
                here = here[self.ids[at + here] != skip]
            rows, scores = np.concatenate([rows, at + here]), np.concatenate([scores, found[here]])
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
                least = scores[-1]
        best = np.lexsort((rows, -scores))
        return rows[best], scores[best]


class Model:
    """Scores texts; made by `fit`."""

    #: The type of the examples' ids.
    id_kind = "bigint"

    def __init__(self, vocabulary: list[str], idf: np.ndarray, k: int, prior: float, weight: float, rest: float = 1.0):
        self.features, self.idf, self.k, self.prior, self.weight = Features(vocabulary), idf, k, prior, weight
        self.rest = rest * float(idf.mean()) if len(idf) else rest
        self.index, self.steps, self.levels = Index([], [], [], len(vocabulary) + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.vocabulary, self.done = vocabulary, {}

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        places = np.array(sorted(counts), np.int64)
        weights = (1 + np.log(np.array([counts[p] for p in places.tolist()], float))) * self.idf[places]
        weights = np.append(weights, self.rest)
        return np.append(places, len(self.idf)), weights / np.sqrt((weights ** 2).sum())

    def vote(self, counts: dict[int, int], skip: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        rows, cosines = self.index.nearest(*self.vector(counts), self.k, skip)
        power = 1 / (1.05 - cosines)
        return float((power @ self.index.labels[rows] + self.weight * self.prior) / (power.sum() + self.weight)), rows, cosines

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.steps, self.levels))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        counts = self.features.counts(text)
        key = tuple(sorted(counts.items()))
        if key not in self.done:
            if len(self.done) > 20_000:
                self.done.clear()
            raw, rows, cosines = self.vote(counts)
            self.done[key] = (self.calibrated(raw), self.index.ids[rows[:5]].tolist(), cosines[:5].tolist())
        return self.done[key]


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing calibration; equal values are pooled, and pooled blocks keep away from 0 and 1."""
    values, inverse = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []  # weighted value, positives, count
    for v, s, n in zip(values, np.bincount(inverse, labels), np.bincount(inverse), strict=True):
        blocks.append([v * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 24_000, max_examples: int = 4_000, max_features: int = 4_096, k: int = 25,
        least_docs: int = 4, least_z: float = 4.2, weight: float = 1.0, rest: float = 1.5, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from the ``max_labelled`` labelled documents with the smallest hashes; texts that repeat count once.

    Features occur in ``least_docs`` of these and differ in their labels from the sample by ``least_z``, the root of
    twice the log likelihood ratio. Document frequencies are those over all of ``docs``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
             .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_y")))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sample = (texts.join(F.broadcast(drawn), "_id").groupBy(F.xxhash64("_text").alias("_h"))
              .agg(F.min_by(F.struct("_id", "_y", "_text"), "_id").alias("r")).select("r.*"))
    sample = written(sample, "labelled")
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{N}]++"), F.lit(0)))
    names = F.array_distinct(F.concat(
        F.transform(words, lambda w: F.concat(F.lit("w:"), w)),
        F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.concat(F.lit("4:"), F.substring(w, 1, 4))),
        F.transform(F.filter(words, lambda w: F.length(w) >= 5), lambda w: F.concat(F.lit("5:"), F.substring(w, 1, 5)))))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("pos")).first()
    n_pos, n_neg = totals["pos"], totals["n"] - totals["pos"]
    if not totals["n"]:
        return Model([], np.zeros(0), k, 0.5, weight)
    rate = n_pos / totals["n"]
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)
    gain = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("pos"), max(rate, 1e-9)) + part(F.col("n") - F.col("pos"), max(1 - rate, 1e-9)))))
    chosen = (sample.select(F.explode(names).alias("name"), "_y").groupBy("name").agg(F.sum("_y").alias("pos"), F.count("*").alias("n"))
              .filter(F.col("n") >= least_docs).withColumn("z", gain).filter(F.col("z") >= least_z)
              .orderBy(F.desc("z"), "name").limit(max_features))
    vocabulary = [r["name"] for r in chosen.collect()]
    n_docs, frequency = _document_frequencies(texts.select("_text"), vocabulary)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1e-3
    rows = _vectors(sample, vocabulary)
    order = sorted(rows, key=lambda r: r["_key"])
    learn, aside = order[::2], order[1::2]
    bare = [r["_y"] for r in order if not r["places"]]
    model = Model(vocabulary, idf, k, (sum(bare) + 0.5) / (len(bare) + 1) if bare else n_pos / (n_pos + n_neg), weight, rest)
    model.id_kind = sample.schema["_id"].dataType.simpleString()
    held = [r for r in learn if r["places"]][:max_examples]
    counts = [dict(zip(r["places"], r["times"], strict=True)) for r in held]
    model.index = Index([r["_id"] for r in held], [model.vector(c) for c in counts], [r["_y"] for r in held], len(vocabulary) + 1)
    if aside:
        raw = np.array([model.vote(dict(zip(r["places"], r["times"], strict=True)))[0] for r in aside])
        model.steps, model.levels = isotonic(raw, np.array([r["_y"] for r in aside], float))
    return model


def _document_frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[int, np.ndarray]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, n, found = Features(vocabulary), 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch["_text"]:
                n += 1
                places = list(features.counts(text))
                found[places] += 1
        some = np.flatnonzero(found)
        yield pd.DataFrame({"place": np.append(some, -1), "n": np.append(found[some], n)})

    totals = texts.mapInPandas(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(len(vocabulary))
    for r in totals:  # one row per feature of the vocabulary
        if r["place"] >= 0:
            frequency[r["place"]] = r["n"]
    return next((r["n"] for r in totals if r["place"] < 0), 0), frequency


def _vectors(sample: DataFrame, vocabulary: list[str]) -> list:
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(vocabulary)
        for batch in batches:
            counts = [features.counts(t) for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "_y": batch["_y"], "_key": batch["_key"],
                                "places": [list(c) for c in counts], "times": [list(c.values()) for c in counts]})

    return sample.withColumn("_key", F.xxhash64("_id", F.lit(7))).mapInPandas(
        vectors, f"_id {sample.schema['_id'].dataType.simpleString()}, _y int, _key bigint, places array<bigint>, times array<bigint>").collect()


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with score, predicted, and the nearest examples with their cosines as evidence.

    Columns of the input that bear a result's name give way to it.
    """
    small_batches(docs.sparkSession)
    shared, kind = sent(docs.sparkSession, model), model.id_kind

    @F.pandas_udf(f"score double, evidence array<{kind}>, cosines array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared()
        for texts in batches:
            yield pd.DataFrame([known.score(t) for t in texts], columns=["score", "evidence", "cosines"])

    rows = without(docs, ["score", "predicted", "evidence", "cosines", "_s"]).withColumn("_s", scores(F.col(text)))
    return rows.withColumn("score", F.col("_s.score")).withColumn("predicted", (F.col("_s.score") >= THRESHOLD).cast("int")).withColumn(
        "evidence", F.col("_s.evidence")).withColumn("cosines", F.col("_s.cosines")).drop("_s")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def learnt(spark, folder, docs: DataFrame) -> Model:
    """The model of the label table of a folder, without the rows that are held out."""
    return fit(docs, table(spark, folder, "labels").filter(~held_out(F.col("doc_id"))))


def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_texts(docs, learnt(spark, folder, docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.array_join(
            F.transform("evidence", lambda i: i.cast("string")), ",").alias("evidence"))
