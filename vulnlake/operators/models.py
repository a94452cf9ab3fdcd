"""Classifiers on indicator features, and batch scoring."""

from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.code import FEATURES, indicator_features
from vulnlake.functions.text import computed_once
from vulnlake.operators.evaluation import prediction_columns
from vulnlake.operators.scale import kept as kept_table
from vulnlake.operators.scan import lowered

LAYERS = [FEATURES, 128, 64, 32, 2]  # fixed values: layer widths
BLOCK_ROWS = 4096


def with_features(samples: DataFrame, code: str = "code", unicode: bool = True) -> DataFrame:
    rows = computed_once(samples, _low=lowered(F.col(code), unicode))
    return rows.withColumn("features", array_to_vector(indicator_features(F.col(code), unicode, F.col("_low")))).drop("_low")


def merged_samples(samples: DataFrame) -> DataFrame:
    """(x, label, n): equal features with equal labels as one row and their number."""
    return samples.groupBy(vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double").alias("label")).agg(F.count("*").alias("n"))


def _blocks(rows):
    """Rows of a task as arrays of a few thousand rows each."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) == BLOCK_ROWS:
            yield _arrays(part)
            part = []
    if part:
        yield _arrays(part)


def _arrays(part):
    xs, labels, numbers = zip(*part, strict=True)
    return np.array(xs), np.array(labels, dtype=int), np.array(numbers, dtype=float)


def _layers(weights):
    """Matrix and bias of each layer, in the order in which Spark's network keeps its weights."""
    at = 0
    for rows, columns in zip(LAYERS, LAYERS[1:]):
        end = at + rows * columns
        yield weights[at:end].reshape(rows, columns), weights[end:end + columns]
        at = end + columns


def loss_and_gradient(weights, block):
    """Cross-entropy of a block, counted by the number of each row, and its gradient, in one array."""
    x, labels, numbers = block
    layers = list(_layers(weights))
    values = [x]
    for matrix, bias in layers[:-1]:
        values.append(1 / (1 + np.exp(-(values[-1] @ matrix + bias))))
    out = values[-1] @ layers[-1][0] + layers[-1][1]
    out -= out.max(axis=1, keepdims=True)
    log_share = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    rows = np.arange(len(labels))
    loss = -(log_share[rows, labels] * numbers).sum()
    delta = np.exp(log_share)
    delta[rows, labels] -= 1
    delta *= numbers[:, None]
    parts = []
    for (matrix, _), value in zip(reversed(layers), reversed(values)):
        parts = [(value.T @ delta).ravel(), delta.sum(axis=0), *parts]
        delta = (delta @ matrix.T) * value * (1 - value)
    return np.concatenate([[loss], *parts])


def minimise(objective: Callable, point, max_iter: int, tolerance: float = 1e-6, memory: int = 10):
    """Limited-memory BFGS; ``objective`` gives value and gradient."""
    value, gradient = objective(point)
    steps = []
    for _ in range(max_iter):
        direction = -gradient
        used = []
        for step, change in reversed(steps):
            used.append(step @ direction / (step @ change))
            direction = direction - used[-1] * change
        scale = steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.linalg.norm(gradient), 1e-12)
        direction = scale * direction
        for (step, change), back in zip(steps, reversed(used)):
            direction = direction + (back - change @ direction / (step @ change)) * step
        slope, length = gradient @ direction, 1.0
        while True:
            after, steeper = objective(point + length * direction)
            if after <= value + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-10:
                return point
        step, change = length * direction, steeper - gradient
        if step @ change > 1e-12 * (change @ change):
            steps = [*steps[-(memory - 1):], (step, change)]
        gained = value - after
        point, value, gradient = point + step, after, steeper
        if gained <= tolerance * max(abs(value), 1e-6) or np.linalg.norm(gradient) <= tolerance:
            break
    return point


def train_network(samples: DataFrame, max_iter: int = 50, seed: int = 7) -> PipelineModel:
    """Feed-forward classifier; wants ``features`` and a numeric ``label``.

    Spark's network knows no weights, so a pass over it costs what all samples cost. Here equal samples are one row that counts
    by their number: the loss is that of all samples, a pass costs what their distinct vectors cost. It starts at the weights
    Spark's network starts with; only a loss and a gradient per block are added up.
    """
    merged = kept_table(merged_samples(samples), "samples")
    first = merged.limit(1).select(array_to_vector("x").alias("features"), "label")
    start = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=0, seed=seed).fit(first).weights.toArray()
    total = merged.agg(F.sum("n")).first()[0]
    context = merged.sparkSession.sparkContext
    blocks = merged.repartition(context.defaultParallelism).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)

    def objective(weights):
        sent = context.broadcast(weights)
        sums = blocks.map(lambda block: loss_and_gradient(sent.value, block)).treeReduce(add) / total
        sent.destroy()
        return sums[0], sums[1:]

    weights = minimise(objective, start, max_iter)
    blocks.unpersist()
    stage = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=0, seed=seed, initialWeights=Vectors.dense(weights))
    return Pipeline(stages=[stage]).fit(first)


def train_weighted(samples: DataFrame, max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """Logistic regression with balanced class weights in a ``weight`` column."""
    stage = LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[stage]).fit(samples.select("features", F.col("label").cast("double").alias("label"), "weight"))


def score(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Probability of class 1 and the columns derived from it."""
    scored = model.transform(samples)
    kept = samples.drop("features").columns
    rows = scored.select(*kept, vector_to_array(F.col("probability"))[1].alias("probability"))
    return prediction_columns(rows)


def score_with(samples: DataFrame, load, code: str = "code") -> DataFrame:
    """Scores with a model from outside Spark.

    ``load()`` runs once per task and gives a function from a series of texts to a series of
    probabilities; batches arrive as Arrow data.
    """
    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for batch in batches:
            yield predict(batch)

    return prediction_columns(samples.withColumn("probability", probability(F.col(code))))
