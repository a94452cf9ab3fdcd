"""Several models' predictions as one verdict per sample."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators.scale import bounded_broadcast, literal_table

STRATEGIES = ("majority", "weighted", "average", "max_confidence", "stacking")


def _votes(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("_v", F.col("probability") > 0.5)


def majority_vote(predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    votes, n = F.col("_votes"), F.col("_n")
    counted = _votes(predictions).groupBy(key).agg(F.count_if("_v").alias("_votes"), F.count("*").alias("_n"))
    return counted.select(key, (votes > n / 2).alias("is_vulnerable"), (F.abs(votes - n / 2) / (n / 2)).alias("confidence"),
                          (F.greatest(votes, n - votes) / n).alias("agreement"))


def weighted_vote(predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    weight = F.col("weight")
    summed = _votes(predictions).groupBy(key).agg(
        (F.sum(F.col("probability") * weight) / F.sum(weight)).alias("_p"), F.sum(weight).alias("_w"),
        F.sum(F.when(F.col("_v"), weight).otherwise(0.0)).alias("_yes"))
    p, w, yes = F.col("_p"), F.col("_w"), F.col("_yes")
    return summed.select(key, (p > 0.5).alias("is_vulnerable"), (F.abs(p - 0.5) * 2).alias("confidence"),
                         (F.greatest(yes, w - yes) / w).alias("agreement"))


def average_vote(predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    summed = _votes(predictions).groupBy(key).agg(
        F.avg("probability").alias("_p"), F.count_if("_v").alias("_yes"), F.count("*").alias("_n"))
    yes = F.col("_p") > 0.5
    return summed.select(key, yes.alias("is_vulnerable"), (F.abs(F.col("_p") - 0.5) * 2).alias("confidence"),
                         (F.when(yes, F.col("_yes")).otherwise(F.col("_n") - F.col("_yes")) / F.col("_n")).alias("agreement"))


def max_confidence_vote(predictions: DataFrame, key: str = "sample_id", order: str = "model_no") -> DataFrame:
    """The prediction furthest from one half; the earlier model on ties."""
    away = F.abs(F.col("probability") - 0.5)
    best = _votes(predictions).groupBy(key).agg(
        F.min_by(F.struct("_v", away.alias("_a")), F.struct(-away, F.col(order))).alias("_b"),
        F.count_if("_v").alias("_yes"), F.count("*").alias("_n"))
    yes = F.col("_b._v")
    return best.select(key, yes.alias("is_vulnerable"), (F.col("_b._a") * 2).alias("confidence"),
                       (F.when(yes, F.col("_yes")).otherwise(F.col("_n") - F.col("_yes")) / F.col("_n")).alias("agreement"))


def combine(predictions: DataFrame, strategy: str = "weighted", key: str = "sample_id") -> DataFrame:
    """Dispatch by name; ``stacking`` and unknown names fall back to the weighted vote."""
    votes = {"majority": majority_vote, "average": average_vote, "max_confidence": max_confidence_vote}
    return votes.get(strategy, weighted_vote)(predictions, key).withColumn("strategy", F.lit(strategy))


def model_register(spark: SparkSession, models) -> DataFrame:
    """(model_no, model, kind, weight, accuracy) from rows in registration order."""
    return literal_table(spark, [(i, *m) for i, m in enumerate(models)], {
        "model_no": pa.int32(), "model": pa.string(), "kind": pa.string(), "weight": pa.float64(), "accuracy": pa.float64()})


def with_weights(predictions: DataFrame, register: DataFrame) -> DataFrame:
    """Adds place and weight of the registered model."""
    return predictions.join(bounded_broadcast(register.select("model", "model_no", "weight")), "model")
