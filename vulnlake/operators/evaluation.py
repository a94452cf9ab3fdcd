"""Metrics of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.operators.scale import running_sums

CLIP = 1e-7
TEMPERATURES = [round(0.5 + 0.1 * i, 1) for i in range(25)]  # fixed values: 0.5 to 2.9


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(predictions: DataFrame, keys: list[str] | None = None, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, false rates; empty denominators give 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = predictions.groupBy(*(keys or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return c.select("*", _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"),
                    recall.alias("recall"), _f1(precision, recall).alias("f1"),
                    _ratio(fp, fp + tn).alias("fpr"), _ratio(fn, fn + tp).alias("fnr"))


def class_report(predictions: DataFrame, classes=(0, 1), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    y, p = F.col(label), F.col(prediction)
    counts = predictions.agg(*[x for k in classes for x in (
        F.count_if((y == k) & (p == k)).alias(f"tp{k}"), F.count_if(p == k).alias(f"p{k}"), F.count_if(y == k).alias(f"s{k}"))])
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(str(k)).alias("class"), F.col(f"tp{k}").alias("tp"), F.col(f"p{k}").alias("predicted"),
                 F.col(f"s{k}").alias("support")) for k in classes])))
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    per = rows.select("class", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = per.agg(*[_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names],
                       F.sum("support").alias("support"))
    return (per.unionByName(macro.withColumn("class", F.lit("macro avg")))
            .unionByName(weighted.withColumn("class", F.lit("weighted avg"))))


def _by_score(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: all further work is on these rows."""
    return predictions.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(predictions: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """Area under the ROC curve from rank sums, ties counted half; null with one class only."""
    steps = running_sums(_by_score(predictions, label, score), [F.col("score")], {"below": F.col("neg")})
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    return steps.agg(F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("auc"))


def roc_curve(predictions: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score as threshold."""
    grouped = _by_score(predictions, label, score)
    steps = running_sums(grouped, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    pos, neg = grouped.agg(F.sum("pos")).scalar(), grouped.agg(F.sum("neg")).scalar()
    return steps.select(
        F.col("score").alias("threshold"), _ratio(F.col("tp"), pos).alias("tpr"), _ratio(F.col("fp"), neg).alias("fpr"))


def detection_by_type(samples: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """Detection rate, number and mean confidence of the vulnerable samples per type."""
    bad = samples.filter(F.col("label") == 1).select(key, "vulnerability_type")
    return bad.join(predictions, key).groupBy("vulnerability_type").agg(
        F.avg((F.col("prediction") == 1).cast("double")).alias("detection_rate"), F.count("*").alias("num_samples"),
        F.avg("probability").alias("avg_confidence"))


# ---------------------------------------------------------------- calibration


def calibrated(p: Column, temperature) -> Column:
    """Probability with its logit divided by the temperature; 1 changes nothing."""
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.when(t == 1.0, p).otherwise(1 / (1 + F.exp(-(F.ln(clipped / (1 - clipped)) / t))))


def temperature_losses(predictions: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """(temperature, loss) of the 25 temperatures in one pass over the data."""
    p = F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    logit = F.ln(p / (1 - p))
    losses = []
    for i, t in enumerate(TEMPERATURES):
        q = 1 / (1 + F.exp(-logit / t))
        losses.append(F.avg(F.when(F.col(label) == 1, -F.ln(q)).otherwise(-F.ln(1 - q))).alias(f"l{i}"))
    wide = predictions.agg(*losses)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("temperature"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(TEMPERATURES)])))


def best_temperature(predictions: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    return temperature_losses(predictions, label, score).agg(
        F.min_by("temperature", F.struct("loss", "temperature")).alias("temperature"), F.min("loss").alias("loss"))


def prediction_columns(frame: DataFrame, score: str = "probability") -> DataFrame:
    """Label at .5, confidence and both class probabilities."""
    p = F.col(score)
    hit = p >= 0.5
    return frame.select("*", hit.alias("vulnerable"), hit.cast("int").alias("prediction"),
                        F.when(hit, "VULNERABLE").otherwise("SAFE").alias("label_text"),
                        F.when(hit, p).otherwise(1 - p).alias("confidence"),
                        (1 - p).alias("p_safe"), p.alias("p_vulnerable"))


# ------------------------------------------------------------- explanations


def branch_shares(structure: Column, sequence: Column) -> tuple[Column, Column]:
    """Share of each branch by the lengths of its feature vectors."""
    def norm(v):
        return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))

    total = norm(structure) + norm(sequence) + 1e-8
    return norm(structure) / total, norm(sequence) / total


def dominant_branch(structure_share: Column, sequence_share: Column) -> Column:
    return F.when(structure_share > 0.6, "structural").when(sequence_share > 0.6, "sequential").otherwise("hybrid")


def top_tokens(tokens: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("importance"), "position")
    return tokens.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def line_risk(lines: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Risk per line from token importances, with up to five tokens above one half."""
    risk = tokens.groupBy(key, "line_no").agg(
        F.bround(0.3 * F.avg("importance") + 0.7 * F.max("importance"), 4).alias("risk_score"))
    high = top_tokens(tokens.filter(F.col("importance") > 0.5), [key, "line_no"], 5)
    names = high.groupBy(key, "line_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda s: s["token"]).alias("contributing_tokens"))
    return (lines.join(risk, [key, "line_no"], "left").join(names, [key, "line_no"], "left").select(
        key, "line_no", F.substring("line", 1, 100).alias("code_snippet"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("contributing_tokens", F.array().cast("array<string>")).alias("contributing_tokens")))


def high_risk(frame: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count_if(F.col(column) > 0.7).alias(name), F.count("*").alias(f"{name}_of"))
