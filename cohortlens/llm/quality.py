"""Quality classifier: naive Bayes support vectors.

Indicators of word and shape n-grams are scaled by the log ratio of their smoothed counts in the two classes; a
linear hinge-loss model on them is fitted by dual coordinate descent (Wang and Manning, 2012; Hsieh et al., 2008).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from .common import fold


def log_ratio(sample: linear.Sample, rows: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of each bucket's share of class 1 to its share of class 0, over the given rows."""
    use = rows[sample.row]
    one = use & (sample.label[sample.row] == 1)
    p = alpha + np.bincount(sample.flat[one], minlength=linear.BUCKETS)
    q = alpha + np.bincount(sample.flat[use & ~one], minlength=linear.BUCKETS)
    n1, n0 = (rows & (sample.label == 1)).sum(), (rows & (sample.label == 0)).sum()
    out = np.log(p / (n1 + 2 * alpha)) - np.log(q / (n0 + 2 * alpha))
    return np.where(p + q > 2 * alpha, out, 0.0)


def dual_descent(sample: linear.Sample, rows: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss model over scaled indicators; the last one is the offset.  Rare classes weigh more."""
    y = np.where(sample.label == 1, 1.0, -1.0)
    mine = np.flatnonzero(rows)
    share = {c: max(1, (sample.label[mine] == c).sum()) for c in (0, 1)}
    upper = np.array([cost * len(mine) / (2 * share[c]) for c in sample.label.tolist()])
    x = [ratio[sample.flat[sample.to[i] : sample.to[i + 1]]] for i in range(len(sample.label))]
    norm = np.array([np.sqrt((v * v).sum() + 1.0) for v in x])  # each row has length 1, so that long texts don't rule
    alpha, w = np.zeros(len(y)), np.zeros(linear.BUCKETS + 1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(mine).tolist():
            f = sample.flat[sample.to[i] : sample.to[i + 1]]
            gradient = y[i] * ((w[f] * x[i]).sum() + w[-1]) / norm[i] - 1
            new = min(max(alpha[i] - gradient, 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] / norm[i]
                w[f] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """weights over buckets, offset; both already calibrated to the logistic scale."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset


def fit(sample: linear.Sample, cost: float = 1.0, epochs: int = 8) -> Model:
    """Calibrated on every fifth row, which a first fit doesn't see; without both classes, the one there decides."""
    n = len(sample.label)
    if len(set(sample.label.tolist())) < 2:
        return Model(np.zeros(linear.BUCKETS), 2.0 if n and sample.label[0] == 1 else -2.0 if n else 0.0)
    aside = np.arange(n) % 5 == 4
    if len(set(sample.label[aside].tolist())) < 2:
        aside[:] = False
    ratio = log_ratio(sample, ~aside)
    w = dual_descent(sample, ~aside, ratio, cost, epochs)
    judged = aside if aside.any() else ~aside
    weights = w[:-1] * ratio
    slope, offset = linear.calibrate((sample.margins(weights) + w[-1])[judged], sample.label[judged])
    return Model(weights * slope, w[-1] * slope + offset)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = 2000) -> Model:
    """From at most ``rows_per_class`` whole labelled texts of each class."""
    return fit(linear.sample_features(linear.labelled_sample(docs, labels, label, rows_per_class), linear.word_and_shape))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: good quality likelier) for each row of docs."""
    return linear.score(docs, model.weights, model.offset, linear.word_and_shape)


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from labels whose crc32(doc_id) modulo 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))  # without an id, never learned from
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
