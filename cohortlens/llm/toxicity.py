"""Toxicity classifier with a counterfactual penalty.

A logistic model over word and word-stem indicators.  Each labelled text that names a group also comes
with the group's name swapped for another of its kind; the fit pays for the square of the change
in score, so that weights settle on what is said and not on who is named (Garg et al., 2019).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import linear
from .common import fold
from .quality import log_ratio

#: Names of groups, each with others of its kind.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "sikh", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "catholics", "sikhs", "atheists"],
    ["black", "white", "asian", "african", "latino", "arab", "european", "indigenous"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"],
    ["woman", "man", "girl", "boy"],
    ["women", "men", "girls", "boys"],
    ["female", "male"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["deaf", "blind", "disabled", "autistic"],
    ["old", "young", "elderly", "teenage"],
    ["chrétiens", "musulmans", "juifs", "hindous"],
    ["femmes", "hommes"],
    ["christen", "muslime", "juden", "hindus"],
    ["frauen", "männer"],
    ["cristianos", "musulmanes", "judíos", "hindúes"],
    ["mujeres", "hombres"],
]

_KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}
_TERM = re.compile(r"\b(" + "|".join(sorted(_KIND, key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)


def swapped(text: str, by: int) -> str:
    """The text with each group's name replaced by the one ``by`` places further in its list, in the same case."""

    def other(m: re.Match) -> str:
        kind = _KIND[m[0].lower()]
        new = kind[(kind.index(m[0].lower()) + by) % len(kind)]
        return new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][0].isupper() else new

    return _TERM.sub(other, text)


def _twins(swaps: int):
    """Rows (doc_id, turn, label, text): turn 0 is the text itself, others are different texts with names swapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc_id * (swaps + 1), label, text))
                if _TERM.search(text):
                    rows += [(doc_id * (swaps + 1) + i, label, t) for i in range(1, swaps + 1) if (t := swapped(text, i)) != text]
            ids, labels, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "label", "text"])

    return run


def fit(sample: linear.Sample, ids: np.ndarray, swaps: int, penalty: float = 4.0, ridge: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights over buckets and offset, calibrated on every fifth document, which the fit doesn't see; without both classes, the one there decides."""
    n = len(sample.label)
    first = ids % (swaps + 1) == 0
    if len(set(sample.label[first].tolist())) < 2:
        return np.zeros(linear.BUCKETS), 2.0 if n and sample.label[0] == 1 else -2.0 if n else 0.0
    own = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a twin's original stands before it
    doc = np.cumsum(first) - 1
    aside = doc % 5 == 4
    if len(set(sample.label[first & aside].tolist())) < 2:
        aside[:] = False
    use = first & ~aside
    ratio = log_ratio(sample, use)
    df = np.bincount(sample.flat[use[sample.row]], minlength=linear.BUCKETS)
    scale = np.where(df >= 3, np.abs(ratio), 0.0)
    keep = scale[sample.flat] > 0
    flat, row = sample.flat[keep], sample.row[keep]
    x = scale[flat]
    y = (sample.label == 1).astype(float)
    share = np.where(y == 1, 0.5 / max(1, (use & (y == 1)).sum()), 0.5 / max(1, (use & (y == 0)).sum())) * use
    twin = ~first & ~aside
    w, b = np.zeros(linear.BUCKETS), 0.0
    m1, m2 = np.zeros(linear.BUCKETS + 1), np.zeros(linear.BUCKETS + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        p = linear.logistic(np.bincount(row, w[flat] * x, n) + b)
        pull = share * (p - y)
        if twin.any():  # (p - p of the original) squared
            gap = np.where(twin, p - p[own], 0.0) * 2 * penalty / twin.sum()
            slope = p * (1 - p)
            pull = pull + gap * slope - np.bincount(own, gap, n) * slope
        g = np.append(np.bincount(flat, pull[row] * x, linear.BUCKETS) + ridge * w, pull.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights = w * scale
    judged = first & aside if aside.any() else first
    slope, offset = linear.calibrate((sample.margins(weights) + b)[judged], sample.label[judged])
    return weights * slope, b * slope + offset


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = 2000, swaps: int = 2) -> tuple[np.ndarray, float]:
    """From at most ``rows_per_class`` whole labelled texts of each class and their counterfactual twins."""
    some = linear.labelled_sample(docs, labels, label, rows_per_class)
    # Ids may be of any size: the bounded sample's rows are numbered, in order of doc_id, to leave room for the twins.
    some = some.withColumn("doc_id", F.row_number().over(Window.orderBy("doc_id", F.xxhash64("text"), "label")).cast("bigint"))
    rows = some.mapInArrow(_twins(swaps), "doc_id bigint, label int, text string").mapInArrow(linear._extract(linear.word_and_stem), "doc_id bigint, label int, features array<int>").toArrow()
    ids = np.sort(rows.column("doc_id").to_numpy()) if rows.num_rows else np.zeros(0, int)
    return fit(linear.Sample(rows), ids, swaps)


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier) for each row of docs."""
    return linear.score(docs, *model, linear.word_and_stem)


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from labels whose crc32(doc_id) modulo 3 is not 1."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))  # without an id, never learned from
    return toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
