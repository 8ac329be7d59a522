"""Sparse indicator features of texts and what linear text classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import bounded_sample

BITS = 18
BUCKETS = 1 << BITS

#: Classes of bytes for word shapes: small and capital letters, digits, other ASCII as it is, anything else one class.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97


def _pairs(rows: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
    """Distinct (row, bucket) keys in order, row above BITS."""
    key = np.concatenate([(r.astype(np.int64) << BITS) | (h >> K.U64(64 - BITS)).astype(np.int64) for r, h in zip(rows, hashes, strict=True)])
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def _bigrams(words: np.ndarray, row: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    same = row[1:] == row[:-1]
    return row[1:][same], K.join_hash(words[:-1][same], words[1:][same]) + K.U64(salt)


def word_and_shape(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indicators of words, word pairs, word shapes, shape pairs and triples, and of a word that repeats one just before it."""
    buf = K.LOWER[raw]
    starts, ends, _ = K.word_spans(buf, at, K.NOT_SPACE)
    row = K.row_of(at, starts)
    words = K.span_hash(K.prefix_hash(buf), starts, ends)
    kinds = SHAPE[raw]
    kept = np.ones(len(kinds), bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[starts] = True
    to = np.concatenate([[0], np.cumsum(kept)])
    shapes = K.span_hash(K.prefix_hash(kinds[kept]), to[starts], to[ends])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shapes = np.where(again, K.U64(99), shapes)
    r2, w2 = _bigrams(words, row, 1)
    _, s2 = _bigrams(shapes, row, 2)
    three = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    s3 = K.join_hash(shapes[:-2][three], shapes[1:-1][three], shapes[2:][three]) if len(row) > 2 else shapes[:0]
    r3 = row[2:][three] if len(row) > 2 else row[:0]
    return _pairs([row, r2, row, r2, r3], [K.mix(words), K.mix(w2), K.mix(shapes ^ K.U64(3)), K.mix(s2), K.mix(s3)])


def word_and_stem(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indicators of words of letters and digits and of their first 3, 4, 5 and 6 bytes."""
    buf = K.LOWER[raw]
    starts, ends, _ = K.word_spans(buf, at, K.ALNUM)
    row, sums = K.row_of(at, starts), K.prefix_hash(buf)
    rows, hashes = [row], [K.mix(K.span_hash(sums, starts, ends))]
    for n in (3, 4, 5, 6):
        long = ends - starts > n
        rows.append(row[long])
        hashes.append(K.mix(K.span_hash(sums, starts[long], starts[long] + n) + K.U64(n)))
    return _pairs(rows, hashes)


Features = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _extract(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at, _ in K.chunks(batch.column(2)):
                key = features(raw, at)
                to = np.searchsorted(key >> BITS, np.arange(hi - lo + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(to), pa.array((key & (BUCKETS - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), found], names=["doc_id", "label", "features"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """doc_id, label, text: at most ``rows_per_class`` whole labelled texts of each class 0 and 1, chosen by a hash of doc_id.

    A doc_id with several labels has their largest; null labels, ids and texts don't count.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    few = bounded_sample(marks, "label", ["doc_id"], rows_per_class)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"])


class Sample:
    """Feature rows on the driver, in order of doc_id."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("doc_id").combine_chunks()
        lists = rows.column("features").combine_chunks() if rows.num_rows else None
        self.label = rows.column("label").to_numpy() if rows.num_rows else np.zeros(0, int)
        self.to = np.asarray(lists.offsets) - lists.offsets[0].as_py() if rows.num_rows else np.zeros(1, int)
        self.flat = np.asarray(lists.flatten()) if rows.num_rows else np.zeros(0, int)
        self.row = np.repeat(np.arange(len(self.label)), np.diff(self.to))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.flat], len(self.label))


def sample_features(sample: DataFrame, features: Features) -> Sample:
    return Sample(sample.mapInArrow(_extract(features), "doc_id bigint, label int, features array<int>").toArrow())


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins (Platt), both classes weighing the same; smoothed targets."""
    pos, neg = max(1, (label == 1).sum()), max(1, (label == 0).sum())
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(label == 1, 0.5 / pos, 0.5 / neg)
    scale = max(1e-9, np.abs(margin).mean()) if len(margin) else 1.0
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(steps):  # Newton
        p = logistic(a * x + b)
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() + 1e-4 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-4, (h * x).sum(), h.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-10:
            break
    return float(max(a, 1e-6) / scale), float(b)


def _score(shared, features: Features, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = shared.value
        for batch in batches:
            for lo, hi, raw, at, _ in K.chunks(batch.column(text_at)):
                key = features(raw, at)
                margin = np.bincount(key >> BITS, weights[key & (BUCKETS - 1)], hi - lo)
                kept = batch.slice(lo, hi - lo).columns[: None if text_at == 0 else text_at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(logistic(margin + offset))], names=[*batch.schema.names[: len(kept)], "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, offset: float, features: Features) -> DataFrame:
    """doc_id, score for each row of docs from its whole text; a null or empty text has no features and gets the offset's score."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, offset))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(shared, features, 1), "doc_id bigint, score double")


def above(docs: DataFrame, weights: np.ndarray, offset: float, features: Features, least: float) -> DataFrame:
    """The rows of docs, all columns, whose score is at least ``least``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, offset))
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(_score(shared, features, 0), schema).filter(F.col("score") >= least).select("row.*")
