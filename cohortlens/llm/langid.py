"""Language identification by prediction by partial matching.

One variable-order byte context tree for each language is counted from a bounded sample of labelled rows and then
frozen.  The code length of a byte in a context follows escape method C without exclusions: a context
with n symbols, q of them distinct, codes symbol s in log2((n + q) / n_s) bits or escapes in
log2((n + q) / q) bits to the next shorter context; below the empty context each of 256 bytes costs 8 bits.
A context that a language's tree lacks costs nothing to leave.  As the statistics are frozen,
these lengths are a table over (deepest context, byte, language), so that a text's exact code length under all languages is
a walk of ``order`` table look-ups for each byte, done for a whole chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_sample, fold

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of UTF-8's Latin-1 block in lower case."""
    buf = K.LOWER[raw]
    second = np.zeros(len(buf), bool)
    second[1:] = buf[:-1] == 0xC3
    buf[second & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 0x20
    return buf


def _grams(order: int):
    """Counts of (language, gram): gram is a context of 0 to ``order`` bytes and the byte after it, its length in the bits above 56."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, raw, at, _ in K.chunks(batch.column(1)):
                buf = folded(raw).astype(np.int64)
                into = np.arange(len(buf)) - np.repeat(at[:-1], np.diff(at))
                row_lang, names = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                lang = np.repeat(names, np.diff(at))
                for o in range(min(order, max(len(buf) - 1, 0)) + 1):
                    gram = np.zeros(len(buf) - o, np.int64)
                    for j in range(o + 1):
                        gram = (gram << 8) | buf[j : len(buf) - o + j]
                    ok = into[o:] >= o
                    key, n = np.unique(gram[ok] | ((o + 1) << 48) | (lang[o:][ok] << 52), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(row_lang[key >> 52].tolist(), pa.string()), pa.array(key & ((1 << 52) - 1)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


class Model:
    """Frozen statistics: ``child`` finds a context's extension by one earlier byte, ``bits`` the code lengths."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, table_bytes: int):
        self.langs, self.order = langs, order
        length, body = gram >> 48, gram & ((1 << 48) - 1)
        seen = np.unique(body & 255)
        self.code = np.full(256, len(seen), np.int64)  # bytes never seen share one code, as they cost the same everywhere
        self.code[seen] = np.arange(len(seen))
        width = len(seen) + 1
        sym, ctx = self.code[body & 255], (body >> 8) | ((length - 1) << 48)
        names, which = np.unique(ctx, return_inverse=True)
        total = np.bincount(which, n)
        most = max(2, table_bytes // (width * len(langs) * 4))
        order_of = np.lexsort((names, -total, names >> 48 > 0))  # the empty context first, then the commonest
        chosen = np.sort(names[order_of[:most]])
        ids = {}
        self.child = np.zeros((len(chosen) + 1, width + 1), np.int32)
        parents = np.zeros(len(chosen) + 1, np.int64)
        for c in chosen.tolist():  # by length, so that a parent comes before its children
            k, text = c >> 48, c & ((1 << 48) - 1)
            parent = ids.get(((k - 1) << 48) | (text & ((1 << 8 * (k - 1)) - 1))) if k else 0
            if parent is None:
                continue
            ids[c] = node = len(ids) + 1
            parents[node] = parent
            if k:
                self.child[parent, self.code[text >> 8 * (k - 1)]] = node
        self.child = self.child[: len(ids) + 1]
        node = np.array([ids.get(c, 0) for c in names.tolist()], np.int64)[which]
        self.bits = np.zeros((len(ids) + 1, width, len(langs)), np.float32)
        for i in range(len(langs)):
            mine = (lang == i) & (node > 0)
            nodes, syms, counts = node[mine], sym[mine], n[mine].astype(float)
            all_n, all_q = np.bincount(nodes, counts, len(ids) + 1), np.bincount(nodes, minlength=len(ids) + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(all_q > 0, np.log2((all_n + all_q) / all_q), 0)
            cost = np.zeros((len(ids) + 1, width))
            cost[0] = 8
            begin = np.searchsorted(nodes, np.arange(len(ids) + 2)) if (np.diff(nodes) >= 0).all() else None
            if begin is None:
                by = np.argsort(nodes, kind="stable")
                nodes, syms, counts = nodes[by], syms[by], counts[by]
                begin = np.searchsorted(nodes, np.arange(len(ids) + 2))
            for v in range(1, len(ids) + 1):
                cost[v] = cost[parents[v]] + escape[v]
                s = slice(begin[v], begin[v + 1])
                cost[v, syms[s]] = np.log2((all_n[v] + all_q[v]) / counts[s])
            self.bits[:, :, i] = cost
        self.bits = self.bits.reshape(-1, len(langs))
        self.width = width

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths in bits, rows x languages."""
        if not len(raw):
            return np.zeros((len(at) - 1, len(self.langs)))
        code = self.code[folded(raw)]
        into = np.arange(len(code)) - np.repeat(at[:-1], np.diff(at))
        node = np.ones(len(code), np.int64)
        deepest = node
        flat, step = self.child.ravel(), self.child.shape[1]
        for back in range(1, self.order + 1):
            earlier = np.full(len(code), self.width)  # no byte there
            earlier[back:] = code[:-back] if back < len(code) else code[:0]
            earlier[into < back] = self.width
            node = flat[node * step + earlier].astype(np.int64)
            deepest = np.where(node > 0, node, deepest)
        sums = np.zeros((len(code) + 1, len(self.langs)))
        np.cumsum(self.bits[deepest * self.width + code], axis=0, dtype=np.float64, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]


def train(labelled: DataFrame, order: int = 4, rows_per_language: int = 600, table_bytes: int = 48 << 20) -> Model | None:
    """A model from (doc_id, text, lang) rows: at most ``rows_per_language`` whole texts a language, chosen by a hash of doc_id.

    The driver gets the pooled counts of the sample's contexts, never its texts.  Tables over ``table_bytes`` keep the commonest contexts.
    """
    some = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    sample = bounded_sample(some, "lang", ["doc_id"], rows_per_language).select("lang", "text")
    counts = sample.mapInArrow(_grams(order), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1 or gram < (3L << 48)").toPandas()
    if counts.empty:
        return None
    langs = sorted(counts.lang.unique())
    return Model(langs, counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(), counts.gram.to_numpy(), counts.n.to_numpy(), order, table_bytes)


def _has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(LETTER[raw])])
    out = seen[at[1:]] > seen[at[:-1]]
    for r in np.flatnonzero(~out & (np.diff(at) > 0)).tolist():
        out[r] = any(map(str.isalpha, raw[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for lo, hi, raw, at, _ in K.chunks(batch.column(1)):
                known = _has_letter(raw, at)
                names, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model is not None:
                    bits = model.lengths(raw, at)
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                    names[known] = np.array(model.langs, object)[best[known]]
                    score[known] = share[known]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the likelihoods) for each row of docs, from its whole text.

    A text that is null or has no letter, or any text without a model, is ``und`` with score 0.  Equal code lengths go to the
    language first in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double")


def op1_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from those whose crc32(doc_id) modulo 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))  # without an id, never learned from
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
