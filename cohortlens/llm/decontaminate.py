"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of ``window`` consecutive words of the benchmark items; an item of fewer words is
one pattern.  Patterns of one length share a block shift table: the last two words of a text
window, hashed, tell how many words the search may skip.  Where it may skip none, the suffix
block's bucket, narrowed by the first block, gives the patterns to compare word by word and then byte by byte.

The search runs over many cursors at once, each over its own stretch of window ends, so that one
numpy step moves all of them.  Benchmark items are handled in blocks of a bounded size: a small benchmark is one
block and one narrow pass, a larger one takes further passes over written intermediate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Workspace

SPANS = "array<struct<begin:int,end:int>>"
STRETCH = 128
TABLE = 1 << 18


def split_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of lower-cased bytes, and each row's first word."""
    starts, ends, first = K.word_spans(buf, at, K.ALNUM)
    return K.span_hash(K.prefix_hash(buf), starts, ends), starts, ends, first


class Patterns:
    """The tables of all patterns of ``size`` words."""

    def __init__(self, size: int, words: np.ndarray, texts: list[bytes], begins: np.ndarray, items: np.ndarray):
        self.size, self.block = size, min(2, size)
        self.words, self.texts = words, texts
        self.shift = np.full(TABLE, size - self.block + 1, np.int16)
        for back in range(size - self.block, -1, -1):  # blocks further from the end first: nearer ones overwrite
            self.shift[self._slot(words, begins + size - 1 - back)] = back
        key = self._bucket(words, begins + size - 1)
        order = np.argsort(key, kind="stable")
        self.key, self.begins, self.items = key[order], begins[order], items[order]

    def _blocks(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        return words[last] if self.block == 1 else words[last - 1] * K.U64(0x9E3779B97F4A7C15) + words[last]

    def _slot(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self._blocks(words, last) >> K.U64(46)).astype(np.int64)

    def _bucket(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        head = self._blocks(words, last - self.size + self.block)
        return self._blocks(words, last) ^ (head * K.U64(0xBF58476D1CE4E5B9))

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words and pattern numbers of all occurrences by word hashes that stay in one row."""
        lo, hi = first[:-1] + self.size - 1, first[1:]
        n = np.maximum(0, -(-(hi - lo) // STRETCH))
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = lo[row] + nth * STRETCH
        stop = np.minimum(at + STRETCH, hi[row])
        found = []
        while len(at):
            step = self.shift[self._slot(words, at)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(ends):
            return ends, ends
        key = self._bucket(words, ends)
        left, right = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = right - left
        ends = np.repeat(ends, n)
        which = np.arange(len(ends)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        for i in range(self.size):
            if not len(ends):
                break
            same = words[ends - self.size + 1 + i] == self.words[self.begins[which] + i]
            ends, which = ends[same], which[same]
        return ends, which


class Block:
    """The patterns of some items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        raw = [text.encode() for _, text in items]
        at = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        buf = K.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        words, starts, ends, first = split_words(buf, at)
        whole = buf.tobytes()
        texts = [whole[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        by: dict[int, list[tuple[int, int]]] = {}
        for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            size = min(window, hi - lo)
            if size:
                by.setdefault(size, []).extend((b, i) for b in range(lo, hi - size + 1))
        self.patterns = [Patterns(size, words, texts, *np.array(x, np.int64).T) for size, x in sorted(by.items())]

    def rows(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Words of each row; for rows with occurrences, their word spans and items."""
        words, starts, ends, first = split_words(buf, at)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for p in self.patterns:
            last, which = p.search(words, first)
            rows = np.searchsorted(first, last, side="right") - 1
            for e, w, r in zip(last.tolist(), which.tolist(), rows.tolist(), strict=True):
                b = e - p.size + 1
                mine = p.begins[w]
                if all(buf[starts[b + i] : ends[b + i]].tobytes() == p.texts[mine + i] for i in range(p.size)):
                    spans, items = found.setdefault(r, ([], set()))
                    spans.append((b - int(first[r]), e + 1 - int(first[r])))
                    items.add(self.names[p.items[w]])
        return np.diff(first), found


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words; touching ones are one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _scan(blocks, with_text: bool):
    """Adds a block's occurrences to what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = blocks.value
        for batch in batches:
            earlier = batch.schema.names[2:]
            for lo, hi, raw, at, _ in K.chunks(batch.column(1)):
                n_words, found = block.rows(K.LOWER[raw], at)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
                items: list[list[str]] = [[] for _ in range(hi - lo)]
                if earlier:
                    spans = [[(x["begin"], x["end"]) for x in s] for s in batch.column(2).slice(lo, hi - lo).to_pylist()]
                    items = batch.column(3).slice(lo, hi - lo).to_pylist()
                for r, (s, i) in found.items():
                    spans[r], items[r] = union(spans[r] + s), sorted({*items[r], *i})
                hit = pa.array([sum(e - b for b, e in s) for s in spans], pa.int64())
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), hit, pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], _SCHEMA.field("spans").type), pa.array(items, _SCHEMA.field("items").type)]
                if with_text:
                    yield pa.RecordBatch.from_arrays([cols[0], batch.column(1).slice(lo, hi - lo), *cols[3:]], names=["doc_id", "text", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)

    return run


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """Where windows of the benchmark's items occur in the documents.

    Returns, for each row of docs, doc_id, n_words, n_hit (words inside any occurrence), spans (disjoint word ranges, end
    exclusive) and items (sorted item_ids as strings).  A null or empty text has no words and a null or empty item no
    window; an item without an id counts as ''.  Rows that repeat an item_id are one item.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for i in range(n):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()  # about block_bytes
        block = spark.sparkContext.broadcast(Block([tuple(x) for x in mine], window))
        if i < n - 1:
            rows = ws.keep(rows.mapInArrow(_scan(block, True), f"doc_id bigint, text string, spans {SPANS}, items array<string>"), f"block{i}")
    return rows.mapInArrow(_scan(block, False), f"doc_id bigint, n_words bigint, n_hit bigint, spans {SPANS}, items array<string>")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; rows without a doc_id are judged by their text too."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    bad = contamination(benchmark_passages(docs.select(key.alias("doc_id"), "text"), benchmark, window)).filter("contaminated")
    return docs.withColumn("_key", key).join(bad.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*docs.columns)


def contamination(passages: DataFrame) -> DataFrame:
    """Adds contaminated: at least one word in twenty, and one at all, lies inside an occurrence."""
    return passages.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op6_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all 13-word windows of ``benchmark``."""
    found = contamination(benchmark_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i) WHERE len(ws) > 0),
w AS (
  SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS g
  FROM d, (SELECT DISTINCT m FROM p), LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i)),
hits AS (SELECT doc_id, i, m, item_id FROM w JOIN p USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
