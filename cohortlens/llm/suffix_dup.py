"""Exact removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller doc_id, or
earlier in the same one.  Matches never cross documents and are judged on the input.

1. Every window of ``length`` bytes is dealt by its *anchor*, the smallest hash of its ``gram``-byte strings, so that equal
   windows have equal anchors.  Consecutive windows of one anchor form a region of at most ``2 * length`` bytes or so.
   Regions of equal bytes are repeats of the first of them, decided from a hash of their bytes; each task keeps one
   of each before anything is shuffled, which also bounds what a passage that many documents share can send anywhere.
2. What is left are anchors with regions of different bytes.  Those regions meet in shards, and each shard sorts its
   suffixes: prefix doubling after Larsson and Sadakane from groups of equal 8 bytes, refining unsorted groups only.
   Common prefixes after Kasai et al. give the groups of equal windows; all but the earliest are repeats.
3. An anchor with more regions than a shard holds is spread over shards.  These shards then hand on their
   distinct windows, which are merged in hash ranges by binary search: only the earliest of each stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Workspace, numbered

#: A region: anchor, hash of its bytes, document, first window's start, number of windows, whether its anchor occurs in it twice.
REGION = np.dtype([("anchor", "<u8"), ("bytes", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("again", "<i4")])
#: A distinct window of a spread anchor: two hashes of its bytes, document, start.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i4")])


# --- suffix arrays -------------------------------------------------------------------------------


def packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number, zeros past the end."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    out = np.empty(len(text), np.uint64)
    for o in range(min(8, len(text))):
        n = len(out[o::8])
        out[o::8] = padded[o : o + 8 * n].view(">u8")
    return out


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes, by Larsson-Sadakane refinement; words: see ``packed``.

    Zero bytes at the text's end may tie with it at first; the end's rank, below all others, settles that.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    by = words[order]
    begins = np.concatenate([[True], by[1:] != by[:-1]]) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(begins, np.arange(n), 0))  # a group's number is its first slot
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    h = 8
    while n:
        single = begins & np.append(begins[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        mine = order[slots]
        key = (group[slots] << 32) | (rank[np.minimum(mine + h, n)] + 1)
        sort = np.argsort(key, kind="stable")
        order[slots], key = mine[sort], key[sort]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        begins[slots] = fresh
        group[slots] = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = group[slots]
        h *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most`` or a little over, of each slot's suffix with the slot's before.

    Kasai's bound, that a suffix shares at least one byte less than the one a position before it did, carries over from
    position to position along strands of 64, all strands at once.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    shared = np.zeros(n, np.int64)
    for o in range(min(64, n)):
        at = np.arange(o, n, 64)
        have = np.maximum(shared[at - 1] - 1, 0) if o else np.zeros(len(at), np.int64)
        other = before[at]
        live = np.flatnonzero((other >= 0) & (have < most))
        have[other < 0] = 0
        while len(live):
            p, q = at[live] + have[live], other[live] + have[live]
            inside = (p < n) & (q < n)
            live, p, q = live[inside], p[inside], q[inside]
            differ = padded[p] ^ padded[q]
            equal = np.zeros(len(p), np.int64)
            for b in range(8):
                equal += differ >> K.U64(56 - 8 * b) == 0
            have[live] += equal
            live = live[(equal == 8) & (have[live] < most)]
        shared[at] = have
    return shared[order]


def repeated_windows(text: np.ndarray, starts: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For window starts and their order numbers ``key``: which are not the earliest of their bytes, and a group number for each."""
    words = packed(text)
    order = suffix_array(words)
    shared = common_prefixes(words, order, length)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    slots = np.flatnonzero(wanted[order])
    lowest = np.minimum.reduceat(shared[: slots[-1] + 1], np.concatenate([[0], slots[:-1] + 1])) if len(slots) else shared[:0]
    group = np.cumsum((lowest < length) | (np.arange(len(slots)) == 0)) - 1
    number = np.empty(len(text), np.int64)
    number[order[slots]] = group
    mine = number[starts]
    first = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, mine, key)
    return key > first[mine], mine


# --- regions -------------------------------------------------------------------------------------


def regions(raw: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int, gram: int) -> np.ndarray:
    """All regions of a chunk of rows."""
    n, width = len(raw), length - gram + 1
    if n < length:
        return np.zeros(0, REGION)
    sums = K.prefix_hash(raw)
    _, down = K.powers(len(sums))
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> K.U64(32)
    h *= K.U64(0x9E3779B97F4A7C15)
    low, c = h, 1
    while 2 * c <= width:
        low, c = np.minimum(low[:-c], low[c:]), 2 * c
    if width > c:
        low = np.minimum(low[: c - width], low[width - c :])
    inside = np.zeros(len(low), bool)  # windows that stay in one row
    for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - b >= length:
            inside[b : e - length + 1] = True
    begins = inside.copy()
    begins[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    row_starts = at[:-1][np.diff(at) >= length]
    begins[row_starts] = True
    begin = np.flatnonzero(begins)
    if not len(begin):
        return np.zeros(0, REGION)
    total = np.concatenate([[0], np.cumsum(inside)])
    stop = np.append(begin[1:], len(low))
    count = total[stop] - total[begin]
    out = np.zeros(len(begin), REGION)
    row = K.row_of(at, begin)
    out["anchor"], out["doc"], out["start"], out["n"] = low[begin], docs[row], begin - at[row], count
    out["bytes"] = K.span_hash(sums, begin, begin + count + length - 1)
    # A window can stand in a region twice only if the region's anchor does: its first and last place then differ.
    step = np.arange(width)
    for i in range(0, len(begin), 8192):
        b, last = begin[i : i + 8192], begin[i : i + 8192] + count[i : i + 8192] - 1
        left = b + h[b[:, None] + step].argmin(axis=1)
        right = last + width - 1 - h[last[:, None] + step[::-1]].argmin(axis=1)
        out["again"][i : i + 8192] = left != right
    return out


def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of regions of equal bytes, the first; and all that are repeats of it."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["bytes"], rows["anchor"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["bytes"][1:] != rows["bytes"][:-1])
    first = rows[new][np.cumsum(new) - 1] if len(rows) else rows
    return rows[new], rows[(rows["doc"] != first["doc"]) | (rows["start"] != first["start"])]


# --- stages --------------------------------------------------------------------------------------

#: Most tasks of a shuffle; with more parts or shards than that, a task goes through several in turn.
TASKS = 20_000
_BLOB = "part int, kind int, rows binary"
_FOUND = "kind int, anchor bigint, doc bigint, start int, n int"


def _blobs(rows: np.ndarray, part: np.ndarray, kind: int) -> pa.RecordBatch:
    """One binary value of packed rows for each part."""
    by = np.argsort(part, kind="stable")
    rows, part = rows[by], part[by]
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    at = np.append(begins, len(part)).astype(np.int32) * rows.dtype.itemsize
    blob = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[begins].astype(np.int32)), pa.array(np.full(len(begins), kind, np.int32)), blob], names=["part", "kind", "rows"])


def _cut(length: int, gram: int, parts: int, together: int = 32 << 20):
    """Regions of all windows as packed rows by anchor (kind 0), one for each content of about ``together`` bytes of text; kind 1: repeats of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            first, again = firsts(rows)
            yield _blobs(first, first["anchor"] % K.U64(parts), 0)
            if len(again):
                yield _blobs(again, K.mix(again["doc"].astype(np.uint64)) % K.U64(parts), 1)

        for batch in batches:
            docs = batch.column(0).to_numpy()
            for lo, hi, raw, at, _ in K.chunks(batch.column(1)):
                held.append(regions(raw, at, docs[lo:hi], length, gram))
                size += len(raw)
                if size >= together:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _by_part(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, packed rows of each blob) for each part of a stream in order of part and kind."""
    now, held = None, []
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, kind) != now and held:
                yield now[1], held
                held = []
            now = (part, kind)
            held.append(np.frombuffer(blob, dtype))
    if held:
        yield now[1], held


def _found(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    anchor = rows["anchor"].view(np.int64) if "anchor" in rows.dtype.names else np.zeros(len(rows), np.int64)
    n = rows["n"] if "n" in rows.dtype.names else np.ones(len(rows), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(np.ascontiguousarray(anchor)), pa.array(np.ascontiguousarray(rows["doc"])), pa.array(np.ascontiguousarray(rows["start"])), pa.array(np.ascontiguousarray(n))], names=["kind", "anchor", "doc", "start", "n"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (kind 1), and regions whose anchor has several contents or a content that may repeat itself (kind 0)."""
    for kind, blobs in _by_part(batches, REGION):
        rows = np.concatenate(blobs)
        if kind == 1:
            yield _found(1, rows)
            continue
        first, again = firsts(rows)
        yield _found(1, again)
        _, which, n = np.unique(first["anchor"], return_inverse=True, return_counts=True)
        selfish = np.bincount(which, first["again"], len(n)) > 0
        yield _found(0, first[(n[which] > 1) | selfish[which]])


_SHARD = "shard bigint, spread boolean, doc bigint, start int, n int, bytes binary"


def _fetch(length: int):
    """The bytes of a document's wanted regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            size = 0
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer()
                for w in wanted:
                    bytes_ = raw.slice(w["start"], w["n"] + length - 1).to_pybytes()
                    for c, v in zip(cols, (w["shard"], w["spread"], doc, w["start"], w["n"], bytes_), strict=True):
                        c.append(v)
                    size += len(bytes_)
                if size > 8 << 20:
                    yield _shard_rows(cols)
                    cols, size = [[], [], [], [], [], []], 0
            yield _shard_rows(cols)

    return run


def _shard_rows(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "spread", "doc", "start", "n", "bytes"])


def _sort_shards(length: int, parts: int):
    """Repeats within a shard, as regions of kind 1; distinct windows of spread anchors, packed by hash (kind 2)."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        raw, at, _ = K.string_buffers(t.column("bytes"))
        text = raw[at[0] : at[-1]]
        at = at - at[0]
        n, doc, start = t.column("n").to_numpy().astype(np.int64), t.column("doc").to_numpy(), t.column("start").to_numpy().astype(np.int64)
        region = np.repeat(np.arange(len(n)), n)
        into = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
        docs, places = doc[region], start[region] + into
        by = np.lexsort((places, docs))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (docs[by][1:] != docs[by][:-1]) | (places[by][1:] != places[by][:-1])
        key = np.empty(len(by), np.int64)
        key[by] = np.cumsum(fresh)
        gone, group = repeated_windows(text, at[region] + into, key, length)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | (region[1:] != region[:-1])
        b = np.flatnonzero(begins)
        ends = gone.copy()
        ends[:-1] &= ~gone[1:] | (region[1:] != region[:-1])
        out = np.zeros(len(b), REGION)
        out["doc"], out["start"], out["n"] = docs[b], places[b], np.flatnonzero(ends) + 1 - b
        yield _blobs(out, K.mix(out["doc"].astype(np.uint64)) % K.U64(parts), 1)
        spread = t.column("spread").to_numpy(zero_copy_only=False)[region] & ~gone
        if spread.any():
            w = np.flatnonzero(spread)
            w = w[np.unique(group[w], return_index=True)[1]]
            spot = at[region[w]] + into[w]
            out = np.zeros(len(w), WINDOW)
            out["a"] = K.span_hash(K.prefix_hash(text), spot, spot + length)
            out["b"] = K.span_hash(K.prefix_hash(text[::-1]), len(text) - spot - length, len(text) - spot)
            out["doc"], out["start"] = docs[w], places[w]
            yield _blobs(out, out["a"] % K.U64(parts), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if shards[lo] != now and held:
                    yield from solve(held)
                    held = []
                now = shards[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the distinct windows that several shards hold, by binary search of each shard's sorted list in the merged keys."""
    for _, blobs in _by_part(batches, WINDOW):
        lists = [b[np.lexsort((b["b"], b["a"]))] for b in blobs]
        every = np.concatenate(lists)
        every = every[np.lexsort((every["start"], every["doc"], every["b"], every["a"]))]
        new = np.ones(len(every), bool)
        new[1:] = (every["a"][1:] != every["a"][:-1]) | (every["b"][1:] != every["b"][:-1])
        best = every[new]
        for mine in lists:
            at = np.searchsorted(best["a"], mine["a"], "left")
            while (miss := best["b"][at] != mine["b"]).any():  # equal first hashes
                at = at + miss
            later = (mine["doc"] != best["doc"][at]) | (mine["start"] != best["start"][at])
            yield _found(1, mine[later])


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at, _ in K.chunks(batch.column(1)):
                spans, kept = [], []
                for i, found in enumerate(batch.column(2).slice(lo, hi - lo)):
                    mine = raw[at[i] : at[i + 1]]
                    union: list[tuple[int, int]] = []
                    if found.is_valid and len(found.values):
                        start = np.asarray(found.values.field(0)).astype(np.int64)
                        end = np.minimum(start + np.asarray(found.values.field(1)) + length - 1, len(mine))
                        edge = np.zeros(len(mine) + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, end, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                        union = list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
                        mine = mine[~gone]
                    spans.append([{"begin": b, "end": e} for b, e in union])
                    kept.append(mine.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, shard_bytes: int = 2 << 20, most: int = 2000) -> DataFrame:
    """Documents without the bytes of strings of ``length`` bytes that also start earlier.

    Returns doc_id, n_bytes, spans (removed byte ranges, disjoint and in order, end exclusive) and kept (the other bytes), one row for
    each row of docs.  A null text has no bytes.  Rows without a doc_id stand after all others, in order of a hash of their texts.
    Rows that repeat a doc_id and a text are one document; several texts of a doc_id are documents in order of a hash.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "suffix")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("without")).first()
    # Rows without an id get numbers from 2**62 on; where an id is as large, all ids give way to numbers in their order.
    nodes, place = numbered(ws, texts, always=bool(one["without"] and (one["last"] or 0) >= 1 << 62)), F.col("doc_id")
    if nodes is not None:
        texts, place = texts.withColumn("of", F.xxhash64("text")).join(nodes, ["doc_id", "of"], "left"), F.col("node")
    key = F.coalesce(place, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3))
    texts = texts.select(key.alias("doc"), "doc_id", "text")
    total = one["bytes"] or 0
    parts = max(8, total // (4 << 20))
    tasks = min(TASKS, parts)

    cut = texts.select("doc", "text").filter(F.octet_length("text") >= length).mapInArrow(_cut(length, gram, parts), _BLOB)
    found = ws.keep(cut.repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(_settle, _FOUND), "found")
    spans = found.filter("kind = 1").select("doc", "start", "n")

    open_ = found.filter("kind = 0").select("anchor", "doc", "start", "n")
    hot = ws.keep(open_.groupBy("anchor").count().filter(F.col("count") > most), "hot")
    size = open_.agg(F.sum(F.col("n") + length - 1)).first()[0]
    if size:
        shards = max(8, size // shard_bytes)
        split = F.pmod(F.xxhash64("doc"), F.ceil(F.coalesce("count", F.lit(1)) / most).cast("bigint"))
        dealt = open_.join(hot, "anchor", "left").select("doc", F.struct(F.pmod(F.xxhash64("anchor", split), F.lit(shards)).alias("shard"), F.col("count").isNotNull().alias("spread"), "start", "n").alias("w"))
        wanted = ws.keep(dealt.groupBy("doc").agg(F.collect_list("w").alias("wanted")), "wanted")
        rows = texts.select("doc", F.col("text").cast("binary").alias("text")).join(wanted, "doc").mapInArrow(_fetch(length), _SHARD)
        solved = rows.repartition(min(TASKS, shards), "shard").sortWithinPartitions("shard").mapInArrow(_sort_shards(length, parts), _BLOB)
        solved = ws.keep(solved, "solved")
        again = solved.filter("kind = 1").mapInArrow(lambda b: (_found(1, np.concatenate(x)) for _, x in _by_part(b, REGION)), _FOUND)
        spans = spans.union(again.select("doc", "start", "n"))
        if not hot.isEmpty():
            merged = solved.filter("kind = 2").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_merge, _FOUND)
            spans = spans.union(merged.select("doc", "start", "n"))
    removed = ws.keep(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("removed")), "removed")
    return texts.join(removed, "doc", "left").select("doc_id", "text", "removed").mapInArrow(_remove(length), "doc_id bigint, n_bytes bigint, spans array<struct<begin:int,end:int>>, kept binary")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without repeated strings of 100 bytes."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["begin"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
