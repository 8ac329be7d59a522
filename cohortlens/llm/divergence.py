"""How far the sources of a language differ in their words.

Input tasks count terms of each (lang, source) group and in how many documents they stand, and pass on partial counts.  The kept terms of a language
are dealt over blocks of about ``TERMS`` by hash, and its sources over blocks of about ``GROUPS``; a tile is a block of terms for two blocks of
sources.  In a tile the counts become dense int64 matrices of groups by terms, and all pairs of groups are computed by broadcasting one matrix
against the other.  The tiles' partial pair matrices are summed; of the tiles' best terms of each group, kept in heaps of ten, the best ten are merged.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 10
TOP = 10
TERMS = 1024
GROUPS = 32
#: Different terms that an input task counts before it passes its counts on, and bytes of text that it splits at once.
HELD = 200_000
PIECE = 1 << 20
CELLS = 1 << 19  # of one broadcast array of pairs

#: Bytes outside terms become spaces, A-Z become a-z.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists over pieces that end at a space."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):
            hi = text.rfind(b" ", lo, hi) if b" " in text[lo:hi] else text.find(b" ", hi)
            hi = len(text) if hi < 0 else hi + 1
        yield text[lo:hi].split()
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term) counts of rows (lang, source, text); a row without terms gives its group a row of zeros."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    within: dict[tuple, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), of in counts.items():
            docs, terms = within[lang, source], [*of]
            for lo in range(0, max(1, len(terms)), 16384):
                some = terms[lo : lo + 16384]
                n = len(some)
                if not n:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0]), pa.array([0])], names=["lang", "source", "term", "n", "docs"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(some, pa.binary()).cast(pa.string()), pa.array([of[t] for t in some]), pa.array([docs[t] for t in some])], names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        within.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            of, docs, seen = counts[lang, source], within[lang, source], set()
            held -= len(of)
            for terms in _pieces(text.as_py().translate(_TERM_BYTES)):
                of.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(of) + 1
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), total one a row; exact in int64 for totals below 9e15, by long division in steps of a thousand."""
    above, below = counts + 2, (total + 2 * terms)[:, None]
    out, left = above // below, above % below
    for _ in range(3):
        left *= 1000
        out = out * 1000 + left // below
        left %= below
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of the distances of all rows of p and all rows of q, in blocks of CELLS."""
    out = np.zeros((len(p), len(q)), np.int64)
    wide = max(1, CELLS // max(1, len(p) * len(q)))
    for lo in range(0, p.shape[1], wide):
        out += distances(p[:, None, lo : lo + wide], q[None, :, lo : lo + wide]).sum(axis=2)
    return out


_PARTS = "lang string, source string, part string, item string, value bigint"


def _tile(table: pa.Table) -> pa.Table:
    """Partial pair sums and best terms of one tile.

    Rows: (lang, block, left, right, kind, side, source, term, n, terms), kind 0 a group with its total n, 1 a term of the language with its count, 2 one
    of a group.
    """
    rows = table.to_pydict()
    lang, left, right, terms = rows["lang"][0], rows["left"][0], rows["right"][0], rows["terms"][0]
    place: dict[str, int] = {}
    groups: dict[int, dict[str, int]] = {left: {}, right: {}}
    totals: dict[int, list[int]] = {left: [], right: []}
    whole, whole_total = [], 0
    for kind, side, source, term, n in zip(rows["kind"], rows["side"], rows["source"], rows["term"], rows["n"], strict=True):
        if kind == 0 and side < 0:
            whole_total = n
        elif kind == 0:
            groups[side][source] = len(groups[side])
            totals[side].append(n)
        elif kind == 1:
            place[term] = len(place)
            whole.append(n)
    dense = {side: np.zeros((len(groups[side]), len(place)), np.int64) for side in groups}
    for kind, side, source, term, n in zip(rows["kind"], rows["side"], rows["source"], rows["term"], rows["n"], strict=True):
        if kind == 2:
            dense[side][groups[side][source], place[term]] = n
    p = {side: shares(dense[side], np.array(totals[side], np.int64), terms) for side in groups}
    sums = pair_sums(p[left], p[right])
    out = []
    for i, a in enumerate(groups[left]):
        for j, b in enumerate(groups[right]):
            if left != right:
                out += [(lang, a, "pair", b, int(sums[i, j])), (lang, b, "pair", a, int(sums[i, j]))]
            elif i != j:
                out.append((lang, a, "pair", b, int(sums[i, j])))
    if left == right and place:
        q = shares(np.array([whole], np.int64), np.array([whole_total], np.int64), terms)
        names = [*place]
        far = distances(p[left], q)
        for i, a in enumerate(groups[left]):
            heads = np.flatnonzero((dense[left][i] > 0) & (p[left][i] > q[0]))
            best = heapq.nsmallest(TOP, ((-int(far[i, k]), names[k].encode()) for k in heads))
            out += [(lang, a, "term", t.decode(), -v) for v, t in best]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """Divergence of each pair of sources of a language, and the terms that mark a source against its language.

    Returns lang, source, part, item, value, rank.  Null text, lang and source count as empty.  Terms are runs of letters a-z (A-Z lower-cased) and non-ASCII characters;
    each row is a document, and a language keeps the terms of at least LEAST_DOCUMENTS of its documents.  Part ``pair`` ranks all other
    sources of the language, part ``term`` the TOP terms that are more frequent in the source than in the language, both by value descending, then
    item.  A language with one source has no pairs; without kept terms all pairs are 0.  An empty table gives no row.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = ws.keep(counts, "counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("of"))
    kept = ws.keep(kept.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "kept")  # one row a kept term, with one entry a source at most
    sums = kept.select("lang", F.explode("of").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = ws.keep(groups, "groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("total"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    whole = lambda a, b: F.ceil(F.col(a) / b).cast("int")
    langs = ws.keep(langs.select("lang", "total", "terms", F.greatest(F.lit(1), whole("terms", TERMS)).alias("blocks"), whole("sources", GROUPS).alias("sides")), "langs")

    # A side's rows go to the tiles of that side and any other one; terms of the language go to all tiles of their block.
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    side = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("side")
    others = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    every = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda a: F.transform(F.sequence(a, F.col("sides") - 1), lambda b: F.struct(a.alias("left"), b.alias("right")))))).alias("t")
    to_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    columns = ["lang", "block", "left", "right", "kind", "side", "source", "term", "n", "terms"]
    none = F.lit(None).cast("string")
    tile_of = lambda df: df.withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")})
    one = langs.select("lang", "total", "terms", "sides", to_block).select("lang", "terms", "total", "block", every)
    one = one.select("lang", "block", "t.left", "t.right", F.lit(0).alias("kind"), F.lit(-1).alias("side"), none.alias("source"), none.alias("term"), F.col("total").alias("n"), "terms")
    each = groups.join(langs, "lang").select("lang", "source", "n", "terms", "sides", to_block, side).select("lang", "source", "n", "terms", "block", "side", others)
    each = tile_of(each).withColumns({"kind": F.lit(0), "term": none}).select(*columns)
    terms = kept.join(langs, "lang").select("lang", "term", "n", "terms", "sides", block).select("lang", "term", "n", "terms", "block", every)
    terms = terms.select("lang", "block", "t.left", "t.right", F.lit(1).alias("kind"), F.lit(-1).alias("side"), none.alias("source"), "term", "n", "terms")
    cells = kept.join(langs, "lang").select("lang", "term", "terms", "sides", block, F.explode("of").alias("x")).select("lang", "term", "terms", "block", "sides", "x.source", "x.n")
    cells = tile_of(cells.select("lang", "source", "term", "n", "terms", "block", side, others)).withColumn("kind", F.lit(2)).select(*columns)
    tiles = one.union(each).union(terms).union(cells).groupBy("lang", "block", "left", "right").applyInArrow(_tile, _PARTS)
    tiles = ws.keep(tiles, "tiles")

    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = tiles.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (coalesce(t.total, 0) + 2 * v.v) AS p,
    1 + 1000000000 * (k.n + 2)::HUGEINT // (v.total + 2 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
