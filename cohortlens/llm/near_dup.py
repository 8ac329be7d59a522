"""MinHash near-duplicates by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles.  Its sketch is the ``k``
smallest of them.  Documents with equal sets form a class, and only each class's smallest doc_id is compared.

The estimate from the bottom k of both sketches' union drops a pair when it lies over 3.5 standard errors below the
threshold.  A pair that stays thus shares a known number of retained values, so by the prefix principle it
shares one among the rarest of each sketch (see ``_posted``).  Just these go to inverted lists, whose overlaps are candidates: no pair that the
estimate would let pass is missed, and a very common line or word pair makes no long list.  What stays is confirmed on the full sets.

Lists of at most ``most`` documents are expanded into pairs.  Longer ones hold large groups of near copies; see ``_hot_links``.
The components are those of all pairs, but for links that an estimate more than 3.5 standard errors too low would hide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Workspace, components, numbered

#: Documents and shingle hashes in a block of a large group, about.
BLOCK, BLOCK_VALUES = 256, 1 << 18
SKETCH = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, sketch array<bigint>"


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each chunk of rows, their sorted sets of shingle hashes; a text of fewer words than ``width`` is one shingle."""
    for _, _, raw, at, _ in K.chunks(column):
        buf = K.LOWER[raw]
        starts, ends, first = K.word_spans(buf, at, K.NOT_SPACE)
        words = K.span_hash(K.prefix_hash(buf), starts, ends)
        grams = K.ngram_hash(words, width)
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= width:
                out.append(np.unique(grams[lo : hi - width + 1]))
            elif hi > lo:
                out.append(K.join_hash(*words[lo:hi, None], np.full(1, 7, np.uint64)))
            else:
                out.append(grams[:0])
        yield out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> array; flipping the top bit makes signed order that of the unsigned hashes."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((flat ^ K.U64(1 << 63)).view(np.int64)))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), width):
                sums = [np.array([K.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64), np.array([K.mix(s ^ K.U64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0]), pa.array(sums[1]), _lists([s[:k] for s in sets])],
                    names=["doc_id", "n_shingles", "sig1", "sig2", "sketch"],
                )
                at += len(sets)

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), _lists(sets)], names=["rep", "shingles"])
                at += len(sets)

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    who, cols = [], []
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        who.append(row[hit][order])
        cols.append(at[hit][order])
    for lo in range(0, len(shared), columns):
        sides = []
        for n, row, col in zip((len(left), len(right)), who, cols, strict=True):
            i, j = np.searchsorted(col, [lo, lo + columns])
            m = np.zeros((n, min(columns, len(shared) - lo)), np.float32)
            m[row[i:j], col[i:j] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _linked(num: int, den: int):
    """Links between two blocks of documents, as edges (a, b) of a spanning forest.

    Side 0 is compared with side 1, and with itself where the other is not there.  ``reach`` of a document on side 1 must be at least that on side 0.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        inside = rows["bi"].iat[0] == rows["bj"].iat[0]
        left = rows[rows["side"] == 0]
        right = left if inside else rows[rows["side"] == 1]
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if left.empty or right.empty:
            return none
        common = _overlaps(left["shingles"].to_list(), right["shingles"].to_list()).astype(np.int64)
        x, y = left["rep"].to_numpy(), right["rep"].to_numpy()
        either = left["shingles"].map(len).to_numpy()[:, None] + right["shingles"].map(len).to_numpy()[None, :] - common
        link = (common * den >= either * num) & (x[:, None] != y[None, :]) & (right["reach"].to_numpy()[None, :] >= left["reach"].to_numpy()[:, None])
        rx, ry, far = x.copy(), y.copy(), np.iinfo(np.int64).max
        while True:
            lx = np.minimum(rx, np.where(link, ry[None, :], far).min(axis=1))
            ly = np.minimum(ry, np.where(link, lx[:, None], far).min(axis=0))
            if (lx == rx).all() and (ly == ry).all():
                break
            rx, ry = lx, ly
        out = pd.DataFrame({"a": np.concatenate([x, y]), "b": np.concatenate([rx, ry])})
        return out[out["a"] != out["b"]].drop_duplicates() if len(out) else none

    return run


def _blocks(ws: Workspace, name: str, left: DataFrame, right: DataFrame | None, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join what links within each group g: of left among themselves, or of left with right.

    A group is cut into blocks by a hash, and each two blocks are compared in one task: a task holds a bounded number
    of documents and values however large the group is, and no pair is a row.  Columns: g, rep, n, reach.
    """

    def cut(side: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        sizes = side.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
        sizes = ws.keep(sizes.select("g", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("t") / BLOCK_VALUES)).cast("int").alias("blocks")), f"{name}-{label}")
        return side.join(sizes, "g").withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), sizes

    mine, sizes = cut(left, "left")
    if right is None:
        both = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = both.select("g", F.least("home", "other").alias("bi"), F.greatest("home", "other").alias("bj"), (F.col("home") > F.col("other")).cast("int").alias("side"), "rep", "reach")
    else:
        theirs, others = cut(right, "right")
        over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # Blocks of the right are numbered from -1 downwards, so that none is compared with itself.
        a = mine.join(others.withColumnRenamed("blocks", "there"), "g").withColumn("other", over("there")).select("g", F.col("home").alias("bi"), (-1 - F.col("other")).alias("bj"), F.lit(0).alias("side"), "rep", "reach")
        b = theirs.join(sizes.withColumnRenamed("blocks", "there"), "g").withColumn("other", over("there")).select("g", F.col("other").alias("bi"), (-1 - F.col("home")).alias("bj"), F.lit(1).alias("side"), "rep", "reach")
        both = a.union(b)
    rows = both.join(sets, "rep")
    edges = rows.groupBy("g", "bi", "bj").applyInPandas(_linked(num, den), "a bigint, b bigint")
    return ws.keep(edges.distinct(), name)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (4, 5),
    k: int = 48,
    most: int = 32,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``threshold`` (numerator, denominator).

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), one row
    for each row of docs.  A text that is null or without words has no shingles and stands alone.  Rows
    that repeat a doc_id are one node, with the links of all its texts.  A null doc_id is never linked and is kept.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = numbered(ws, texts)
    if nodes is None:
        return _near(ws, texts, None, width, threshold, k, most)
    # Each text of its own is a node, and those of one doc_id are joined.
    rows = texts.withColumn("of", F.xxhash64("text")).join(nodes, ["doc_id", "of"], "left").select(F.col("node").alias("doc_id"), "text")
    same = nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    done = _near(ws, rows, same, width, threshold, k, most).select(F.col("doc_id").alias("node"), "n_shingles", "component_id")
    ids = nodes.select("doc_id", "node")
    named = done.join(ids, "node", "left").join(ids.select(F.col("doc_id").alias("root"), F.col("node").alias("component_id")), "component_id", "left")
    named = ws.keep(named.select("doc_id", "n_shingles", "root"), "named")
    out = named.drop("root").join(named.groupBy("doc_id").agg(F.min("root").alias("component_id")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _near(ws: Workspace, texts: DataFrame, same: DataFrame | None, width: int, threshold: tuple[int, int], k: int, most: int) -> DataFrame:
    """``near_duplicates`` of texts in which a doc_id has one text; ``same`` are further links (a, b)."""
    num, den = threshold
    every = ws.keep(texts.mapInArrow(_sketches(width, k), SKETCH), "sketches")

    # Classes of equal sets; the class's smallest doc_id stands for it.
    key = ["n_shingles", "sig1", "sig2"]
    some = every.filter("n_shingles > 0 and doc_id is not null")
    classes = ws.keep(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = ws.keep(some.join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates([*key, "doc_id"]), "reps")

    bound = _bound(num / den, k)
    listed = _posted(ws, reps, num, den, k, bound)

    def near_size(a: str, b: str):
        return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)

    def all_pairs(lists: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, of the documents in each list whose sizes allow the similarity."""
        a = lists.select("v", F.col("rep").alias("a"), F.col("n").alias("na"))
        b = lists.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
        return a.join(b, "v").filter((F.col("a") < F.col("b")) & near_size("na", "nb")).select("a", "b")

    sketches = reps.select(F.col("doc_id").alias("rep"), "sketch").dropDuplicates(["rep"])
    def plausible(pairs: DataFrame, least: float = bound) -> DataFrame:
        """Pairs whose estimate from the bottom k of the sketches' union is at least ``least``."""
        both = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        bottom = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        common = F.size(F.array_intersect(F.array_intersect(bottom, F.col("sa")), F.col("sb")))
        return both.filter(common >= F.size(bottom) * F.lit(least) - 1e-9).select("a", "b")

    def full_sets(ids: DataFrame) -> DataFrame:
        """The whole sets of some documents, made anew from their texts."""
        chosen = texts.join(ws.keep(ids.select(F.col("rep").alias("doc_id")).distinct(), "sets-ids"), "doc_id", "left_semi")
        return ws.keep(chosen.mapInArrow(_full_sets(width), "rep bigint, shingles array<bigint>"), "sets").dropDuplicates(["rep"])

    def distances(pairs: DataFrame) -> DataFrame:
        """a, b, whether they link, and their Jaccard distance."""
        a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        either = F.size("sa") + F.size("sb") - common
        return pairs.join(b, "b").join(a, "a").select("a", "b", (common * den >= either * num).alias("linked"), (1 - common / either).alias("far"))

    def measured(pairs: DataFrame) -> DataFrame:
        """Links among pairs."""
        return distances(pairs).filter("linked").select("a", "b")

    def once(lists: DataFrame, name: str) -> DataFrame:
        """One of the lists of each content: those of a group of near copies are mostly equal."""
        key = lists.groupBy("v").agg(F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("h"), F.count(F.lit(1)).alias("c"))
        one = ws.keep(key.groupBy("h", "c").agg(F.min("v").alias("v")).select("v"), name)
        return lists.join(one, "v", "left_semi")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("rep"))

    cold = once(listed.filter(F.col("size") <= most), "cold-once")
    candidates = ws.keep(plausible(all_pairs(cold).distinct()), "cold")
    hot = listed.filter(F.col("size") > most).select("v", "rep", "n")
    any_hot = not hot.isEmpty()
    sets = full_sets(ends(candidates).union(hot.select("rep")) if any_hot else ends(candidates))
    links = ws.keep(measured(candidates), "links")
    ws.drop("cold-once", "cold")
    if any_hot:
        links = links.union(_hot_links(ws, hot, links, sets, all_pairs, plausible, once, distances, measured, threshold, k, most))

    if same is not None:
        theirs = every.join(same.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id").join(classes, key)
        links = links.union(same).union(theirs.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(ws, links)
    roots = ws.keep(roots, "roots")
    ws.drop("reps", "listed", "links", "sets-ids", "sets", "seen", "rest-links", "inside", "across")
    # Only classes of several documents or with a link need a lookup.
    moved = classes.select(*key, "rep", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left").filter("copies > 1 or component is not null").select(*key, F.coalesce("component", "rep").alias("component"))
    moved = ws.keep(moved, "moved")
    out = every.select("doc_id", *key).join(moved, key, "left")
    found = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def _bound(least: float, k: int) -> float:
    """3.5 standard errors of an estimate from k values below ``least``."""
    return least - 3.5 * (least * (1 - least) / k) ** 0.5


def _posted(ws: Workspace, reps: DataFrame, num: int, den: int, k: int, bound: float) -> DataFrame:
    """Inverted lists (v, rep, n, size) of each sketch's rarest values, as many as a pair that passes the estimate needs to meet.

    Such a pair shares at least ``bound`` of a sketch of s values.  Ordered by rarity, it then shares one among the first
    s - ceil(bound * s) + 1 of both.  Where no union with a similar set fills a sketch, the threshold itself is the bound.
    A value that no other sketch holds takes a place among the first but needs no list.
    """
    flat = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    sizes = ws.keep(flat.groupBy("v").count().filter("count > 1"), "sizes")
    held = flat.join(sizes, "v").groupBy("rep", "n", "s").agg(F.array_sort(F.collect_list(F.struct("count", "v"))).alias("vals"))
    share = F.when(F.col("n") * den <= k * num, F.lit(num / den)).otherwise(F.lit(bound))
    take = F.size("vals") + 1 - F.ceil(share * F.col("s") - 1e-9).cast("int")
    posts = held.withColumn("take", take).filter("take > 0").select("rep", "n", F.explode(F.slice("vals", F.lit(1), F.col("take"))).alias("x"))
    posts = ws.keep(posts.select("rep", "n", "x.v"), "posts")
    lengths = ws.keep(posts.groupBy("v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "lengths")
    listed = ws.keep(posts.join(lengths, "v").select("v", "rep", "n", "size"), "listed")
    ws.drop("sizes", "posts", "lengths")
    return listed


def _hot_links(ws, hot, links, sets, all_pairs, plausible, once, distances, measured, threshold, k, most):
    """Links among documents that share values of long lists, enough of them for the components.

    A list's leader is its document with most values in long lists, as the least edited copy has.  Its followers, which
    link with it, leave the lists: one comparison for each copy of a large group.  The rest are compared among themselves in
    the lists, as pairs where these are short now, else block by block.  A follower is within gap = 1 - threshold of its
    leader, so a document that links with it is within twice that of the leader, and the leader of one that is itself a follower
    within three times: such documents, if not yet in its component, are compared block by block with the
    followers that can be near enough.  A value that a follower shares brings its whole group to the document.
    """
    num, den = threshold
    gap = 1 - num / den
    many = hot.groupBy("rep").agg(F.count(F.lit(1)).alias("many"), F.slice(F.array_sort(F.collect_list("v")), 1, 4).alias("few"))
    few = ws.keep(many.select("rep", "many", F.explode("few").alias("v")), "few")
    lead = ws.keep(few.groupBy("v").agg(F.min_by("rep", F.struct(-F.col("many"), F.col("rep"))).alias("a"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > most // 4).select("v", "a"), "lead")
    led = few.join(lead, "v").filter("rep <> a").groupBy("rep").agg(F.min("a").alias("a"))
    seen = ws.keep(distances(led.select("a", F.col("rep").alias("b"))), "seen")
    follows = seen.filter("linked").select("a", "b", "far")
    leaders = ws.keep(follows.select(F.col("a").alias("rep")).distinct(), "leaders")
    quiet = follows.select(F.col("b").alias("rep")).join(leaders, "rep", "left_anti").distinct()
    rest = ws.keep(hot.join(quiet, "rep", "left_anti"), "rest")
    links = links.union(follows.select("a", "b"))

    sizes = ws.keep(rest.groupBy("v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "rest-sizes")
    lists = ws.keep(rest.join(sizes, "v"), "rest-lists")
    short = once(lists.filter(F.col("size") <= most), "rest-once")
    out = follows.select("a", "b").union(ws.keep(measured(plausible(all_pairs(short).distinct())), "rest-links"))
    long_ = once(lists.filter(F.col("size") > most), "rest-long").select(F.col("v").alias("g"), "rep", "n", F.lit(0.0).alias("reach"))
    inside = _blocks(ws, "inside", long_, None, sets, num, den)
    out = out.union(inside)
    ws.drop("few", "lead", "rest-sizes", "rest-lists", "rest-once", "rest-long", "inside-left")
    if leaders.isEmpty():
        ws.drop("rest", "leaders")
        return out

    roots = ws.keep(components(ws, links.union(out), "so-far"), "so-far")

    def apart(pairs):
        """Pairs in different components so far."""
        both = pairs.join(roots.select(F.col("node").alias("a"), F.col("component").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("component").alias("rb")), "b", "left")
        return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)

    led = rest.join(leaders, "rep", "left_semi").select("v", F.col("rep").alias("a"))
    groups = led.union(hot.join(follows.select("a", F.col("b").alias("rep")), "rep").select("v", "a")).distinct()
    groups = ws.keep(groups, "groups")
    near = groups.join(rest.select("v", F.col("rep").alias("b")), "v").filter("a <> b").select("a", "b").distinct()
    near = plausible(apart(near), _bound(1 - 2 * gap, k))
    once_groups = once(groups.withColumnRenamed("a", "rep"), "groups-once")
    rivals = once_groups.select("v", F.col("rep").alias("a")).join(once_groups.select("v", F.col("rep").alias("b")), "v").filter("a < b").select("a", "b").distinct()
    rivals = plausible(apart(rivals), _bound(1 - 3 * gap, k))
    near = ws.keep(distances(near).select("a", "b", F.col("far").alias("d")), "near-far")
    rivals = ws.keep(distances(rivals).filter(F.col("far") <= 3 * gap + 1e-9).select("a", "b", F.col("far").alias("d")), "rivals-far")
    # By the triangle inequality, x of leader a links with y only if x is no nearer to a than need: the distance of a and y
    # less gap, which is at least that of both leaders less the one of y and its own.
    known = near.select("a", F.col("b").alias("y"), (F.col("d") - gap).alias("need"))
    theirs = rivals.join(follows.select(F.col("a").alias("b"), F.col("b").alias("y"), "far"), "b").select("a", "y", (F.col("d") - F.col("far") - gap).alias("need"))
    known = known.union(theirs).filter(F.col("need") <= gap + 1e-9).groupBy("a", "y").agg((F.max("need") - 1e-9).alias("need"))
    of = hot.groupBy("rep").agg(F.first("n").alias("n"))
    known = ws.keep(known.withColumnRenamed("y", "rep").join(of, "rep").select(F.col("a").alias("g"), "rep", "n", F.col("need").alias("reach")), "known")
    followers = follows.join(of.withColumnRenamed("rep", "b"), "b").join(known.select(F.col("g").alias("a")).distinct(), "a", "left_semi")
    followers = ws.keep(followers.select(F.col("a").alias("g"), F.col("b").alias("rep"), "n", F.col("far").alias("reach")), "followers")
    across = _blocks(ws, "across", known, followers, sets, num, den)
    ws.drop("rest", "leaders", "so-far", "groups", "groups-once", "near-far", "rivals-far", "known", "followers", "across-left", "across-right")
    return out.union(across)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all ``documents`` by sets of 2-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN root USING (doc_id)
"""
