"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A polytope hash of a unit vector is the signed coordinate of largest size after a pseudo-random
rotation (three rounds of random signs and a Walsh-Hadamard transform; Andoni et al., 2015).  A table's code
joins ``polytopes`` of them.  Multiprobe: each vector also takes the second largest coordinate of each
polytope, in all combinations, and two vectors meet where any of their codes agree.  Every pair that meets is
verified by its cosine in double precision.

Equal vectors of one label form a class that is compared once.  A bucket of over ``most`` vectors is not expanded
into rows of pairs: it is cut into blocks, a task compares two blocks, counts each vector's links and
returns a spanning forest of them.  A pair that meets in several long buckets counts in that of the smallest code alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Workspace, components

BLOCK = 256
#: Tables by polytopes in a code, relative to two: a code of more agrees less often.
MORE_TABLES = {2: 1.0, 3: 1.5, 4: 2.0, 5: 2.7, 6: 3.7}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    x = x.copy()
    while h < width:
        v = x.reshape(n, width // (2 * h), 2, h)
        a, b = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
        v[:, :, 0], v[:, :, 1] = a, b
        h *= 2
    return x / np.sqrt(width)


def codes(x: np.ndarray, tables: int, polytopes: int, seed: int) -> np.ndarray:
    """rows x (tables * 2**polytopes) codes of unit vectors; a code holds its table's number."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = []
    for t in range(tables):
        choices = []
        for p in range(polytopes):
            rng = np.random.default_rng([seed, width, t, p])
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            sign = np.take_along_axis(y, two, axis=1) < 0
            choices.append((2 * two + sign).astype(np.uint64))
        code = np.full((len(x), 1), t + 1, np.uint64)
        for c in choices:
            code = np.concatenate([code * K.U64(2 * width) + c[:, i : i + 1] for i in (0, 1)], axis=1)
        out.append(code)
    return np.concatenate(out, axis=1)


def _hash(tables: int, polytopes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            to = np.asarray(lists.offsets).astype(np.int64)
            flat, dims = np.asarray(lists.flatten(), float), np.diff(to)
            to = to - to[0]
            for d in np.unique(dims).tolist():
                for part in np.array_split(np.flatnonzero(dims == d), max(1, (dims == d).sum() // 4096)):
                    x = flat[to[part][:, None] + np.arange(d)]
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    mine = K.join_hash(batch.column(1).take(pa.array(part)).to_numpy().view(np.uint64), np.full(len(part), d, np.uint64))[:, None]
                    found = K.mix(codes(x, tables, polytopes, seed) + mine)
                    n = found.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(found.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), lists], names=["rep", "codes"])

    return run


def _compare(least: float):
    """Links between two blocks of a bucket: counts for each vector, and edges of a spanning forest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        code = rows["code"].iat[0]
        for _, part in rows.groupby(rows["unit"].map(len), sort=False):
            x = np.stack(part["unit"].to_numpy())
            ids, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
            home, left, right = part["home"].to_numpy(), part["bi"].iat[0], part["bj"].iat[0]
            linked = x @ x.T >= least
            np.fill_diagonal(linked, False)
            if left != right:
                linked &= home[:, None] != home[None, :]
            hot = part["hot"].to_numpy()
            # A pair counts in the long bucket of the smallest code that holds both.
            who = np.repeat(np.arange(len(part)), part["hot"].map(len).to_numpy())
            held = np.concatenate(part["hot"].to_numpy()).astype(np.int64)
            who, held = who[held < code], held[held < code]
            names, which, n = np.unique(held, return_inverse=True, return_counts=True)
            if (n > 1).any():
                column = np.cumsum(n > 1) - 1
                inside = np.zeros((len(part), column[-1] + 1), np.float32)
                inside[who[n[which] > 1], column[which[n[which] > 1]]] = 1
                linked &= inside @ inside.T == 0
            root = ids.copy()
            while True:
                low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (low == root).all():
                    break
                root = low
            out.append(pd.DataFrame({"rep": ids, "links": linked @ copies, "root": root}))
        out = pd.concat(out)
        return out[out["links"] > 0]

    return run


def embedding_duplicates(
    vectors: DataFrame, least: float = 0.93, tables: int = 6, most: int = 64, seed: int = 11
) -> DataFrame:
    """Links between vectors of one label whose cosine is at least ``least``.

    Returns vec_id, n_links, component_id, kept, one row for each row of vectors.  A null label, a vector that is null, empty, zero
    or holds null or non-finite components, and a null vec_id link with nothing; vectors of different lengths never link.
    Rows that repeat a vec_id with an equal vector are copies that link with each other.  Other columns are ignored.

    The number of polytopes in a code follows the largest label's size, so that a bucket of unrelated vectors holds a few of them;
    the number of tables grows with it, so that a pair's chance to meet in one stays.  ``tables`` is that of two polytopes.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "embedding")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = rows.withColumn("ok", ok)
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64("embedding", F.lit(1), "label")))
    keyed = ws.keep(rows.select("vec_id", "k1", "k2"), "keys")
    valid = rows.filter("ok")
    classes = ws.keep(valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    unit = F.transform("embedding", lambda x: x / F.array_max(F.transform("embedding", lambda y: F.abs(y))))
    norm = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x))
    reps = valid.withColumnRenamed("vec_id", "rep").join(classes, ["k1", "k2", "rep"]).dropDuplicates(["k1", "k2"])
    reps = reps.withColumn("unit", unit).withColumn("unit", F.transform("unit", lambda x: x / norm))
    reps = ws.keep(reps.select("rep", "copies", "unit", F.xxhash64("label").alias("group"), F.size("unit").alias("dim")), "reps")

    largest = reps.groupBy("group", "dim").count().agg(F.max(F.struct("count", "dim")).alias("m")).first()["m"]
    n, dim = (largest["count"], largest["dim"]) if largest else (1, 2)
    per_polytope = 2 / (2 * max(2, 1 << (dim - 1).bit_length()))  # chance that both probes of a polytope agree, roughly doubled
    polytopes = 2
    while n * (2 * per_polytope) ** polytopes > 4 * most and polytopes < 6:
        polytopes += 1
    tables = math.ceil(tables * MORE_TABLES[polytopes])
    coded = reps.select("rep", "group", "unit").mapInArrow(_hash(tables, polytopes, seed), "rep bigint, codes array<bigint>")
    flat = ws.keep(coded.select("rep", F.explode(F.array_distinct("codes")).alias("code")), "codes")
    sizes = ws.keep(flat.groupBy("code").count().filter("count > 1"), "sizes")
    listed = ws.keep(flat.join(sizes, "code").select("code", "rep", "count"), "listed")

    # Short buckets: pairs as rows.
    short = listed.filter(F.col("count") <= most).select("code", "rep")
    pairs = short.select("code", F.col("rep").alias("a")).join(short.select("code", F.col("rep").alias("b")), "code").filter("a < b").select("a", "b").distinct()
    units = reps.select("rep", "unit", "copies")
    both = pairs.join(units.withColumnsRenamed({"rep": "a", "unit": "ua", "copies": "ca"}), "a").join(units.withColumnsRenamed({"rep": "b", "unit": "ub", "copies": "cb"}), "b")
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = both.filter(dot >= least).select("a", "b", "ca", "cb")

    # Long buckets: blocks against blocks.
    long_ = listed.filter(F.col("count") > most)
    hot = ws.keep(long_.groupBy("rep").agg(F.collect_list("code").alias("hot")), "hot")  # at most tables * 2**polytopes codes each
    found = found.join(hot.withColumnsRenamed({"rep": "a", "hot": "ha"}), "a", "left").join(hot.withColumnsRenamed({"rep": "b", "hot": "hb"}), "b", "left")
    found = found.filter(~F.coalesce(F.arrays_overlap("ha", "hb"), F.lit(False))).select("a", "b", "ca", "cb")
    found = ws.keep(found, "found")
    counts = found.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("cb").alias("links")), F.struct(F.col("b").alias("rep"), F.col("ca").alias("links")))).alias("x")).select("x.*")
    edges = found.select("a", "b")
    if not hot.isEmpty():
        members = long_.join(hot, "rep").join(units, "rep")
        members = members.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.select("code", F.least("home", "other").alias("bi"), F.greatest("home", "other").alias("bj"), "home", "rep", "copies", "unit", "hot")
        blocks = members.groupBy("code", "bi", "bj").applyInPandas(_compare(least), "rep bigint, links bigint, root bigint")
        blocks = ws.keep(blocks, "blocks")
        counts = counts.union(blocks.select("rep", "links"))
        edges = edges.union(blocks.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))

    counts = ws.keep(counts.groupBy("rep").agg(F.sum("links").alias("links")), "counts")
    roots = ws.keep(components(ws, edges), "roots").withColumnRenamed("node", "rep")
    known = classes.join(counts, "rep", "left").join(roots, "rep", "left").filter("copies > 1 or links > 0")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    known = ws.keep(known, "known")
    out = keyed.join(known, ["k1", "k2"], "left")
    component = F.coalesce(F.col("component"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` at a cosine of 0.93."""
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM root LEFT JOIN n USING (vec_id)
"""
