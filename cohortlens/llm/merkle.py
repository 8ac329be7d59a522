"""Merkle manifest of a table: a tree for each source, a tree over the sources, and each row's authentication path.

Leaves are numbered in order within their source from counts of sorted ranges.  Trees are 16 wide and cut into aligned blocks of 16**3
nodes, so that a block is a node of the tier above, which is cut likewise, up to the root.  On the way up each block goes through a
treehash, whose stacks hold fewer than 16 unfinished nodes a level.  On the way down a traversal of each block keeps the
run of 16 siblings of every level and, one leaf a step, prepares the next run of every level, so that the path of the next leaf is always
ready from memory that grows with the number of levels.  The path from the block's node to the root, the same for all its leaves, is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, fold

WIDTH = 16
TIER = 3  # levels of a block
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined(*parts: str) -> str:
    """Lowercase hex sha256 of the parts one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """The nodes of one height over leaves that come one by one."""

    def __init__(self, height: int):
        self.open: list[list[str]] = [[] for _ in range(height)]
        self.done: list[str] = []

    def feed(self, leaf: str) -> None:
        for level in self.open:
            level.append(leaf)
            if len(level) < WIDTH:
                return
            leaf = joined(*level)
            level.clear()
        self.done.append(leaf)

    def close(self) -> list[str]:
        """All nodes, the last ones over shorter runs."""
        for h, level in enumerate(self.open, 1):
            if level:
                (self.open[h] if h < len(self.open) else self.done).append(joined(*level))
                level.clear()
        return self.done


def depth(n: int, tier: int = TIER) -> int:
    """Levels that a block of a tree with n nodes on this tier has: a whole tier's, or as many as leave one node."""
    return next((h for h in range(tier) if WIDTH**h >= n), tier)


def top_node(leaves: Sequence[str], height: int) -> str:
    t = Treehash(height)
    for leaf in leaves:
        t.feed(leaf)
    (node,) = t.close()
    return node


def paths(leaves: Sequence[str], height: int) -> Iterator[list[str]]:
    """For each leaf the siblings before and after it, joined, of every level from below."""
    under = [WIDTH ** (h + 1) for h in range(height)]  # leaves of a run of siblings
    runs, ahead = [], []
    for h, size in enumerate(under):
        first = Treehash(h)
        for leaf in leaves[:size]:
            first.feed(leaf)
        runs.append(first.close())
        ahead.append(Treehash(h))
    for i in range(len(leaves)):
        path = []
        for h, size in enumerate(under):
            if i and i % size == 0:
                runs[h], ahead[h] = ahead[h].close(), Treehash(h)
            at = i // (size // WIDTH) % WIDTH
            path += ["".join(runs[h][:at]), "".join(runs[h][at + 1 :])]
            if i + size < len(leaves):
                ahead[h].feed(leaves[i + size])
        yield path


def folded(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path lead to."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        leaf = joined(before, leaf, after)
    return leaf


def leaf_hash(*fields: Column) -> Column:
    """sha256 of the fields, each as its UTF-8 byte count, a colon and its text, or ``-`` if null."""
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _ranked(ws: Workspace, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds rank, from 0 in each tree, and n, the tree's number of rows, to rows that have the column tree.

    Rows are sorted by ranges of (tree, *order); counts of the ranges, of which each tree has as many as there are partitions
    at most, say how many rows come before.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # many equal rows still fall into several ranges
    keys = [F.col("tree"), *(F.col(c).asc_nulls_last() for c in order), F.col("_tie")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    rows = ws.keep(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    counts = rows.groupBy("tree", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    counts = counts.withColumn("_before", F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).withColumn("n", F.sum("_n").over(tree))
    counts = ws.keep(counts, f"{name}-counts")
    joined_ = rows.withColumn("_part", part).join(counts, ["tree", "_part"])
    return joined_.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_n", "_first", "_before")


_NODES = "tree string, rank bigint, n bigint, node string"


def _up(tier: int):
    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("rank")
        n, size = nodes["n"][0].as_py(), WIDTH**tier
        node = top_node(nodes["node"].to_pylist(), depth(n, tier))
        return pa.table({"tree": nodes["tree"][:1], "rank": [nodes["rank"][0].as_py() // size], "n": [-(-n // size)], "node": [node]})

    return run


_PATHS = "tree string, rank bigint, subroot string, root string, path array<string>"


def _repeated(v: str, n: int) -> pa.Array:
    return pa.array([v] * n, pa.string())


def _down(tier: int):
    """Paths of a block's nodes, from the path of the block's own node."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("rank")
        (up,) = above.to_pylist()
        n = nodes.num_rows
        own = [p + up["path"] for p in paths(nodes["node"].to_pylist(), depth(nodes["n"][0].as_py(), tier))]
        return pa.table({"tree": nodes["tree"], "rank": nodes["rank"], "subroot": _repeated(up["subroot"], n), "root": _repeated(up["root"], n), "path": pa.array(own, pa.list_(pa.string()))})

    return run


_PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _prove(tier: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("rank")
        (up,) = above.to_pylist()
        leaves, now = nodes["node"].to_pylist(), nodes["now"].to_pylist()
        proofs, roots = [], []
        for leaf, path in zip(now, paths(leaves, depth(nodes["n"][0].as_py(), tier)), strict=True):
            path += up["path"]
            proofs.append(joined(*path))
            roots.append(folded(leaf, path))
        n = len(leaves)
        return pa.table({"doc_id": nodes["doc_id"], "leaf": leaves, "subroot": _repeated(up["subroot"], n), "root": _repeated(up["root"], n), "proof_sha256": proofs, "folded_root": roots})

    return run


def _block(nodes: DataFrame, tier: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("rank", 4 * tier))


def _tiers(ws: Workspace, nodes: DataFrame, name: str, tier: int) -> list[DataFrame]:
    """nodes and the tiers above it; each tree of the last has one node."""
    tiers = [nodes]
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    while most > 1:
        up = _block(tiers[-1].select("tree", "rank", "n", "node"), tier).groupBy("tree", "block").applyInArrow(_up(tier), _NODES)
        tiers.append(ws.keep(up, f"{name}-{len(tiers)}"))
        most = -(-most // WIDTH**tier)
    return tiers


def _with_above(nodes: DataFrame, above: DataFrame, tier: int):
    """Each block with the row of its own node."""
    return _block(nodes, tier).groupBy("tree", "block").cogroup(above.withColumnRenamed("rank", "block").groupBy("tree", "block"))


def manifest(docs: DataFrame, tampered: Column | None = None, tier: int = TIER) -> DataFrame:
    """Leaf, roots and proof of each row of docs, and whether its text, as ``tampered`` gives it, still leads to the root.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row for each row of docs.  Any column may be null.  In a
    source rows stand in order of doc_id, null last, then of leaf; rows that are copies in all five columns are leaves of their own.  The
    null source stands first and is another than the empty one.  An empty table gives no row.  Other columns are ignored.

    tampered: the text at the time of checking, an expression over docs' columns; the text itself if None.
    tier: levels of a block; the result is the same for any.
    """
    ws = Workspace(docs.sparkSession, "merkle")
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    node = leaf_hash(*fields, F.col("text"))
    now = node if tampered is None else leaf_hash(*fields, tampered)
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # a key without nulls, null's first
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree.alias("tree"), node.alias("node"), now.alias("now"))
    leaves = _ranked(ws, ws.keep(leaves, "leaves"), ["doc_id", "node"], "ranked")
    trees = _tiers(ws, leaves, "trees", tier)
    subroots = _ranked(ws, trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"], "subroots")
    overall = _tiers(ws, subroots, "overall", tier)

    top = overall[-1].select("tree", "rank", F.lit("").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<string>").alias("path"))
    for i, nodes in reversed(list(enumerate(overall[:-1]))):
        top = ws.keep(_with_above(nodes, top, tier).applyInArrow(_down(tier), _PATHS), f"down-overall-{i}")
    top = subroots.join(top.drop("tree", "subroot"), "rank").select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("rank"), F.col("node").alias("subroot"), "root", "path")
    for i, nodes in reversed(list(enumerate(trees[1:-1], 1))):
        top = ws.keep(_with_above(nodes, top, tier).applyInArrow(_down(tier), _PATHS), f"down-trees-{i}")
    proofs = _with_above(leaves, top, tier).applyInArrow(_prove(tier), _PROOFS)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``; where 5 divides crc32 of the doc_id, the text's A-Z are lower-cased before checking."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, F.when(fold("doc_id", 5) == 0, F.translate("text", UPPER, SMALL)).otherwise(F.col("text")))


def _op12_sql(levels: int = 5) -> str:
    """Levels one after the other: enough for 16**levels rows a source and as many sources."""
    lower = f"translate(text, '{UPPER}', '{SMALL}')"
    told = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # Bit by bit: a step of -1 shifts, any other takes in a byte of the id's digits.
    steps = "flatten([[ascii((doc_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, len((doc_id::VARCHAR)) + 1)])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) ELSE xor(c >> 1, (c & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT)"
    out = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS now FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM d)",
        "s0 AS (SELECT source AS g, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM t0)",
    ]
    step = lambda a, b: f"{b} AS (SELECT g, pos, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {a} GROUP BY g, pos // 16))"
    run = lambda a, b: f"{b} AS (SELECT g, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {a} GROUP BY g, pos // 16)"
    for k in range(levels):
        out += [run(f"s{k}", f"rs{k}"), step(f"s{k}", f"s{k + 1}")]
    out.append(f"o0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, g AS source FROM s{levels})")
    for k in range(levels):
        out += [run(f"o{k}", f"ro{k}"), step(f"o{k}", f"o{k + 1}")]
    out.append("p AS (SELECT t0.*, o0.pos AS opos, o0.h AS subroot, '' AS sib, now AS f FROM t0 JOIN o0 ON t0.source IS NOT DISTINCT FROM o0.source)")
    last = "p"
    for kind, pos, match in (("s", "pos", "r.g IS NOT DISTINCT FROM p.source"), ("o", "opos", "r.g = 0")):
        for k in range(levels):
            at = f"(p.{pos} // {16**k})"
            before, after = f"array_to_string(r.hs[1:{at} % 16], '')", f"array_to_string(r.hs[{at} % 16 + 2:], '')"
            name = f"p{kind}{k}"
            out.append(f"{name} AS (SELECT p.doc_id, p.source, p.leaf, p.now, p.pos, p.opos, p.subroot, CASE WHEN r.n > 1 THEN p.sib || {before} || {after} ELSE p.sib END AS sib, CASE WHEN r.n > 1 THEN sha256({before} || p.f || {after}) ELSE p.f END AS f FROM {last} p JOIN r{kind}{k} r ON {match} AND r.run = {at} // 16)")
            last = name
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, o.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = o.h AS verified FROM {last}, o{levels} o"


OP12_SQL = _op12_sql()
