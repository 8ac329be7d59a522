"""What the operators share: written intermediate tables, bounded samples and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own where it is unset, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


class Workspace:
    """Tables of one operator call, written as Parquet in the shared folder.

    Writing cuts the lineage: a lost executor costs one stage and not the chain before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/cohortlens-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(ws: Workspace, texts: DataFrame, always: bool = False) -> DataFrame | None:
    """A number for each different (doc_id, text) of texts, in order of doc_id, where a doc_id has several texts or ``always``; else None.

    Columns: doc_id, of (a hash of the text) and node.  Null ids get none.
    """
    rows = texts.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("of"))
    several = rows.groupBy("doc_id").agg((F.min("of") < F.max("of")).alias("several")).filter("several")
    if not always and several.isEmpty():
        return None
    return ws.keep(rows.distinct().orderBy("doc_id", "of").withColumn("node", F.monotonically_increasing_id()), "nodes")


def fold(column: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def bounded_sample(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, of which there are few (languages, classes), taken by a hash of ``order``; whole groups where they are smaller.

    A threshold on the hash, from counts of each group, first leaves about 1.2 times the bound,
    so that the exact cut ranks a bounded number of rows in a task however large the group is.
    """
    ticket = F.pmod(F.xxhash64(*order), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    few = df.withColumn("_ticket", ticket).join(F.broadcast(sizes), by, "inner")
    few = few.filter(F.col("_ticket") * F.col("_size") <= F.lit(most * 1.2 + 50)).drop("_size")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_ticket", *order))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank", "_ticket")


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): (node, component), component being the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014).  Each is an aggregation with
    partial sums and an equi-join that AQE can split, so a node with very many neighbours is no hot task;
    each result is written, and a round that changes nothing ends the loop.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = ws.keep(e, f"{name}-0")
    state, i = None, 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low{i}")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ws.keep(large, f"{name}-large{i}")
        least = ws.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least{i}")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = ws.keep(small.filter("u <> v").distinct(), f"{name}-{i + 1}")
        now = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        ws.drop(f"{name}-low{i}", f"{name}-large{i}", f"{name}-least{i}", f"{name}-{i}")
        e, i = new, i + 1
        if state == now:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
