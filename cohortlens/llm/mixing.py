"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents queue in an order shuffled by a hash.  A document's virtual finish time is its source's
words up to and with it, divided by the source's target; where a target is above the source's size the queue is
served again, up to three times.  Serving all queues by virtual finish time until the total budget is spent gives each source
its share, to within about one document.

Both running sums are two-level, so that no task ranks a whole source or the whole table: hash buckets of a source
are totalled and summed over first, then each bucket within; likewise bands of virtual time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

TIMES = 3
BUCKETS = 4096
BANDS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size), one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target is the source's weighted share of all sizes, stopped at
    TIMES times its own size; what that frees is shared again by weight until none is above.  That
    fixed point is least(cap, level * weight), its level found from running sums over sources by cap / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * TIMES).cast("double"))
    w = w.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    w = w.withColumn("capped", F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    w = w.withColumn("open", F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("capped")) / F.col("open")
    w = w.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(Window.partitionBy()))
    return w.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Which documents, and how often, make up a mix of as many words as docs has.

    Returns doc_id, size, source_size, target, taken, one row for each row of docs.  A null or empty text has size 0 and is never
    taken; a null source is a source.  Rows that repeat a doc_id queue side by side in order of size.  Other columns are ignored.
    The order is md5(seed:doc_id), so that reruns agree.
    """
    ws = Workspace(docs.sparkSession, "mix")
    ticket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 14), 16, 10).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(word_count(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("size"), ticket.alias("ticket"))
    rows = rows.withColumn("queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # a key without nulls
    rows = ws.keep(rows.withColumn("bucket", F.shiftright("ticket", 44).cast("int")), "rows")  # 12 of 56 bits

    spans = rows.groupBy("queue", "bucket").agg(F.sum("size").alias("held"), F.first("source").alias("source"))
    spans = ws.keep(spans.withColumn("before", F.sum("held").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("held")), "spans")
    sources = targets(spans.groupBy("source").agg(F.sum("held").alias("source_size")))
    sources = ws.keep(sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("queue"), "source_size", "target"), "sources")
    spans = ws.keep(spans.join(sources, "queue").select("queue", "bucket", "before", "source_size", "target"), "queues")

    inside = Window.partitionBy("queue", "bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(inside))
    queued = ws.keep(summed.join(spans, ["queue", "bucket"]).withColumn("upto", F.col("upto") + F.col("before")).drop("before", "bucket", "queue"), "queued")

    # Every serving of a document that could come before the budget is spent; virtual time 1 is where the targets are reached.
    served = queued.filter("size > 0 and target > 0").select("doc_id", "source", "size", "ticket", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(TIMES - 1))).alias("turn"))
    finish = (F.col("turn") * F.col("source_size") + F.col("upto")) / F.col("target")
    served = served.withColumn("finish", finish).filter("upto - size + turn * source_size <= target")
    served = served.withColumn("band", F.least(F.floor(F.col("finish") * BANDS), F.lit(2 * BANDS)).cast("int"))
    bands = served.groupBy("band").agg(F.sum("size").alias("held"))
    bands = bands.withColumn("before", F.sum("held").over(Window.orderBy("band")) - F.col("held"))
    bands = ws.keep(bands, "bands")  # at most 2 * BANDS + 1 rows
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    cut = bands.filter(F.col("before") < budget).orderBy(F.desc("band")).first()
    if cut is None:
        return queued.select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    # In the last band that begins within the budget, documents are taken in order while their words fit.
    last = served.filter(F.col("band") == cut["band"])
    place = Window.orderBy("finish", F.col("source").isNull(), "source", "ticket", "doc_id", "turn", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = last.withColumn("sum", F.sum("size").over(place) + F.lit(cut["before"])).filter(F.col("sum") <= budget)
    edge = edge.select(F.max(F.struct("finish", F.col("source").isNull().alias("n"), "source", "ticket", "doc_id", "turn", "size")).alias("e")).first()["e"]
    turn = [F.struct(((F.lit(i) * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish"), F.col("source").isNull().alias("n"), "source", "ticket", "doc_id", F.lit(i).alias("turn"), "size") for i in range(TIMES)]
    whole = [F.floor(t["finish"] * BANDS) < cut["band"] for t in turn]
    begun = [F.col("upto") - F.col("size") + F.lit(i) * F.col("source_size") <= F.col("target") for i in range(TIMES)]
    if edge is not None:
        fields = {"finish": "double", "n": "boolean", "source": "string", "ticket": "bigint", "doc_id": "bigint", "turn": "int", "size": "bigint"}
        bound = F.struct(*(F.lit(edge[k]).cast(kind).alias(k) for k, kind in fields.items()))
        whole = [w | (t <= bound) for w, t in zip(whole, turn, strict=True)]
    times = sum((F.coalesce(w & g, F.lit(False)).cast("bigint") for w, g in zip(whole, begun, strict=True)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), times * F.col("size")).otherwise(F.lit(0))
    return queued.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def op9_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT AS ticket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
v AS (
  SELECT *, sum(cap) OVER r - cap AS capped, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((total - capped) / open) FILTER ((total - capped) / open * weight <= cap) AS level FROM v),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM v, l),
q AS (
  SELECT d.doc_id, d.source, d.size, d.ticket, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ticket, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT *, (turn * source_size + upto)::DOUBLE / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0 AND upto - size + turn * source_size <= target),
placed AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, ticket, doc_id, turn, size ROWS UNBOUNDED PRECEDING) AS upto_all FROM served),
taken AS (SELECT doc_id, size, sum(size) AS taken FROM placed WHERE upto_all <= (SELECT sum(size) FROM d) GROUP BY doc_id, size)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN taken ON q.doc_id = taken.doc_id AND q.size = taken.size
"""
