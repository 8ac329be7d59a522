"""Respondent-level views over the driver tables, and the same in SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, item, x): each user's mean value of each event type."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("item")).agg(F.avg("value").alias("x"))


def ratings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings whose values are added in the order of their events, as one thread reads them; the last digit of a mean then never depends on how tasks met."""
    values = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda e: e["value"]), lambda v: v.isNotNull())
    told = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("item")).agg(values.alias("v"))
    return told.select("id", "item", F.when(F.size("v") > 0, total(F.col("v")) / F.size("v")).alias("x"))


def to_features(long: DataFrame, by: str = "id", item: str = "item", value: str = "x") -> DataFrame:
    """(id, f): values in order of item.  Items of a questionnaire are few, so a row's array is small."""
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(item, value))), lambda s: s[value]).alias("f"))


def to_places(long: DataFrame) -> DataFrame:
    """(id, f): to_features with a place for each item that anybody has, null for those who lack it."""
    items = long.agg(F.array_sort(F.collect_set("item")).alias("items"))  # one row
    told = long.filter("item is not null").groupBy("id").agg(F.collect_list(F.struct("item", "x")).alias("s"))
    at = lambda i: F.get(F.filter("s", lambda e: e["item"] == i), F.lit(0))["x"]
    return told.crossJoin(F.broadcast(items)).select("id", F.transform("items", at).alias("f"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, spend, balance, orders, segment, nation): customers with their orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("orders"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return c.select(F.col("c_custkey").alias("id"), "spend", F.col("c_acctbal").alias("balance"), "orders", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))


#: Lines of a task that works on orders or customers, so that its memory does not grow with the tables.
LINES = 200_000

#: Parts that are sent whole to every task; more lie by key, as their lines then do.
PARTS_SENT = 1_000_000


def _bought(spark: SparkSession, sf_dir: str, of: str) -> tuple[DataFrame, int]:
    """(o_orderkey, o_custkey, item, l_extendedprice), lying by order, and in how many partitions; of: the part's column that is the item."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    n = max(1, -(-li.count() // LINES))
    lines, parts = li.select("l_orderkey", "l_partkey", "l_extendedprice"), p.select("p_partkey", F.col(of).alias("item"))
    if p.count() <= PARTS_SENT:
        parts = F.broadcast(parts)
    else:
        lines, parts = lines.repartition(n, "l_partkey"), parts.repartition(n, "p_partkey").hint("merge")
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "item", "l_extendedprice").repartition(n, "l_orderkey")
    return lines.join(o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")), n


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(respondent_id, set, item, choice): an order's part types by price, dearest best and cheapest worst; sets of three or more.

    Lines are dealt by order once, in as many partitions as there are lines for; grouping and ranking stay where they lie.
    """
    return dealt_choices(spark, sf_dir)[0]


def dealt_choices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """choices, and in how many partitions they lie."""
    lines, n = _bought(spark, sf_dir, "p_type")
    shown = lines.groupBy(F.col("o_custkey").alias("respondent_id"), F.col("o_orderkey").alias("set"), "item").agg(F.max("l_extendedprice").alias("price"))
    by = Window.partitionBy("respondent_id", "set")
    ranked = shown.withColumn("top", F.row_number().over(by.orderBy(F.desc("price"), "item"))).withColumn("n", F.count(F.lit(1)).over(by))
    choice = F.when(F.col("top") == 1, "best").when(F.col("top") == F.col("n"), "worst").otherwise("")
    return ranked.filter("n >= 3").select("respondent_id", "set", "item", choice.alias("choice")), n


def taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, item, x): what each customer spent on each part type, lying by customer."""
    lines, n = _bought(spark, sf_dir, "p_brand")
    return lines.select(F.col("o_custkey").alias("id"), "item", "l_extendedprice").repartition(n, "id").groupBy("id", "item").agg(F.sum("l_extendedprice").alias("x"))


RATINGS = "r AS (SELECT user_id AS id, event_type AS item, avg(value) AS x FROM events GROUP BY ALL)"
PROFILE = """p AS (SELECT c_custkey AS id, avg(o_totalprice) AS spend, any_value(c_acctbal) AS balance, count(*) AS orders,
  any_value(c_mktsegment) AS segment, any_value(c_nationkey)::BIGINT AS nation FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"""
CHOICES = """bw AS (SELECT o_custkey AS respondent_id, o_orderkey AS set, p_type AS item, CASE WHEN top = 1 THEN 'best' WHEN top = n THEN 'worst' ELSE '' END AS choice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY price DESC, p_type) AS top, count(*) OVER (PARTITION BY o_custkey, o_orderkey) AS n
  FROM (SELECT o_custkey, o_orderkey, p_type, max(l_extendedprice) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE n >= 3)"""
TASTE = """taste AS (SELECT o_custkey AS id, p_brand AS item, sum(l_extendedprice) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
#: Range-scaled ratings, three fixed centres (the users of the three smallest ids) and each user's distances and segment.
SCALED = RATINGS + """,
s AS (SELECT id, item, (x - min(x) OVER (PARTITION BY item)) / CASE WHEN max(x) OVER (PARTITION BY item) > min(x) OVER (PARTITION BY item)
  THEN max(x) OVER (PARTITION BY item) - min(x) OVER (PARTITION BY item) ELSE 1 END AS x FROM r)"""


def assigned_sql(k: int, out: str = "a") -> str:
    return f"""{out}_c AS (SELECT dense_rank() OVER (ORDER BY id) - 1 AS segment, item, x FROM s WHERE id IN (SELECT DISTINCT id FROM s ORDER BY id LIMIT {k})),
{out}_d AS (SELECT s.id, c.segment, sum((s.x - c.x) * (s.x - c.x)) AS d2 FROM s JOIN {out}_c c USING (item) GROUP BY ALL),
{out} AS (SELECT id, segment, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, segment) AS n FROM {out}_d) WHERE n = 1)"""
