"""Queries: scaling, imputation, coding, Gower's distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import manhattan
from ..operators import gower, joins, scaling, views
from ..sources import ingest
from .registry import query


def _six(df: DataFrame) -> DataFrame:
    """Doubles at six digits, so that two engines' sums agree."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(f"WITH {views.SCALED} SELECT id, item, round(x, 6) AS x FROM s")
def scale_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scaling.scale(views.ratings(spark, sf_dir), "range"))


@query(f"""WITH {views.RATINGS}, p AS (SELECT item, avg(x) AS m, stddev_pop(x) AS s FROM r GROUP BY item)
SELECT id, item, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS x FROM r JOIN p USING (item)""")
def scale_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scaling.scale(views.ratings(spark, sf_dir), "standardize"))


@query(f"""WITH {views.RATINGS}, p AS (SELECT item, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM r GROUP BY item)
SELECT id, item, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS x FROM r JOIN p USING (item)""")
def scale_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scaling.scale(views.ratings(spark, sf_dir), "robust"))


@query(f"WITH {views.RATINGS} SELECT id, item, round(x - avg(x) OVER (PARTITION BY id), 6) AS x FROM r")
def scale_ipsative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scaling.scale(views.ratings(spark, sf_dir), "ipsative"))


@query(f"""WITH {views.RATINGS}, h AS (SELECT id, item, CASE WHEN id % 7 = 0 AND item = 'click' THEN NULL ELSE x END AS x FROM r)
SELECT id, item, round(coalesce(x, avg(x) OVER (PARTITION BY item)), 6) AS x FROM h""")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.ratings(spark, sf_dir).withColumn("x", F.when(~((F.col("id") % 7 == 0) & (F.col("item") == "click")), F.col("x")))
    return _six(scaling.impute_mean(r))


@query("""WITH h AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
m AS (SELECT segment FROM h WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT id, coalesce(h.segment, m.segment) AS segment FROM h, m""")
def impute_mode_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return scaling.impute_mode(c, "segment")


@query(f"""WITH {views.RATINGS}, h AS (SELECT * FROM r UNION ALL SELECT id, 'constant', 3.0 FROM (SELECT DISTINCT id FROM r)),
k AS (SELECT item FROM h GROUP BY item HAVING stddev_samp(x) > 1e-12) SELECT item, count(*) AS n FROM h WHERE item IN (SELECT item FROM k) GROUP BY item""")
def drop_constant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.ratings(spark, sf_dir)
    flat = r.select("id").distinct().select("id", F.lit("constant").alias("item"), F.lit(3.0).alias("x"))
    return scaling.drop_constant(r.union(flat)).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {views.RATINGS}, h AS (SELECT id, item, CASE WHEN id % 7 = 0 AND item = 'click' THEN NULL ELSE x END AS x FROM r),
w AS (SELECT id FROM h GROUP BY id HAVING count(x) = 5) SELECT h.id, item, round(x, 6) AS x FROM h JOIN w USING (id)""")
def drop_incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.ratings(spark, sf_dir).withColumn("x", F.when(~((F.col("id") % 7 == 0) & (F.col("item") == "click")), F.col("x")))
    return _six(scaling.drop_incomplete(r, 5))


@query("SELECT p_partkey AS id, p_brand AS brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code FROM part")
def code_nominals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.code_levels(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), "brand")


@query("""SELECT c_custkey AS id, (dense_rank() OVER (ORDER BY coalesce(s, 'MISSING')) - 1)::BIGINT AS code
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)""")
def code_categories_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("s"))
    return scaling.code_levels(c, "s", missing="MISSING").select("id", "code")


@query("""SELECT o_orderkey AS id, CASE substr(o_orderpriority, 3) WHEN 'LOW' THEN 1 WHEN 'NOT SPECIFIED' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 WHEN 'URGENT' THEN 5 END AS x FROM orders""")
def likert_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), scaling.recode(F.substring("o_orderpriority", 3, 99), [["low", "not specified", "medium", "high", "urgent"]]).alias("x"))


@query("SELECT p_size AS value, avg(n) AS midrank FROM (SELECT p_size::DOUBLE AS p_size, row_number() OVER (ORDER BY p_size) AS n FROM part) GROUP BY p_size")
def midrank_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gower.midranks(views.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size")), "p_size")


@query("""WITH v AS (SELECT DISTINCT p_size::DOUBLE + 0.5 AS value FROM part WHERE p_partkey % 3 = 0), l AS (SELECT DISTINCT p_size::DOUBLE AS level FROM part WHERE p_size % 3 = 1)
SELECT value, arg_min(level, abs(value - level) * 1000 + level / 1000) AS level FROM v, l GROUP BY value""")
def nearest_level_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    values = p.filter("p_partkey % 3 = 0").select((F.col("p_size").cast("double") + 0.5).alias("value")).distinct()
    levels = p.filter("p_size % 3 = 1").select(F.col("p_size").cast("double").alias("value")).distinct()
    return gower.nearest_levels(values, levels, "value")


KINDS = {"spend": gower.NUMERIC, "orders": gower.ORDINAL, "segment": gower.NOMINAL}
SPEC = f"""WITH {views.PROFILE},
ranks AS (SELECT orders, avg(n) AS rank FROM (SELECT orders, row_number() OVER (ORDER BY orders) AS n FROM p) GROUP BY orders),
e AS (SELECT p.id, p.spend, ranks.rank AS orders, p.segment FROM p JOIN ranks USING (orders)),
spec AS (SELECT max(spend) - min(spend) AS ss, max(orders) - min(orders) AS so FROM e)"""


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, gower.GowerSpec]:
    p = views.profile(spark, sf_dir).select("id", *KINDS)
    spec = gower.fit_spec(p, KINDS)
    return gower.encode(p, spec), spec


@query(SPEC + """ SELECT 'spend' AS item, round(ss, 6) AS scale FROM spec UNION ALL SELECT 'orders', round(so, 6) FROM spec UNION ALL SELECT 'segment', 1.0::DOUBLE""")
def gower_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spec = _encoded(spark, sf_dir)
    return spark.createDataFrame([(c, round(float(v), 6)) for c, v in spec.scale.items()], "item string, scale double")


FIRST = "f AS (SELECT row_number() OVER (ORDER BY id) - 1 AS segment, spend, orders, segment AS seg FROM e ORDER BY id LIMIT 3)"
GOWER_D = "(abs(e.spend - f.spend) / ss + abs(e.orders - f.orders) / so + (e.segment <> f.seg)::INT) / 3.0::DOUBLE"


def _against(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, gower.GowerSpec]:
    e, spec = _encoded(spark, sf_dir)
    few = e.orderBy("id").limit(3).select(F.col("id").alias("fid"), *(F.col(c).alias(f"f_{c}") for c in KINDS))
    return e.crossJoin(F.broadcast(few)), spec


@query(SPEC + f", {FIRST.replace('row_number() OVER (ORDER BY id) - 1 AS segment', 'id AS fid')} SELECT e.id, f.fid, round({GOWER_D}, 6) AS d FROM e, f, spec")
def gower_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, spec = _against(spark, sf_dir)
    return x.select("id", "fid", F.round(gower.distance(spec, {c: F.col(c) for c in KINDS}, {c: F.col(f"f_{c}") for c in KINDS}), 6).alias("d"))


@query(SPEC + f", {FIRST.replace('row_number() OVER (ORDER BY id) - 1 AS segment', 'id AS fid')} SELECT e.id, f.fid, round({GOWER_D}, 6) AS d FROM e, f, spec")
def gower_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, spec = _against(spark, sf_dir)
    d = manhattan(gower.embedding(spec, {c: F.col(c) for c in KINDS}), gower.embedding(spec, {c: F.col(f"f_{c}") for c in KINDS})) / len(KINDS)
    return x.select("id", "fid", F.round(d, 6).alias("d"))


def _prototyped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, gower.GowerSpec]:
    x, spec = _against(spark, sf_dir)
    d = gower.distance(spec, {c: F.col(c) for c in KINDS}, {c: F.col(f"f_{c}") for c in KINDS})
    near = x.groupBy("id", *KINDS).agg(F.min_by("fid", F.struct(d, F.col("fid"))).alias("fid"))
    ids = [r["fid"] for r in x.select("fid").distinct().orderBy("fid").collect()]
    return near.withColumn("cluster", F.array_position(F.array(*(F.lit(i) for i in ids)), F.col("fid")) - 1), spec


NEAR = SPEC + f""", {FIRST}, near AS (SELECT id, spend, orders, seg AS segment, segment AS cluster FROM (
  SELECT e.id, e.spend, e.orders, e.segment AS seg, f.segment, row_number() OVER (PARTITION BY e.id ORDER BY {GOWER_D}, f.segment) AS n FROM e, f, spec) WHERE n = 1)"""


@query(NEAR + " SELECT id, cluster::BIGINT AS cluster FROM near")
def assign_nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prototyped(spark, sf_dir)[0].select("id", F.col("cluster").cast("bigint").alias("cluster"))


@query(NEAR + """, med AS (SELECT cluster, count(*) AS n, quantile_cont(spend, 0.5) AS spend, quantile_cont(orders, 0.5) AS mo FROM near GROUP BY cluster),
o AS (SELECT cluster, arg_min(rank, abs(rank - mo) * 1e6 + rank / 1e6) AS orders FROM med, ranks GROUP BY cluster),
s AS (SELECT cluster, segment FROM (SELECT cluster, segment, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, segment) AS i FROM near GROUP BY cluster, segment) WHERE i = 1)
SELECT cluster::BIGINT AS cluster, n, round(spend, 6) AS spend, round(orders, 6) AS orders, segment FROM med JOIN o USING (cluster) JOIN s USING (cluster)""")
def kproto_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, spec = _prototyped(spark, sf_dir)
    return _six(gower.update_prototypes(near.withColumn("cluster", F.col("cluster").cast("bigint")), spec, "cluster").select("cluster", "n", "spend", "orders", "segment"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60) SELECT u.user_id AS id, """ + ", ".join(f"max((t.event_type = '{t}')::INT)::DOUBLE AS {t}" for t in TYPES) + " FROM (SELECT DISTINCT user_id FROM t) u JOIN t USING (user_id) GROUP BY u.user_id")
def multiselect_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pick-several column of packed options, back to one 0/1 column an option."""
    t = views.table(spark, sf_dir, "events").filter("value > 60").groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("q"))
    return ingest.expand_multiselect(t, "q", TYPES).select("id", *(F.col(f"`{ingest.option_column('q', o)}`").alias(o) for o in TYPES))


@query("SELECT * FROM (VALUES ('c_custkey', 'id'), ('c_name', 'skipped'), ('c_nationkey', 'continuous'), ('c_acctbal', 'continuous'), ('c_mktsegment', 'categorical')) v(\"column\", role)")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify_columns(views.table(spark, sf_dir, "customer"), "c_custkey").table(spark)


@query("SELECT n_name, n.n_nationkey % 3 AS segment FROM nation n JOIN region r ON n.n_nationkey = r.r_regionkey")
def background_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People in both files only, keys compared as text."""
    seg = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", (F.col("n_nationkey") % 3).alias("segment"))
    regions = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("who"))
    return joins.join_background(seg, regions, "who").join(seg.select("n_name", F.col("id").cast("string").alias("who")), "who").select("n_name", "segment")


@query("SELECT o_orderkey, o_custkey % 4 AS segment FROM orders")
def background_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files without a key pair up row by row."""
    o = views.table(spark, sf_dir, "orders")
    return joins.join_background(o.select((F.col("o_custkey") % 4).alias("segment")), o.select("o_orderkey"))
