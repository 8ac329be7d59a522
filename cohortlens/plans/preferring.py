"""Queries: best-worst choices, reach, designs and the planner's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import choice, design, reach, views
from .preparing import _six
from .registry import query

BW = f"WITH {views.CHOICES}"
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(BW + """, h AS (SELECT respondent_id, set, item, CASE WHEN set % 13 = 0 AND choice = 'worst' THEN '' ELSE choice END AS choice FROM bw),
k AS (SELECT respondent_id, set FROM h GROUP BY ALL HAVING count(*) FILTER (choice = 'best') = 1 AND count(*) FILTER (choice = 'worst') = 1)
SELECT respondent_id, count(DISTINCT set) AS sets, count(*) AS shown FROM h JOIN k USING (respondent_id, set) GROUP BY respondent_id""")
def maxdiff_validate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.choices(spark, sf_dir).withColumn("choice", F.when((F.col("set") % 13 == 0) & (F.col("choice") == "worst"), "").otherwise(F.col("choice")))
    return choice.valid_sets(c).groupBy("respondent_id").agg(F.countDistinct("set").alias("sets"), F.count(F.lit(1)).alias("shown"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(respondent_id, a column a type): codes of each respondent's first set.

    A set becomes one row where it lies; these are dealt by respondent into as many partitions, and the first one is kept there.
    """
    c, n = views.dealt_choices(spark, sf_dir)
    code = F.when(F.col("choice") == "best", 3).when(F.col("choice") == "worst", 1).otherwise(2)
    sets = c.filter("respondent_id is not null").groupBy("respondent_id", "set").agg(*(F.max(F.when(F.col("item") == t, code)).alias(t) for t in TYPES))
    at = F.row_number().over(Window.partitionBy("respondent_id").orderBy("set"))
    return sets.repartition(n, "respondent_id").withColumn("at", at).filter("at = 1").select("respondent_id", *TYPES)


@query(BW + ", k AS (SELECT respondent_id, min(set) AS set FROM bw GROUP BY respondent_id) SELECT respondent_id, 'Q1' AS set, item, choice FROM bw JOIN k USING (respondent_id, set)")
def maxdiff_unpivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide export with one task of coded columns, read back into the tidy form."""
    wide = _wide(spark, sf_dir).select("respondent_id", *(F.col(t).alias(f"Q1_{t}") for t in TYPES))
    return choice.from_wide(wide, "respondent_id", best=3, worst=1)


@query(BW + " SELECT CASE choice WHEN 'best' THEN 3.0 WHEN 'worst' THEN 1.0 ELSE 2.0 END::DOUBLE AS code, count(*) AS n FROM bw JOIN (SELECT respondent_id, min(set) AS set FROM bw GROUP BY respondent_id) USING (respondent_id, set) GROUP BY code")
def wide_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.codes_seen(_wide(spark, sf_dir), "respondent_id", TYPES)


@query(BW + " SELECT item, count(*) FILTER (choice = 'best') AS best, count(*) FILTER (choice = 'worst') AS worst, count(*) AS shown, round((count(*) FILTER (choice = 'best') - count(*) FILTER (choice = 'worst')) / count(*)::DOUBLE, 6) AS score FROM bw GROUP BY item")
def bw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(choice.counts(views.choices(spark, sf_dir)))


U = {t: round(0.3 * i - 0.75, 2) for i, t in enumerate(TYPES)}
U_SQL = "u(item, u) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in U.items()) + ")"


@query(f"""{BW}, {U_SQL}, s AS (SELECT respondent_id, set, max(u) FILTER (choice = 'best') AS ub, max(u) FILTER (choice = 'worst') AS uw, ln(sum(exp(u))) AS la, ln(sum(exp(-u)) FILTER (choice <> 'best')) AS lr FROM bw JOIN u USING (item) GROUP BY ALL)
SELECT respondent_id, round(sum(ub - la - uw - lr), 6) AS loglik FROM s GROUP BY respondent_id""")
def bw_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.createDataFrame(list(U.items()), "item string, u double")
    return _six(choice.log_likelihood(views.choices(spark, sf_dir), u))


DRAWS_SQL = "dr AS (SELECT l_orderkey % 200 AS draw, l_returnflag || l_linestatus AS item, avg(l_discount) AS value FROM lineitem GROUP BY ALL)"


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in joint draws: items by draw."""
    li = views.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 200).alias("draw"), F.concat("l_returnflag", "l_linestatus").alias("item")).agg(F.avg("l_discount").alias("value"))


@query(f"""WITH {DRAWS_SQL}, i AS (SELECT item, avg(value) AS utility, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM dr GROUP BY item),
k AS (SELECT *, row_number() OVER (ORDER BY utility DESC, item) AS rank, lead(item) OVER (ORDER BY utility DESC, item) AS nxt FROM i),
h AS (SELECT k.item, avg((x.value > y.value)::INT) AS p FROM k JOIN dr x ON x.item = k.item JOIN dr y ON y.item = k.nxt AND y.draw = x.draw GROUP BY k.item)
SELECT rank, item, round(utility, 6) AS utility, round(low, 6) AS low, round(high, 6) AS high, round_even(p, 4) AS prob_ahead, p >= 0.95 AS separated FROM k LEFT JOIN h USING (item)""")
def ranking_prob_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(choice.ranking(_draws(spark, sf_dir)))


@query(f"""WITH {DRAWS_SQL}, p AS (SELECT item, (draw >= 100)::INT AS part, avg(value) AS m, var_samp(value) AS v FROM dr GROUP BY ALL), s AS (SELECT item, avg(v) AS w, 100 * var_samp(m) AS b FROM p GROUP BY item)
SELECT round(max(sqrt((99 / 100.0::DOUBLE * w + b / 100) / w)), 6) AS rhat FROM s""")
def split_rhat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(choice.split_rhat(_draws(spark, sf_dir)))


@query(f"WITH {views.TASTE} SELECT id, item, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN 100 * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END, 6) AS score FROM taste WINDOW w AS (PARTITION BY id)")
def utilities_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.taste(spark, sf_dir)
    return _six(choice.rescaled(t.select(F.col("id").alias("respondent_id"), "item", F.col("x").alias("u"))).withColumnRenamed("respondent_id", "id"))


HITS = f"WITH {views.TASTE}, hits AS (SELECT id, item FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, item) AS n FROM taste) WHERE n <= 3)"


@query(HITS + " SELECT id, item FROM hits")
def reach_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.top_items(views.taste(spark, sf_dir), 3)


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], int]:
    """(hits, their items, their people); hits are kept, as every step of a search reads them."""
    hits = reach.top_items(views.taste(spark, sf_dir), 3).persist()
    items = [r["item"] for r in hits.select("item").distinct().orderBy("item").collect()]
    return hits, items, hits.select("id").distinct().count()


@query(HITS + """, i AS (SELECT DISTINCT item FROM hits), c AS (SELECT a.item AS a, b.item AS b, c.item AS c FROM i a JOIN i b ON a.item < b.item JOIN i c ON b.item < c.item),
k AS (SELECT a, b, c, count(DISTINCT id) AS reached FROM c JOIN hits ON hits.item IN (a, b, c) GROUP BY ALL)
SELECT a || ',' || b || ',' || c AS items, reached, (SELECT count(*) FROM k WHERE reached = (SELECT max(reached) FROM k)) AS ties FROM k ORDER BY reached DESC, a, b, c LIMIT 1""")
def turf_best_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, items, _ = _hits(spark, sf_dir)
    best, reached, _, ties = reach.best_set(hits, items, 3)
    return spark.createDataFrame([(",".join(best), reached, ties)], "items string, reached bigint, ties bigint")


@query(HITS + """, n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM hits), i AS (SELECT item, count(DISTINCT id) AS alone FROM hits GROUP BY item), o AS (SELECT item, alone FROM i ORDER BY item LIMIT 3),
s1 AS (SELECT item, alone AS reached FROM o ORDER BY alone DESC, item LIMIT 1),
s2 AS (SELECT o.item, (SELECT count(DISTINCT id) FROM hits WHERE hits.item IN (o.item, s1.item)) AS reached FROM o, s1 WHERE o.item <> s1.item ORDER BY reached DESC, o.item LIMIT 1),
s3 AS (SELECT o.item, (SELECT count(DISTINCT id) FROM hits WHERE hits.item IN (SELECT item FROM o)) AS reached FROM o, s1, s2 WHERE o.item NOT IN (s1.item, s2.item)),
a AS (SELECT 1 AS step, item, reached, 0 AS before FROM s1 UNION ALL SELECT 2, s2.item, s2.reached, s1.reached FROM s2, s1 UNION ALL SELECT 3, s3.item, s3.reached, s2.reached FROM s3, s2)
SELECT step::BIGINT AS step, item, round(reached / n, 6) AS reached, round((reached - before) / n, 6) AS gain, round(alone / n, 6) AS alone FROM a JOIN i USING (item), n""")
def turf_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, items, n = _hits(spark, sf_dir)
    return _six(reach.incremental(hits, items, items[:3], n))


@query()
def turf_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, items, _ = _hits(spark, sf_dir)
    return reach.holdout(hits, items, 3)


@query(BW + ", i AS (SELECT DISTINCT item FROM bw) SELECT x.item AS a, y.item AS b, (SELECT count(*) FROM bw p JOIN bw q USING (respondent_id, set) WHERE p.item = x.item AND q.item = y.item) AS together FROM i x JOIN i y ON x.item < y.item")
def design_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.pair_balance(views.choices(spark, sf_dir).select("respondent_id", "set", "item"))


@query(BW + """, i AS (SELECT item, count(*) AS n FROM bw GROUP BY item), p AS (SELECT p.item AS a, q.item AS b, count(*) AS n FROM bw p JOIN bw q USING (respondent_id, set) WHERE p.item < q.item GROUP BY ALL)
SELECT (SELECT min(n) FROM i) AS shown_min, (SELECT max(n) FROM i) AS shown_max, (SELECT count(*) FROM i) AS items, min(n) AS pair_min, max(n) AS pair_max, (15 - count(*))::BIGINT AS never FROM p""")
def design_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.describe(views.choices(spark, sf_dir).select("respondent_id", "set", "item"))


@query()
def design_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A questionnaire of 12 items, 4 a screen, 9 screens, 100 people."""
    return design.make_design(spark, [f"item {i:02d}" for i in range(12)], 4, 9, 100)


CELLS = [("moderate", 40, 0.4), ("moderate", 60, 0.8), ("moderate", 80, 0.4), ("moderate", 100, 0.8), ("moderate", 150, 1.0), ("moderate", 400, 0.8), ("subtle", 400, 0.2)]


@query("WITH c(regime, n_people, hit_rate) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in CELLS) + """), l AS (SELECT *, avg(hit_rate) OVER (ORDER BY n_people ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM c WHERE regime = 'moderate')
SELECT min(n_people) FILTER (hit_rate >= 0.8 AND later >= 0.8) AS recommended_n FROM l""")
def planner_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.recommend_size(spark.createDataFrame(CELLS, "regime string, n_people int, hit_rate double"))


@query()
def hb_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hierarchical utilities of all respondents and counting scores side by side, and whether the chains settled."""
    c = views.choices(spark, sf_dir)
    draws, _ = choice.hb_utilities(c)
    means = draws.groupBy("item").agg(F.avg("value").alias("utility"), F.max("rhat").alias("rhat"), F.max("n_used").alias("n_used"))
    return means.withColumn("settled", F.col("rhat") < choice.SETTLED).join(choice.counts(c).select("item", "score"), "item")


@query(f"WITH {views.TASTE} SELECT count(DISTINCT id) AS people, count(DISTINCT item) AS items, count(DISTINCT id) >= 40 AND count(DISTINCT item) >= 9 AS told FROM taste")
def turf_worth_telling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.worth_telling(views.taste(spark, sf_dir))


@query()
def turf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three items, with what a held-out half says of them; halves are dealt by hash, so SQL has no counterpart."""
    hits, items, _ = _hits(spark, sf_dir)
    return reach.turf(hits, items)
