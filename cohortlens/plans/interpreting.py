"""Queries: importance, tests, defining items and typing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import wording
from ..operators import charts, gower, latent, latent_batch, profiling, scaling, segments, typing, views
from . import grouping as G
from .preparing import KINDS, _six
from .registry import query

A3 = G.A3
MOMENTS = A3 + """, y AS (SELECT segment, item, count(*) AS n, avg(r.x) AS m, sum(r.x) AS t, var_pop(r.x) AS v FROM a JOIN r USING (id) GROUP BY ALL), g AS (SELECT item, avg(x) AS g FROM r GROUP BY item),
mo AS (SELECT item, sum(n) AS n, count(*) AS k, sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w FROM y JOIN g USING (item) GROUP BY item)"""


@query(MOMENTS + ", e AS (SELECT item, round_even(b / (b + w), 3) AS e FROM mo) SELECT item, e AS eta_squared, CASE WHEN e >= 0.15 THEN 'drives segmentation' WHEN e >= 0.05 THEN 'contributes' ELSE 'near-noise (consider dropping)' END AS role FROM e")
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.eta_squared(G.labelled_long(spark, sf_dir))


@query(MOMENTS + " SELECT item, round((b / (k - 1)) / (w / (n - k)), 6) AS f, k - 1 AS df1, (n - k)::BIGINT AS df2 FROM mo")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(profiling.anova(G.labelled_long(spark, sf_dir)))


CHI = f"""WITH {views.PROFILE}, l AS (SELECT id, CASE WHEN balance > 5000 THEN 2 WHEN balance > 1000 THEN 1 ELSE 0 END AS cluster, segment, (nation % 2)::VARCHAR AS half FROM p)"""


def _chi_sql(a: str, b: str) -> str:
    return f"""{CHI}, c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM l GROUP BY ALL), ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
t AS (SELECT sum(o)::DOUBLE AS n FROM c), f AS (SELECT coalesce(o, 0) AS o, ra * cb / n AS e FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN c USING (a, b)),
x AS (SELECT sum((o - e) * (o - e) / e) AS plain, sum((abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / e) AS cut FROM f), sh AS (SELECT (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM cb) AS k)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("balance") > 5000, 2).when(F.col("balance") > 1000, 1).otherwise(0)
    return views.profile(spark, sf_dir).select("id", cluster.alias("cluster"), "segment", (F.col("nation") % 2).cast("string").alias("half"), "orders", "spend", "nation")


@query(_chi_sql("cluster", "segment") + " SELECT round(plain, 6) AS chi2, ((r - 1) * (k - 1))::BIGINT AS df FROM x, sh")
def chi2_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(profiling.chi_squared(_clusters(spark, sf_dir), "cluster", "segment").select("chi2", "df"))


@query(_chi_sql("CASE WHEN cluster = 2 THEN 1 ELSE 0 END", "half") + " SELECT round(cut, 6) AS chi2, ((r - 1) * (k - 1))::BIGINT AS df FROM x, sh")
def chi2_yates(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _clusters(spark, sf_dir).withColumn("two", (F.col("cluster") == 2).cast("int"))
    return _six(profiling.chi_squared(two, "two", "half").select("chi2", "df"))


@query(_chi_sql("cluster", "segment") + """, ph AS (SELECT greatest(0, plain / n - (r - 1) * (k - 1) / (n - 1)) AS phi2, least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1 AS room FROM x, sh, t)
SELECT round(phi2 / room, 6) AS v2 FROM ph""")
def cramers_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(profiling.cramers_v2(_clusters(spark, sf_dir), "cluster", "segment"))


@query(f"""{CHI}, o AS (SELECT l.cluster, p.orders FROM l JOIN p USING (id)), k AS (SELECT cluster, avg(i) OVER (PARTITION BY orders) AS rank, orders FROM (SELECT *, row_number() OVER (ORDER BY orders) AS i FROM o)),
h AS (SELECT sum(r * r / n) AS s, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT cluster, sum(rank) AS r, count(*) AS n FROM k GROUP BY cluster)), t AS (SELECT sum(t * t * t - t) AS t FROM (SELECT count(*)::DOUBLE AS t FROM o GROUP BY orders))
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h, k - 1 AS df FROM h, t""")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir)
    return _six(profiling.kruskal(c.select(F.col("cluster").alias("segment"), "orders"), "orders"))


@query(f"{CHI} SELECT cluster AS segment, round(quantile_cont(p.spend, 0.5), 6) AS median FROM l JOIN p USING (id) GROUP BY cluster")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(profiling.group_medians(_clusters(spark, sf_dir).select(F.col("cluster").alias("segment"), "spend"), "spend"))


@query(MOMENTS + """, p AS (SELECT item AS name, round(w / (b + w) / 12, 6) AS p FROM mo), i AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
SELECT name, p, i <= coalesce((SELECT max(i) FROM i WHERE p <= i / m::DOUBLE * 0.06), 0) AS significant FROM i""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step-up rule over one number for each item, a twelfth of the share of variance that segments leave."""
    m = profiling.moments(G.labelled_long(spark, sf_dir))
    return profiling.bh_fdr(m.select(F.col("item").alias("name"), F.round(F.col("within") / (F.col("between") + F.col("within")) / 12, 6).alias("p")), 0.06)


@query()
def trait_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background traits against clusters; p-values need the incomplete gamma function, which SQL lacks."""
    return profiling.profile_traits(_clusters(spark, sf_dir).drop("id").withColumnRenamed("segment", "market").withColumnRenamed("cluster", "segment"), ["market", "half", "orders", "nation"])


@query(A3 + """, m AS (SELECT segment, item, avg(r.x) AS m FROM a JOIN r USING (id) GROUP BY ALL), g AS (SELECT item, avg(x) AS g FROM r GROUP BY item),
d AS (SELECT segment, item, m - g AS diff, row_number() OVER (PARTITION BY segment ORDER BY m - g DESC, item) AS u, row_number() OVER (PARTITION BY segment ORDER BY m - g, item) AS v FROM m JOIN g USING (item))
SELECT segment, item, round(diff, 6) AS diff, CASE WHEN u <= 2 THEN 'high' ELSE 'low' END AS side FROM d WHERE u <= 2 OR v <= 2""")
def defining_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(segments.defining_items(G.labelled_long(spark, sf_dir)))


@query(f"""{CHI}, c AS (SELECT cluster, segment, count(*)::DOUBLE AS n FROM l GROUP BY ALL), o AS (SELECT segment, sum(n) / (SELECT sum(n) FROM c) AS overall FROM c GROUP BY segment),
k AS (SELECT cluster, segment AS pick, n / sum(n) OVER (PARTITION BY cluster) AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, segment) AS i FROM c)
SELECT k.cluster AS segment, pick, round(share, 6) AS share, round(overall, 6) AS overall FROM k JOIN o ON o.segment = pick WHERE i = 1""")
def segment_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir).select(F.col("cluster").alias("segment"), F.col("segment").alias("market"))
    return _six(segments.picks(c, "market").select("segment", "pick", "share", "overall"))


@query(A3 + ", m AS (SELECT segment, item, avg(x) AS m FROM a JOIN s USING (id) GROUP BY ALL) SELECT segment, item, round(m - avg(m) OVER (PARTITION BY item), 6) AS deviation FROM m")
def heatmap_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's mean less the unweighted mean over segments."""
    s = scaling.scale(views.ratings(spark, sf_dir), "range").join(G.labelled(spark, sf_dir).select("id", "segment"), "id")
    m = s.groupBy("segment", "item").agg(F.avg("x").alias("m"))
    return _six(m.select("segment", "item", (F.col("m") - F.avg("m").over(Window.partitionBy("item"))).alias("deviation")))


@query(A3 + ", m AS (SELECT segment, item, avg(x) AS m FROM a JOIN s USING (id) GROUP BY ALL) SELECT item, round(max(m) - min(m), 6) AS spread FROM m GROUP BY item ORDER BY spread DESC LIMIT 9")
def separating_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine items whose segment means are furthest apart, for profile charts."""
    s = scaling.scale(views.ratings(spark, sf_dir), "range").join(G.labelled(spark, sf_dir).select("id", "segment"), "id")
    m = s.groupBy("segment", "item").agg(F.avg("x").alias("m"))
    return _six(m.groupBy("item").agg((F.max("m") - F.min("m")).alias("spread")).orderBy(F.desc("spread"), "item").limit(9))


@query(A3 + """, d AS (SELECT id, sqrt(d2) AS d, row_number() OVER (PARTITION BY id ORDER BY d2, segment) AS n FROM a_d),
t AS (SELECT x.id, 1 - CASE WHEN x.d + y.d > 0 THEN 2 * x.d / (x.d + y.d) ELSE 0 END AS fit FROM d x JOIN d y USING (id) WHERE x.n = 1 AND y.n = 2)
SELECT least(floor(round(fit, 9) * 40), 39)::BIGINT AS bin, count(*) AS n FROM t GROUP BY bin""")
def gorge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty bins of the per-person fit on [0, 1]; the last one has its right edge."""
    p = G.people(spark, sf_dir)
    fit = 1 - F.col("shadow")
    return segments.shadow_fit(p, segments.first_centres(p, 3)).groupBy(F.least(F.floor(F.round(fit, 9) * 40), F.lit(39)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# --- typing rules ---------------------------------------------------------------------------------

ITEMS = ["click", "error", "purchase", "signup", "view"]


def _rule(spark: SparkSession, sf_dir: str) -> dict:
    """Trained on users of even id: range scaling, centres of the three smallest ids."""
    r = views.ratings(spark, sf_dir).filter("id % 2 = 0")
    params = {x["item"]: (x["shift"], x["spread"]) for x in scaling.scale_fit(r, "range").collect()}
    c = segments.first_centres(views.to_features(scaling.scale(r, "range")), 3).orderBy("segment").collect()
    return typing.centroid_rule(ITEMS, "range", params, [x["f"] for x in c])


def _new_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.ratings(spark, sf_dir).filter("id % 2 = 1")
    wide = r.groupBy("id").pivot("item", ITEMS).agg(F.first("x"))
    return wide.withColumn("click", F.when(F.col("id") % 7 != 1, F.col("click"))).withColumn("view", F.when(F.col("id") % 5 == 1, F.lit(990.0)).otherwise(F.col("view")))


RULE = f"""WITH {views.RATINGS}, p AS (SELECT item, min(x) AS lo, max(x) - min(x) AS w FROM r WHERE id % 2 = 0 GROUP BY item),
c AS (SELECT dense_rank() OVER (ORDER BY id) - 1 AS segment, item, (x - lo) / w AS c FROM r JOIN p USING (item) WHERE id IN (SELECT DISTINCT id FROM r WHERE id % 2 = 0 ORDER BY id LIMIT 3)),
nw AS (SELECT id, item, CASE WHEN item = 'click' AND id % 7 = 1 THEN NULL WHEN item = 'view' AND id % 5 = 1 THEN 990.0 ELSE x END AS x FROM r WHERE id % 2 = 1),
sc AS (SELECT id, item, (coalesce(x, lo + w / 2) - lo) / w AS x, coalesce((x < lo - (1e-9 + 0.01 * w) OR x > lo + w + (1e-9 + 0.01 * w))::INT, 0) AS off FROM nw JOIN p USING (item)),
d AS (SELECT id, segment, sqrt(sum((x - c) * (x - c))) AS d FROM sc JOIN c USING (item) GROUP BY ALL), o AS (SELECT id, sum(off)::BIGINT AS off_scale FROM sc GROUP BY id)"""


@query(RULE + " SELECT id, arg_min(segment, d) AS segment, round_even((1 / (min(d) + 1e-9)) / sum(1 / (d + 1e-9)), 3) AS confidence FROM d GROUP BY id")
def classify_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typing.classify(typing.from_json(typing.to_json(_rule(spark, sf_dir))), _new_people(spark, sf_dir)).select("id", "segment", "confidence")


@query(RULE + " SELECT id, off_scale FROM o")
def off_scale_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typing.classify(_rule(spark, sf_dir), _new_people(spark, sf_dir)).select("id", "off_scale")


CAT = """WITH h AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS segment FROM orders)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_totalprice") > 300000, 2).when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("segment"))


@query(CAT + """, tr AS (SELECT * FROM h WHERE id % 2 = 0), pi AS (SELECT segment, count(*)::DOUBLE AS n, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS pi FROM tr GROUP BY segment),
tall AS (SELECT id, segment, 'status' AS item, status AS level FROM tr UNION ALL SELECT id, segment, 'priority', priority FROM tr), lv AS (SELECT item, count(DISTINCT level) AS nl FROM tall GROUP BY item),
th AS (SELECT g.item, g.level, pi.segment, (coalesce(c.n, 0) + 0.5) / (pi.n + 0.5 * nl) AS theta FROM (SELECT DISTINCT item, level FROM tall) g CROSS JOIN pi JOIN lv USING (item) LEFT JOIN (SELECT item, level, segment, count(*) AS n FROM tall GROUP BY ALL) c ON c.item = g.item AND c.level = g.level AND c.segment = pi.segment),
nw AS (SELECT id, 'status' AS item, status AS level FROM h WHERE id % 2 = 1 UNION ALL SELECT id, 'priority', CASE WHEN id % 9 = 0 THEN 'new' ELSE priority END FROM h WHERE id % 2 = 1),
l AS (SELECT id, pi.segment, ln(any_value(pi)) + coalesce(sum(ln(theta)), 0) AS l FROM nw CROSS JOIN pi LEFT JOIN th ON th.item = nw.item AND th.level = nw.level AND th.segment = pi.segment GROUP BY ALL)
SELECT id, arg_max(segment, l) AS segment, round_even(1 / sum(exp(l - m)), 3) AS confidence FROM (SELECT *, max(l) OVER (PARTITION BY id) AS m FROM l) GROUP BY id""")
def classify_new_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _answers(spark, sf_dir)
    rule = typing.lca_rule(h.filter("id % 2 = 0"), ["status", "priority"])
    new = h.filter("id % 2 = 1").withColumn("priority", F.when(F.col("id") % 9 == 0, "new").otherwise(F.col("priority")))
    return typing.score(rule, new.drop("segment")).select("id", "segment", "confidence")


@query(A3 + """, f AS (SELECT id, segment, (row_number() OVER (PARTITION BY segment ORDER BY id) - 1) % 5 AS fold FROM a), k AS (SELECT DISTINCT fold FROM f),
c AS (SELECT k.fold, f.segment, item, avg(x) AS c FROM k JOIN f ON f.fold <> k.fold JOIN s USING (id) GROUP BY ALL),
d AS (SELECT f.id, f.segment AS truth, c.segment, sum((s.x - c) * (s.x - c)) AS d FROM f JOIN s USING (id) JOIN c ON c.fold = f.fold AND c.item = s.item GROUP BY ALL),
t AS (SELECT id, any_value(truth) AS truth, arg_min(segment, d) AS typed FROM d GROUP BY id), b AS (SELECT max(n) / sum(n) AS baseline FROM (SELECT count(*)::DOUBLE AS n FROM a GROUP BY segment))
SELECT round(avg((truth = typed)::INT), 6) AS accuracy, round(any_value(baseline), 6) AS baseline, round(avg((truth = typed)::INT) - any_value(baseline), 6) AS lift FROM t, b""")
def typing_cv_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(typing.cv_accuracy(G.labelled(spark, sf_dir)))


LCA = """WITH h AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, (CASE WHEN o_orderkey % 3 = 0 THEN 0.7 ELSE 0.2 END)::DOUBLE AS p0 FROM orders),
ans AS (SELECT id, 'status' AS item, status AS level FROM h UNION ALL SELECT id, 'priority', priority FROM h), post AS (SELECT id, 0 AS class, p0 AS p FROM h UNION ALL SELECT id, 1, 1 - p0 FROM h),
pi AS (SELECT class, avg(p) AS pi FROM post GROUP BY class), n AS (SELECT item, level, class, sum(p) + 0.1 AS n FROM ans JOIN post USING (id) GROUP BY ALL),
th AS (SELECT item, level, class, n / sum(n) OVER (PARTITION BY item, class) AS theta FROM n)"""


def _lca(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = _answers(spark, sf_dir)
    p0 = F.when(F.col("id") % 3 == 0, 0.7).otherwise(0.2)
    post = h.select("id", F.explode(F.array(F.struct(F.lit(0).alias("class"), p0.alias("p")), F.struct(F.lit(1).alias("class"), (1 - p0).alias("p")))).alias("z")).select("id", "z.*")
    return h.select("id", "status", "priority").unpivot("id", ["status", "priority"], "item", "level"), post


@query(LCA + " SELECT item, level, class, round(theta, 6) AS theta FROM th")
def lca_mstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(latent.m_step(*_lca(spark, sf_dir))[1].select("item", "level", "class", "theta"))


@query(LCA + """, l AS (SELECT id, class, sum(ln(theta)) + ln(any_value(pi)) AS l FROM ans JOIN th USING (item, level) JOIN pi USING (class) GROUP BY ALL), t AS (SELECT id, ln(sum(exp(l))) AS ll FROM l GROUP BY id)
SELECT id, class, round(exp(l - ll), 6) AS p, round(ll, 6) AS loglik FROM l JOIN t USING (id)""")
def lca_estep_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, post = _lca(spark, sf_dir)
    return _six(latent.e_step(answers, *latent.m_step(answers, post)).select("id", "class", "p", "loglik"))


MIXED = f"""WITH {views.PROFILE}, t AS (SELECT * FROM p WHERE id % 2 = 0),
ranks AS (SELECT orders, avg(n) AS rank FROM (SELECT orders, row_number() OVER (ORDER BY orders) AS n FROM t) GROUP BY orders),
spec AS (SELECT max(spend) - min(spend) AS ss, quantile_cont(orders, 0.5) AS mo, (SELECT max(rank) - min(rank) FROM ranks) AS so FROM t),
f AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, spend, rank, segment FROM t JOIN ranks USING (orders) ORDER BY id LIMIT 3),
n AS (SELECT id, spend, CASE WHEN id % 11 <> 0 THEN orders + 0.4 END AS o, CASE WHEN id % 7 = 0 THEN 'NEW' WHEN id % 13 <> 0 THEN segment END AS segment FROM p WHERE id % 2 = 1),
v AS (SELECT n.id, arg_min(rank, abs(coalesce(o, mo) - ranks.orders) * 1e6 + ranks.orders) AS rank FROM n, ranks, spec GROUP BY n.id),
d AS (SELECT n.id, c, (abs(n.spend - f.spend) / ss + abs(v.rank - f.rank) / so + coalesce((n.segment <> f.segment)::INT, 1)) / 3.0::DOUBLE AS d FROM n JOIN v USING (id), f, spec)"""


def mixed_rule(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame]:
    """A rule of three fixed prototypes from customers of even id, and the others with halves, gaps and answers that training never showed."""
    p = views.profile(spark, sf_dir).select("id", *KINDS)
    train, new = p.filter("id % 2 = 0"), p.filter("id % 2 = 1")
    spec = gower.fit_spec(train, KINDS)
    protos = [r.asDict() for r in gower.encode(train, spec).orderBy("id").limit(3).select(*KINDS).collect()]
    orders = F.when(F.col("id") % 11 != 0, F.col("orders") + 0.4)
    segment = F.when(F.col("id") % 7 == 0, "NEW").when(F.col("id") % 13 != 0, F.col("segment"))
    return typing.gower_rule(spec, protos), new.withColumns({"orders": orders, "segment": segment})


@query(MIXED + " SELECT id, arg_min(c, round(d, 9) + c / 1e12)::BIGINT AS typed, round_even((1 / (min(d) + 1e-9)) / sum(1 / (d + 1e-9)), 3) AS confidence FROM d GROUP BY id")
def classify_new_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by Gower's distance to a saved rule: ratings to the nearest known level, unseen and missing answers of a pick-one item as mismatches."""
    rule, new = mixed_rule(spark, sf_dir)
    return typing.score(typing.from_json(typing.to_json(rule)), new).select("id", F.col("segment").alias("typed"), "confidence")


@query(A3 + """, b AS (SELECT segment, count(*) AS n FROM a GROUP BY segment), m AS (SELECT least(5, min(n)) AS folds, min(n) >= 2 AND sum(n) >= 10 AS ok, max(n) / sum(n)::DOUBLE AS baseline FROM b),
f AS (SELECT id, segment, (row_number() OVER (PARTITION BY segment ORDER BY md5(id::VARCHAR), id) - 1) % (SELECT folds FROM m) AS fold FROM a), k AS (SELECT DISTINCT fold FROM f),
w AS (SELECT k.fold, item, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS w FROM k JOIN f ON f.fold <> k.fold JOIN r USING (id) GROUP BY ALL),
c AS (SELECT k.fold, f.segment, item, avg(x) AS c FROM k JOIN f ON f.fold <> k.fold JOIN r USING (id) GROUP BY ALL),
d AS (SELECT f.id, f.segment AS truth, c.segment, sum(((r.x - c) / w) ** 2) AS d FROM f JOIN r USING (id) JOIN c ON c.fold = f.fold AND c.item = r.item JOIN w ON w.fold = f.fold AND w.item = r.item GROUP BY ALL),
t AS (SELECT id, any_value(truth) AS segment, (arg_min(segment, d) = any_value(truth))::INT AS hit FROM d GROUP BY id)
SELECT b.segment, b.n, CASE WHEN ok THEN round((SELECT avg(hit) FROM t WHERE t.segment = b.segment), 6) END AS recall, CASE WHEN ok THEN round((SELECT avg(hit) FROM t), 6) END AS accuracy, round(baseline, 6) AS baseline,
  CASE WHEN ok THEN round((SELECT avg(hit) FROM t) - baseline, 6) END AS lift FROM b, m""")
def typing_cv_refitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out typing with range scaling fitted anew without each fold, and recall by segment."""
    raw = views.to_features(views.ratings(spark, sf_dir))
    return _six(typing.cv_typing(raw.join(G.labelled(spark, sf_dir).select("id", "segment"), "id")))


@query(LCA + """, l AS (SELECT id, class, sum(ln(theta)) + ln(any_value(pi)) AS l FROM ans JOIN th USING (item, level) JOIN pi USING (class) GROUP BY ALL), t AS (SELECT id, ln(sum(exp(l))) AS ll FROM l GROUP BY id),
e AS (SELECT -sum(exp(l - ll) * (l - ll)) AS entropy FROM l JOIN t USING (id)), g AS (SELECT count(DISTINCT (item, level)) - count(DISTINCT item) AS free FROM ans), s AS (SELECT sum(ll) AS ll, count(*) AS n, 1 + 2 * (SELECT free FROM g) AS params FROM t)
SELECT round(ll, 3) AS loglik, params::BIGINT AS n_params, round(-2 * ll + params * ln(n), 3) AS bic, round(-2 * ll + params * ln(n) + 2 * entropy, 3) AS icl, round(entropy / (n * ln(2)), 6) AS normalized_entropy FROM s, e""")
def lca_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC, ICL and entropy of two classes whose posteriors are given."""
    answers, post = _lca(spark, sf_dir)
    p = latent.e_step(answers, *latent.m_step(answers, post))
    one = p.groupBy("id").agg(F.first("loglik").alias("ll"), (-F.sum(F.col("p") * F.log("p"))).alias("h")).agg(F.sum("ll").alias("ll"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    levels = answers.select("item", "level").distinct().groupBy("item").count().agg((F.sum("count") - F.count(F.lit(1))).alias("free")).first()["free"]
    params = 1 + 2 * levels
    bic, icl, norm = latent_batch.information(one["ll"], one["h"], params, one["n"], 2)
    return spark.createDataFrame([(round(one["ll"], 3), params, round(bic, 3), round(icl, 3), round(norm, 6))], "loglik double, n_params bigint, bic double, icl double, normalized_entropy double")


SHADOW = A3 + """, d AS (SELECT id, segment, sqrt(d2) AS d, row_number() OVER (PARTITION BY id ORDER BY d2, segment) AS n FROM a_d),
sh AS (SELECT x.id, x.segment AS closest, y.segment AS second, CASE WHEN x.d + y.d > 0 THEN 2 * x.d / (x.d + y.d) ELSE 0 END AS shadow FROM d x JOIN d y USING (id) WHERE x.n = 1 AND y.n = 2)"""


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.people(spark, sf_dir)
    return segments.shadow_fit(p, segments.first_centres(p, 3))


@query(SHADOW + """, g AS (SELECT closest, second, round(avg(shadow), 6) AS m, count(*) AS n FROM sh GROUP BY ALL), u AS (SELECT *, least(closest, second) AS a, greatest(closest, second) AS b FROM g),
rk AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY m DESC, closest) AS i FROM u), t AS (SELECT a, b, m, n FROM rk WHERE i = 1 ORDER BY m DESC, a, b LIMIT 4)
SELECT a, b, m AS mean_shadow, n, CASE WHEN m >= 0.80 THEN 'barely distinguishable' WHEN m >= 0.55 THEN 'shade into one another' ELSE 'own territory' END AS verdict FROM t""")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = charts.neighbour_pairs(_six(segments.neighbours(_fits(spark, sf_dir))))
    return pairs.withColumn("verdict", wording.neighbours_verdict(F.col("mean_shadow")))


XY = "xy AS (SELECT id, max(x) FILTER (item = 'click') AS x, max(x) FILTER (item = 'view') AS y FROM s GROUP BY id), pt AS (SELECT a.segment, x, y FROM xy JOIN a USING (id)), ce AS (SELECT segment, avg(x) AS cx, avg(y) AS cy FROM pt GROUP BY segment)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.labelled(spark, sf_dir).select("segment", F.col("f")[0].alias("x"), F.col("f")[4].alias("y"))


@query(f"""{A3}, {XY}, e AS (SELECT min(x) AS lx, max(x) - min(x) AS sx, min(y) AS ly, max(y) - min(y) AS sy FROM pt),
g AS (SELECT k % 40 AS i, k // 40 AS j, lx - 0.07 * sx + (k % 40) / 39 * 1.14 * sx AS x, ly - 0.07 * sy + (k // 40) / 39 * 1.14 * sy AS y FROM range(1600) t(k), e)
SELECT i::INT AS i, j::INT AS j, arg_min(segment, round((x - cx) ** 2 + (y - cy) ** 2, 12) * 1e9 + segment / 1e3)::BIGINT AS region FROM g, ce GROUP BY i, j""")
def decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each spot of a map of two ratings falls to."""
    return charts.decision_grid(_points(spark, sf_dir), 40).select("i", "j", "region")


@query(f"{A3}, {XY}, q AS (SELECT *, row_number() OVER () AS id FROM pt), t AS (SELECT q.id, any_value(q.segment) AS own, arg_min(ce.segment, (x - cx) ** 2 + (y - cy) ** 2) AS region FROM q, ce GROUP BY q.id) SELECT count(*) AS n, round(avg((own = region)::INT), 6) AS agree FROM t")
def map_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(charts.map_agreement(_points(spark, sf_dir)))


@query(SHADOW + """, v AS (SELECT closest AS segment, 1 - shadow AS value FROM sh), b AS (SELECT least(26, greatest(10, floor(sqrt(min(n)) * 1.15)))::INT AS bins, min(lo) AS lo, max(hi) AS hi FROM (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi FROM v GROUP BY segment)),
h AS (SELECT segment, least(floor((value - lo) / (hi - lo) * bins), bins - 1)::INT AS bin, count(*) AS n FROM v, b GROUP BY ALL) SELECT segment, bin, n, round(n / sum(n) OVER (PARTITION BY segment)::DOUBLE, 6) AS share FROM h""")
def fit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of a segment's people, in as many bins as the smallest segment bears."""
    return _six(charts.histogram(_fits(spark, sf_dir).select(F.col("closest").alias("segment"), (1 - F.col("shadow")).alias("value"))))


@query(A3 + """, z AS (SELECT segment, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM a GROUP BY segment), w AS (SELECT *, round_even(share * 100, 0)::INT || '%' AS pct FROM z),
n AS (SELECT segment, min(abs(share - 1 / d::DOUBLE)) AS off, arg_min(d, abs(share - 1 / d::DOUBLE)) AS d FROM z, range(3, 11) t(d) GROUP BY segment)
SELECT segment, CASE WHEN share >= 0.45 THEN 'about half (' || pct || ')' WHEN off <= 0.03 THEN 'about 1 in ' || d || ' (' || pct || ')' ELSE pct END AS phrase FROM w JOIN n USING (segment)""")
def share_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.labelled(spark, sf_dir).groupBy("segment").count()
    share = n.select("segment", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))
    return share.select("segment", wording.fraction(F.col("share")).alias("phrase"))


@query(r"""WITH t AS (SELECT DISTINCT 'I like the ' || lower(p_type) || ' and' || ' ' || p_brand || '?' AS q FROM part), f AS (SELECT q, regexp_replace(regexp_replace(trim(regexp_replace(q, '[\s_]+', ' ', 'g')), '[\s?]+$', ''), '^[Ii] +', '') AS flat FROM t),
c AS (SELECT *, trim(regexp_replace(' ' || regexp_extract(flat, '^(.{1,30}) ', 1), '( (to|for|of|in|on|at|a|an|the|and|or|rather|than|with|by|from|that|as|is|are|my|own|it|about|would|will|can))+$', '', 'i')) AS kept FROM f)
SELECT q, CASE WHEN length(flat) <= 30 THEN flat WHEN kept = '' THEN regexp_extract(flat, '^([^ ]+)', 1) || '…' ELSE kept || '…' END AS label FROM c""")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of product names, shortened for charts."""
    p = views.table(spark, sf_dir, "part")
    q = p.select(F.concat(F.lit("I like the "), F.lower("p_type"), F.lit(" and"), F.lit(" "), F.col("p_brand"), F.lit("?")).alias("q")).distinct()
    return q.select("q", wording.short_label(F.col("q")).alias("label"))


@query(f"""WITH {views.SCALED}, p AS (SELECT id, list(round(x, 1) ORDER BY item) AS f FROM s GROUP BY id), o AS (SELECT count(DISTINCT f) / count(*)::DOUBLE AS share, max(len(f)) AS items FROM p)
SELECT round(share, 6) AS distinct_share, items::INT AS items, CASE WHEN share < 0.5 AND items <= 3 THEN 'same answers, few items' WHEN share < 0.5 THEN 'same answers' WHEN items <= 3 THEN 'few items' ELSE '' END AS doubts FROM o""")
def hopkins_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.to_features(scaling.scale(views.ratings(spark, sf_dir), "range").withColumn("x", F.round("x", 1)))
    one = p.agg((F.countDistinct("f") / F.count(F.lit(1))).alias("share"), F.max(F.size("f")).alias("items"))
    return one.select(F.round("share", 6).alias("distinct_share"), "items", F.array_join(wording.hopkins_doubts(F.col("share"), F.col("items")), ", ").alias("doubts"))
