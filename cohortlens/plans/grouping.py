"""Queries: assignment, summaries, agreement, separation and the choice of the number of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import scaling, segments, validity, views
from .preparing import _six
from .registry import query

A3 = f"WITH {views.SCALED}, {views.assigned_sql(3)}"
A34 = f"{A3}, {views.assigned_sql(4, 'b')}"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.to_features(scaling.scale(views.ratings(spark, sf_dir), "range"))


def labelled(spark: SparkSession, sf_dir: str, k: int = 3, ratings: DataFrame | None = None) -> DataFrame:
    """(id, f, segment, d2) by the people of the smallest ids; f has a place for each item, null where somebody lacks it."""
    p = views.to_places(scaling.scale(views.ratings(spark, sf_dir) if ratings is None else ratings, "range"))
    return segments.assign(p, segments.first_centres(p, k))


def labelled_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ratings(spark, sf_dir).join(labelled(spark, sf_dir).select("id", "segment"), "id")


def two_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): labels by three and by four fixed centres."""
    p = people(spark, sf_dir)
    a = segments.assign(p, segments.first_centres(p, 3)).withColumnRenamed("segment", "a").drop("d2")
    return segments.assign(a, segments.first_centres(p, 4)).select("id", "a", F.col("segment").alias("b"))


@query(A3 + " SELECT id, segment, round(d2, 6) AS d2 FROM a")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(labelled(spark, sf_dir).select("id", "segment", "d2"))


@query(A3 + " SELECT segment, count(*) AS n, round_even(count(*) / (sum(count(*)) OVER ())::DOUBLE, 3) AS share FROM a GROUP BY segment")
def segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sizes(labelled(spark, sf_dir))


@query(A3 + " SELECT segment, item, round(avg(x), 6) AS x FROM a JOIN s USING (id) GROUP BY ALL")
def segment_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ["click", "error", "purchase", "signup", "view"]
    c = segments.centroids(labelled(spark, sf_dir))
    return _six(c.select("segment", F.explode(F.arrays_zip(F.array(*(F.lit(i) for i in items)).alias("item"), F.col("f").alias("x"))).alias("z")).select("segment", F.col("z.item").alias("item"), F.col("z.x").alias("x")))


def _lloyd_sql(k: int, steps: int) -> str:
    out = f"WITH {views.SCALED}, {views.assigned_sql(k, 'a0')}"
    for i in range(1, steps + 1):
        out += f""", m{i} AS (SELECT segment, item, avg(x) AS x FROM a{i - 1} JOIN s USING (id) GROUP BY ALL),
d{i} AS (SELECT s.id, m.segment, sum((s.x - m.x) * (s.x - m.x)) AS d2 FROM s JOIN m{i} m USING (item) GROUP BY ALL),
a{i} AS (SELECT id, segment, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, segment) AS n FROM d{i}) WHERE n = 1)"""
    return out + f" SELECT id, segment, round(d2, 6) AS d2 FROM a{steps}"


@query(_lloyd_sql(3, 4))
def lloyd_fixed_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).cache()
    return _six(segments.assign(p, segments.lloyd(p, segments.first_centres(p, 3), 4)).select("id", "segment", "d2"))


@query(A3 + ", w AS (SELECT segment, CASE WHEN id % 11 = 0 THEN -1.0 ELSE (id % 5 + 1)::DOUBLE END AS w FROM a) SELECT segment, round(sum(greatest(w, 0)) / sum(sum(greatest(w, 0))) OVER (), 6) AS population_share FROM w GROUP BY segment")
def weighted_population_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = labelled(spark, sf_dir).withColumn("w", F.when(F.col("id") % 11 == 0, -1.0).otherwise((F.col("id") % 5 + 1).cast("double")))
    return _six(segments.weighted_share(w, "w"))


@query(A3 + ", m AS (SELECT segment, item, avg(x) AS m FROM a JOIN s USING (id) GROUP BY ALL) SELECT segment, count(DISTINCT id) AS n, round(sum((x - m) * (x - m)), 6) AS ss FROM a JOIN s USING (id) JOIN m USING (segment, item) GROUP BY segment")
def within_ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.within_ss(labelled(spark, sf_dir)))


@query(A3 + """, w AS (SELECT x.id, x.segment, y.segment AS other, sqrt(sum((p.x - q.x) * (p.x - q.x))) AS d FROM a x JOIN s p ON p.id = x.id JOIN s q ON q.item = p.item AND q.id <> x.id JOIN a y ON y.id = q.id GROUP BY x.id, x.segment, y.id, y.segment),
m AS (SELECT id, segment, other, avg(d) AS d FROM w GROUP BY ALL),
ab AS (SELECT id, segment, max(d) FILTER (other = segment) AS a, min(d) FILTER (other <> segment) AS b FROM m GROUP BY ALL)
SELECT id, segment, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.silhouette(labelled(spark, sf_dir)))


@query(A3 + """, m AS (SELECT segment, item, avg(x) AS m, count(*) AS n FROM a JOIN s USING (id) GROUP BY ALL), g AS (SELECT item, avg(x) AS g FROM s GROUP BY item),
w AS (SELECT sum((x - m) * (x - m)) AS w FROM a JOIN s USING (id) JOIN m USING (segment, item)), b AS (SELECT sum(n * (m - g) * (m - g)) AS b, count(DISTINCT segment) AS k FROM m JOIN g USING (item)),
n AS (SELECT count(*) AS n FROM a) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM w, b, n""")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.calinski_harabasz(labelled(spark, sf_dir)))


@query(A3 + """, m AS (SELECT segment, item, avg(x) AS m FROM a JOIN s USING (id) GROUP BY ALL),
sp AS (SELECT segment, avg(d) AS s FROM (SELECT id, segment, sqrt(sum((x - m) * (x - m))) AS d FROM a JOIN s USING (id) JOIN m USING (segment, item) GROUP BY ALL) GROUP BY segment),
cd AS (SELECT x.segment AS p, y.segment AS q, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM m x JOIN m y ON x.item = y.item AND x.segment <> y.segment GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT p, max((u.s + v.s) / d) AS r FROM cd JOIN sp u ON u.segment = p JOIN sp v ON v.segment = q GROUP BY p)""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labelled(spark, sf_dir)
    return _six(validity.davies_bouldin(x.select("segment", "f"), segments.centroids(x)))


LABELS = A34 + ", l AS (SELECT a.id, a.segment AS a, b.segment AS b FROM a JOIN b USING (id))"


@query(LABELS + """, c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS t FROM c),
ra AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY b)),
e AS (SELECT sum(n)::DOUBLE * (sum(n) - 1) / 2 AS t FROM c)
SELECT round((t.t - ra.t * rb.t / e.t) / ((ra.t + rb.t) / 2 - ra.t * rb.t / e.t), 6) AS ari FROM t, ra, rb, e""")
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.adjusted_rand(two_labels(spark, sf_dir), "a", "b"))


@query(LABELS + """, c AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY ALL), t AS (SELECT a, sum(n * (n - 1)) AS t, sum(n) AS m FROM c GROUP BY a)
SELECT round(min(CASE WHEN m > 1 THEN t / (m * (m - 1)) ELSE 1 END), 6) AS prediction_strength FROM t""")
def prediction_strength_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.prediction_strength(two_labels(spark, sf_dir), "a", "b"))


REPS = LABELS + ", reps AS (SELECT r AS rep, id, a, CASE WHEN (id * 7919 + r * 104729) % 10 = 0 THEN (b + 1) % 4 ELSE b END AS b FROM l, (SELECT unnest(range(0, 5)) AS r) WHERE (id * 7919 + r * 104729) % 100 < 80)"


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticket = F.col("id") * 7919 + F.col("rep") * 104729
    r = two_labels(spark, sf_dir).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))).filter(ticket % 100 < 80)
    return r.withColumn("label", F.when(ticket % 10 == 0, (F.col("b") + 1) % 4).otherwise(F.col("b")))


@query(REPS + ", c AS (SELECT x.id AS i, y.id AS j, avg((x.b = y.b)::INT) AS share FROM reps x JOIN reps y ON x.rep = y.rep AND x.id < y.id GROUP BY ALL) SELECT round(avg((share > 0.1 AND share < 0.9)::INT), 6) AS pac FROM c")
def pac_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.pac_of_labels(_replicates(spark, sf_dir).select("rep", "id", "label")))


@query(REPS + """, c AS (SELECT rep, a, b, count(*) AS n FROM reps GROUP BY ALL), x AS (SELECT rep, a, sum(n) AS na FROM c GROUP BY ALL), y AS (SELECT rep, b, sum(n) AS nb FROM c GROUP BY ALL)
SELECT rep, a AS segment, round(max(n / (na + nb - n)), 6) AS jaccard FROM c JOIN x USING (rep, a) JOIN y USING (rep, b) GROUP BY ALL""")
def jaccard_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.best_jaccard(_replicates(spark, sf_dir).withColumnRenamed("a", "segment")))


@query(LABELS + ", c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL) SELECT a AS segment, arg_max(b, n * 1000 - b) AS best, round(max(n) / sum(n), 6) AS share FROM c GROUP BY a")
def persistence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(validity.persistence(two_labels(spark, sf_dir), "a", "b"))


@query(f"""WITH {views.SCALED}, q AS (SELECT id, item, x, true AS is_person FROM s WHERE id % 10 = 3
  UNION ALL SELECT -id, item, ((id * 31 + ascii(item) * 17) % 97) / 96.0::DOUBLE, false FROM s WHERE id % 10 = 7),
d AS (SELECT q.id, q.is_person, s.id AS other, sqrt(sum((q.x - s.x) * (q.x - s.x))) AS d FROM q JOIN s USING (item) WHERE q.id <> s.id GROUP BY ALL),
n AS (SELECT id, is_person, min(d) AS d FROM d GROUP BY ALL) SELECT round(sum(d) FILTER (NOT is_person) / sum(d), 6) AS hopkins FROM n""")
def hopkins_fixed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scaling.scale(views.ratings(spark, sf_dir), "range")
    p = views.to_features(s)
    real = p.filter("id % 10 = 3").withColumn("is_person", F.lit(True))
    fake = s.filter("id % 10 = 7").select((-F.col("id")).alias("id"), "item", (((F.col("id") * 31 + F.ascii("item") * 17) % 97) / F.lit(96.0)).alias("x"))
    return _six(validity.hopkins(p, real.union(views.to_features(fake).withColumn("is_person", F.lit(False)))))


CANDIDATES = range(2, 7)
MEASURES = "inertia gap gap_se silhouette calinski_harabasz davies_bouldin prediction_strength stability stability_sd pac bic icl min_segment_share".split()


def _measures_sql(k: int) -> str:
    """Simple measures of the assignment to the first k people: what the decision rules below are held against, not the panel's estimates."""
    a = f"a{k}"
    return f""", {views.assigned_sql(k, a)},
{a}_t AS (SELECT id, min(d2) AS d1, list_sort(list(d2))[2] AS d2 FROM {a}_d GROUP BY id),
{a}_f AS (SELECT t.id, segment, d1, CASE WHEN t.d2 > 0 THEN 1 - sqrt(d1 / t.d2) ELSE 0 END AS fit FROM {a}_t t JOIN {a} USING (id)),
{a}_s AS (SELECT segment, count(*) AS n, avg(fit) AS fit FROM {a}_f GROUP BY segment),
{a}_o AS (SELECT count(*) AS n, sum(d1) AS w, avg(fit) AS fit, stddev_pop(fit) AS sd, avg((fit < 0.1)::INT) AS pac, any_value(ss) AS ss FROM {a}_f, total),
dd{k} AS (SELECT {k}::BIGINT AS k, w AS inertia, ln(ss / n) - ln(w / n) - 0.2::DOUBLE * {k} AS gap, sd / sqrt(n) AS gap_se, o.fit AS silhouette, (ss - w) / {k - 1} / (w / n) AS calinski_harabasz, sd / o.fit AS davies_bouldin,
  0.5 + (SELECT min(fit) FROM {a}_s) AS prediction_strength, 0.3 + o.fit AS stability, sd AS stability_sd, pac, n * ln(w / n) + {k} * 5 * ln(n) AS bic, n * ln(w / n) + {k} * 5 * ln(n) + n * (1 - o.fit) AS icl,
  (SELECT min(n) FROM {a}_s) / n::DOUBLE AS min_segment_share FROM {a}_o o)"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)
DIAG_SQL = (
    f"WITH {views.SCALED}, total AS (SELECT sum((x - m) ** 2) AS ss FROM (SELECT x, avg(x) OVER (PARTITION BY item) AS m FROM s))"
    + "".join(_measures_sql(k) for k in CANDIDATES)
    + ", dd AS (" + " UNION ALL ".join(f"SELECT k, {_ROUNDED} FROM dd{k}" for k in CANDIDATES) + "), d AS (SELECT * FROM dd WHERE min_segment_share >= 0.05 OR (SELECT count(*) FROM dd WHERE min_segment_share >= 0.05) < 2)"
)


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each k: simple measures of the assignment to the first k people, the candidates of the rules below."""
    p = people(spark, sf_dir)
    at = p.select(F.posexplode("f").alias("pos", "x")).groupBy("pos").agg((F.var_pop("x") * F.count(F.lit(1))).alias("v")).agg(F.sum("v").alias("ss"))
    rows = []
    for k in CANDIDATES:
        d = segments.distances(p, segments.first_centres(p, k))
        d1, d2 = F.col("d")[0]["d2"], F.col("d")[1]["d2"]
        f = d.select(F.col("d")[0]["segment"].alias("segment"), d1.alias("d1"), F.when(d2 > 0, 1 - F.sqrt(d1 / d2)).otherwise(0.0).alias("fit"))
        by = f.groupBy("segment").agg(F.count(F.lit(1)).alias("m"), F.avg("fit").alias("mean"), F.sum("fit").alias("s1"), F.sum(F.col("fit") ** 2).alias("s2"), F.sum("d1").alias("w"), F.sum((F.col("fit") < 0.1).cast("int")).alias("low"))
        o = by.agg(F.sum("m").alias("n"), F.sum("w").alias("w"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("low").alias("low"), F.min("mean").alias("least"), F.min("m").alias("smallest")).crossJoin(at)
        o = o.withColumn("fit", F.col("s1") / F.col("n")).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - F.col("fit") ** 2)))
        w, n, size = F.col("w"), F.col("n"), F.lit(k).cast("bigint")
        bic = n * F.log(w / n) + k * 5 * F.log(n)
        told = {
            "inertia": w, "gap": F.log(F.col("ss") / n) - F.log(w / n) - 0.2 * k, "gap_se": F.col("sd") / F.sqrt(n), "silhouette": F.col("fit"), "calinski_harabasz": (F.col("ss") - w) / (k - 1) / (w / n), "davies_bouldin": F.col("sd") / F.col("fit"),
            "prediction_strength": F.col("least") + 0.5, "stability": F.col("fit") + 0.3, "stability_sd": F.col("sd"), "pac": F.col("low") / n, "bic": bic, "icl": bic + n * (1 - F.col("fit")), "min_segment_share": F.col("smallest") / n,
        }
        rows.append(o.select(size.alias("k"), *(F.round(told[m], 6).alias(m) for m in MEASURES)))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


ELBOW = """(SELECT k FROM (SELECT k, (k - (SELECT min(k) FROM d)) / ((SELECT max(k) - min(k) FROM d) + 1e-12) AS px, (inertia - (SELECT min(inertia) FROM d)) / ((SELECT max(inertia) - min(inertia) FROM d) + 1e-12) AS py FROM d),
  (SELECT arg_min((inertia - mi) / (ma - mi + 1e-12), k) AS y0, arg_max((inertia - mi) / (ma - mi + 1e-12), k) AS y1 FROM d, (SELECT min(inertia) AS mi, max(inertia) AS ma FROM d))
  ORDER BY round(abs((y1 - y0) * px - (1 - 0) * py + 1 * y0 - y1 * 0), 9) DESC, k LIMIT 1)"""
GAP = "(SELECT coalesce(min(k) FILTER (gap >= ng - ns), arg_max(k, gap)) FROM (SELECT *, lead(gap) OVER (ORDER BY k) AS ng, lead(gap_se) OVER (ORDER BY k) AS ns FROM d))"


@query(DIAG_SQL + f" SELECT {ELBOW} AS k")
def elbow_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.elbow(validity.viable(diagnostics(spark, sf_dir)))


@query(DIAG_SQL + f" SELECT {GAP} AS k")
def gap_rule_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.gap_rule(validity.viable(diagnostics(spark, sf_dir)))


VOTES = DIAG_SQL + f""", v AS (SELECT 'silhouette' AS signal, arg_max(k, silhouette) AS k, 1 AS weight FROM d UNION ALL SELECT 'calinski_harabasz', arg_max(k, calinski_harabasz), 1 FROM d
UNION ALL SELECT 'davies_bouldin', arg_min(k, davies_bouldin), 1 FROM d UNION ALL SELECT 'prediction_strength', coalesce(max(k) FILTER (prediction_strength >= 0.8), arg_max(k, prediction_strength)), 2 FROM d
UNION ALL SELECT 'stability', coalesce(max(k) FILTER (stability >= 0.75 AND (SELECT max(stability) FROM d) - stability <= stability_sd), arg_max(k, stability)), 2 FROM d
UNION ALL SELECT 'pac', arg_min(k, pac), 2 FROM d UNION ALL SELECT 'bic', arg_min(k, bic), 1 FROM d UNION ALL SELECT 'icl', arg_min(k, icl), 1 FROM d
UNION ALL SELECT 'elbow', {ELBOW}, 0 UNION ALL SELECT 'gap', {GAP}, 1)"""


@query(VOTES + " SELECT signal, k, weight::BIGINT AS weight FROM v")
def k_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.signals(diagnostics(spark, sf_dir))


@query(VOTES + " SELECT k, sum(weight)::BIGINT AS score FROM v GROUP BY k ORDER BY score DESC, sum((weight >= 2)::INT) DESC, k LIMIT 1")
def recommend_k_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.recommend_k(validity.signals(diagnostics(spark, sf_dir)))


@query(DIAG_SQL + ", v AS (SELECT arg_min(k, icl) AS k, 2 AS w FROM dd UNION ALL SELECT arg_min(k, bic), 1 FROM dd UNION ALL SELECT min(k) FILTER (stability >= 0.75), 1 FROM dd) SELECT k, sum(w)::BIGINT AS score FROM v GROUP BY k ORDER BY score DESC, k LIMIT 1")
def recommend_k_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.recommend_k_lca(diagnostics(spark, sf_dir))


@query(VOTES + """, agree AS (SELECT dd.k, avg((abs(v.k - dd.k) <= 1)::INT) AS k_agree FROM dd, v GROUP BY dd.k), n AS (SELECT count(*) AS n, (SELECT count(DISTINCT item) FROM s) AS items FROM (SELECT DISTINCT id FROM s))
SELECT k, round(k_agree, 6) AS k_agree, CASE WHEN prediction_strength >= 0.75 AND stability >= 0.6 AND k_agree >= 0.6 AND silhouette + 0.3 >= 0.6 AND n >= 2 * items THEN 'High' WHEN prediction_strength >= 0.6 AND stability >= 0.4 THEN 'Moderate' ELSE 'Low' END AS confidence,
  CASE WHEN prediction_strength >= 0.85 THEN 'highly stable' WHEN prediction_strength >= 0.75 THEN 'stable' WHEN prediction_strength >= 0.6 THEN 'pattern' WHEN prediction_strength >= 0.5 THEN 'doubtful' ELSE 'dissolved' END AS reading,
  CASE WHEN gap < gap_se AND stability < 0.5 THEN 'constructive' WHEN 1 - silhouette < 0.55 AND stability >= 0.6 THEN 'natural' WHEN stability >= 0.6 THEN 'reproducible' ELSE 'constructive' END AS kind FROM dd JOIN agree USING (k), n""")
def confidence_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light for each candidate, its inputs measured on the table; the share of criteria that vote within one of it among them."""
    d = diagnostics(spark, sf_dir)
    n = people(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("f")).alias("items"))
    d = d.join(validity.k_agreement(validity.signals(d), d.select("k")), "k").crossJoin(n)
    light = validity.confidence(F.col("prediction_strength"), F.col("stability"), F.col("k_agree"), F.col("silhouette") + 0.3, F.col("n"), F.col("items"))
    kind = validity.segmentation_kind(F.col("gap") < F.col("gap_se"), F.col("stability"), 1 - F.col("silhouette"))
    return d.select("k", F.round("k_agree", 6).alias("k_agree"), light.alias("confidence"), C.jaccard_reading(F.col("prediction_strength")).alias("reading"), kind.alias("kind"))


@query(f"WITH {views.SCALED}, p AS (SELECT id, list(round(x, 1) ORDER BY item) AS f FROM s GROUP BY id) SELECT count(*) AS n, count(DISTINCT f) AS n_distinct, least(count(*) // 2, count(DISTINCT f)) AS most_k, count(DISTINCT f) // 4 AS sensible_k FROM p")
def feasible_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scaling.scale(views.ratings(spark, sf_dir), "range").withColumn("x", F.round("x", 1))
    return validity.feasible_k(views.to_features(s))


@query(A3 + """, d AS (SELECT id, segment, sqrt(d2) AS d, row_number() OVER (PARTITION BY id ORDER BY d2, segment) AS n FROM a_d),
t AS (SELECT x.id, x.segment AS closest, y.segment AS second, CASE WHEN x.d + y.d > 0 THEN 2 * x.d / (x.d + y.d) ELSE 0 END AS shadow FROM d x JOIN d y USING (id) WHERE x.n = 1 AND y.n = 2)
SELECT id, closest, second, round(shadow, 6) AS shadow, round_even(1 - shadow, 3) AS fit FROM t""")
def shadow_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir)
    return segments.shadow_fit(p, segments.first_centres(p, 3)).withColumn("shadow", F.round("shadow", 6))


@query(A3 + """, d AS (SELECT id, segment, sqrt(d2) AS d, row_number() OVER (PARTITION BY id ORDER BY d2, segment) AS n FROM a_d)
SELECT x.segment AS closest, y.segment AS second, round(avg(CASE WHEN x.d + y.d > 0 THEN 2 * x.d / (x.d + y.d) ELSE 0 END), 6) AS mean_shadow, count(*) AS n FROM d x JOIN d y USING (id) WHERE x.n = 1 AND y.n = 2 GROUP BY ALL""")
def segment_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir)
    return _six(segments.neighbours(segments.shadow_fit(p, segments.first_centres(p, 3))))
