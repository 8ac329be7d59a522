"""Queries that fit models; iterative or resampled, so they have no SQL oracle and tests hold them to planted truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, kernels, kproto, latent_batch, panel, planner, segments, study, validity, views
from . import grouping as G
from . import interpreting as I
from . import preparing as P
from .registry import query


@query()
def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sizes(panel.final_segments(G.people(spark, sf_dir), 3))


@query()
def gmm_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, means, _, _ = panel.gmm_full(G.people(spark, sf_dir), 3)
    return spark.createDataFrame([(j, float(w[j]), [float(v) for v in means[j]]) for j in range(3)], "component int, weight double, mean array<double>")


@query()
def kproto_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and mean distances of k-prototypes over all customers, the best of ten seeded starts."""
    e, spec = P._encoded(spark, sf_dir)
    found = kproto.fit(e, spec, 3)
    return kproto.assign(e, spec, found.rows).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"))


@query()
def lca_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, _ = I._lca(spark, sf_dir)
    post, _ = panel.lca_full(answers, 2)
    return post.groupBy("class").agg(F.avg("p").alias("weight"))


@query()
def panel_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.diagnostics(G.people(spark, sf_dir))


@query()
def recommended_k_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = panel.diagnostics(G.people(spark, sf_dir))
    return validity.recommend_k(validity.signals(d))


@query()
def clusterboot_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.people(spark, sf_dir)
    ids, x = panel.working_set(p)
    lab = kernels.kmeans(x, 3, np.random.default_rng(42), 10)[0]
    return panel.bootstrap_jaccard(p, dict(zip(ids.tolist(), lab.tolist(), strict=True)), 3)


@query()
def consensus_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.consensus_partition(G.people(spark, sf_dir), 3)


@query()
def ward_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of Ward's linkage with the final segments, of everybody; not computed for over 3,000 people."""
    p = G.people(spark, sf_dir)
    return panel.ward_agreement(p, panel.final_segments(p, 3), 3)


@query()
def pca_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hartigan's dip of the first principal component, on the working set, with a simulated p-value against uniforms."""
    _, x = panel.working_set(G.people(spark, sf_dir))
    z = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    d = kernels.dip(z)
    rng = np.random.default_rng(42)
    p = np.mean([kernels.dip(rng.random(len(z))) >= d for _ in range(100)])
    return spark.createDataFrame([(float(d), float(p), len(x))], "dip double, p double, n_used int")


@query()
def planner_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.sweep(spark)


@query()
def kmeans_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of twenty starts that come as low as the best one."""
    return batch.reached(G.people(spark, sf_dir), 3).agg(F.min("inertia").alias("inertia"), F.avg(F.col("reached").cast("double")).alias("reached"))


@query()
def single_cluster_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.single_cluster(G.people(spark, sf_dir))


@query()
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.model_agreement(G.people(spark, sf_dir), 3)


@query()
def variable_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether segments of the ratings get clearer without the items that don't set them apart."""
    return batch.variable_selection(G.people(spark, sf_dir), P.TYPES, 3)


@query()
def lca_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_batch.select(I._lca(spark, sf_dir)[0])


@query()
def pca_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where segments lie on the plane of the two widest axes: a row for each position, with its people."""
    points, _ = batch.pca_2d(G.labelled(spark, sf_dir))
    return batch.spots(points)


@query(f"""{G.A3}, xy AS (SELECT id, max(x) FILTER (item = 'click') AS x, max(x) FILTER (item = 'view') AS y FROM s GROUP BY id),
c AS (SELECT round(x, 1) AS x, round(y, 1) AS y, segment, count(*) AS m FROM xy JOIN a USING (id) GROUP BY ALL)
SELECT x, y, arg_min(segment, -m * 1000 + segment)::BIGINT AS segment, sum(m)::BIGINT AS n FROM c GROUP BY x, y""")
def map_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who share a position of two ratings, at one decimal.

    A position in the very middle between two falls to the one that SQL gives it on one thread; on more threads SQL's own last digits differ by the run.
    """
    ratings = views.ratings_in_order(spark, sf_dir)
    at = G.labelled(spark, sf_dir, ratings=ratings).filter("id is not null").select("segment", F.col("f")[0].alias("x"), F.col("f")[4].alias("y"))
    return batch.spots(at, 1)


@query()
def confidence_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence light of the final segments, every input fitted on all people but the panel's votes, which rest on its working set."""
    p = G.people(spark, sf_dir)
    votes = validity.signals(panel.diagnostics(p))
    k = validity.recommend_k(votes).first()["k"]
    data = batch.held(p)
    (found,) = batch.solutions(data, k, [None])
    data.unpersist()
    agree = validity.k_agreement(votes, spark.createDataFrame([(k,)], "k bigint")).first()["k_agree"]
    cross, one = batch.model_agreement(p, k).first()["agreement_ari"], batch.single_cluster(p).first()["single"]
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(found.fit.centres)], "segment bigint, f array<double>")
    shadow = segments.shadow_fit(p, centres).agg(F.percentile("shadow", F.lit(0.5)).alias("median_shadow"), F.count(F.lit(1)).alias("n"))
    row = [(k, float(found.jaccard.min()), found.split_half, agree, cross, one)]
    d = spark.createDataFrame(row, "k bigint, min_jaccard double, split_half double, k_agree double, cross_method double, single boolean").crossJoin(shadow)
    items = len(found.fit.centres[0])
    light = validity.confidence(F.col("min_jaccard"), F.col("split_half"), F.col("k_agree"), F.col("cross_method"), F.col("n"), F.lit(items))
    return d.withColumns({"confidence": light, "kind": validity.segmentation_kind(F.col("single"), F.col("split_half"), F.col("median_shadow"))})


@query()
def study_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole study of the ratings, from a table with one row a person to sized segments with their items' importance."""
    n = views.table(spark, sf_dir, "events").select("user_id").distinct().count()
    wide = views.ratings(spark, sf_dir).groupBy(F.col("id").alias("respondent_id")).pivot("item", P.TYPES).agg(F.first("x"))
    wide = wide.repartition(batch.partitions(spark, n), "respondent_id").persist()  # the study looks at it several times
    done = study.run(wide, "respondent_id", P.TYPES, 3)
    wide.unpersist()
    return done.tables["segment_sizes"].crossJoin(done.tables["variable_importance"])
