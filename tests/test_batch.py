"""Batched fits against plain computations and planted truth."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import batch as B
from cohortlens.operators import latent_batch as L

SCHEMA = "id bigint, f array<double>"


def planted(seed, sizes=(120, 100, 100), items=8, noise=2, apart=3.0):
    rng = np.random.default_rng(seed)
    centres = np.concatenate([rng.normal(0, apart, (len(sizes), items)), np.zeros((len(sizes), noise))], axis=1)
    return np.concatenate([rng.normal(c, 1, (n, items + noise)) for c, n in zip(centres, sizes, strict=True)]), np.repeat(np.arange(len(sizes)), sizes)


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).repartition(parts)


def test_uniforms_are_even_and_differ_by_salt():
    u = np.arange(20000).astype(np.uint64)
    a, b = B.uniform(u, 1), B.uniform(u, 2)
    assert abs(a.mean() - 0.5) < 0.01 and a.min() > 0 and a.max() < 1 and abs(np.corrcoef(a, b)[0, 1]) < 0.03


def test_draws_follow_weights(spark):
    data = B.prepared(frame(spark, np.array([[0.0], [1.0], [3.0]]), 2))
    jobs = [B.Job(1, s) for s in range(2000)]
    got = np.array([d[0] for d in B.drawn(data, jobs, lambda i, x: x[:, 0], 7)])
    assert (got == 0).sum() == 0 and abs((got == 3).mean() - 0.75) < 0.04
    even = np.array([d[0] for d in B.drawn(data, jobs, lambda i, x: np.zeros(len(x)), 7)])
    assert all(abs((even == v).mean() - 1 / 3) < 0.05 for v in (0, 1, 3))


def test_every_start_is_a_plain_lloyd_run(spark):
    x, truth = planted(1)
    data = B.prepared(frame(spark, x))
    jobs = [B.Job(3, s) for s in range(5)] + [B.Job(2, 0, items=(0, 3)), B.Job(4, 0, B.half(0))]
    first = B.seeds(data, jobs)
    u = np.array([r["u"] for r in spark.range(len(x)).select(F.xxhash64("id").alias("u")).orderBy("id").collect()]).view(np.uint64)
    for job, c, fit in zip(jobs, first, B.kmeans(data, jobs), strict=True):
        _, mine = B._seen(job, u, x, np.zeros(len(x)))
        assert all((np.abs(mine - row).max(axis=1) < 1e-12).any() for row in c)
        for _ in range(100):
            lab = B.sq_distances(mine, c).argmin(axis=1)
            c = np.stack([mine[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(job.k)])
        assert np.allclose(fit.centres, c) and fit.inertia == pytest.approx(B.sq_distances(mine, c).min(axis=1).sum())


def test_reached_share_of_clear_groups_is_high(spark):
    x, _ = planted(2)
    r = B.reached(frame(spark, x), 3, 20).toPandas()
    assert len(r) == 20 and r["reached"].mean() > 0.5 and (r["reached"] == (r["inertia"] <= r["inertia"].min() * 1.001 + 1e-8)).all()


def test_noise_is_one_cluster_and_groups_are_not(spark):
    rng = np.random.default_rng(3)
    assert B.single_cluster(frame(spark, rng.random((300, 6)))).first()["single"]
    assert not B.single_cluster(frame(spark, planted(4)[0])).first()["single"]
    picks = rng.integers(0, 2, (300, 5)).astype(float)
    assert B.single_cluster(frame(spark, picks), kinds=["nominal"] * 5).first()["single"]
    two = np.concatenate([np.tile([0.0, 0, 0, 0, 0], (150, 1)), np.tile([1.0, 1, 1, 1, 1], (150, 1))])
    two = np.abs(two - (rng.random((300, 5)) < 0.1))
    assert not B.single_cluster(frame(spark, two), kinds=["nominal"] * 5).first()["single"]


def test_null_people_keep_each_items_support(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.choice([1.0, 2.0, 5.0], 200), rng.normal(50, 10, 200)], axis=1)
    null = B.null_people(frame(spark, x), 2, ["ordinal", "numeric"]).toPandas()
    y = np.stack(null["f"])
    assert len(y) == 400 and (null["g"].value_counts() == 200).all() and set(y[:, 0]) == {1.0, 2.0, 5.0}
    assert y[:, 1].min() >= x[:, 1].min() and y[:, 1].max() <= x[:, 1].max() and abs(np.corrcoef(y.T)[0, 1]) < 0.15


def test_principal_axes_equal_a_decomposition(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4)) @ rng.normal(size=(4, 4)) + 3
    points, shares = B.pca_2d(frame(spark, x))
    got = points.orderBy("id").select("x", "y").toPandas().to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2])) and np.allclose(shares, (s**2 / (s**2).sum())[:2])
    one, share = B.pca_2d(frame(spark, x[:, :1]))
    assert share == (1.0, 0.0) and one.filter("y <> 0").count() == 0


def test_each_person_is_in_one_spot(spark):
    rows = [(i, float(i % 3) + 1e-12 * i, float(i % 2), i % 5 // 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y double, segment int")
    s = B.spots(df).toPandas()
    assert len(s) == 6 and s["n"].sum() == 60 and set(s["segment"]) == {0}


def test_mixture_agrees_with_clear_groups(spark):
    x, truth = planted(7, items=4, noise=0)
    r = B.model_agreement(frame(spark, x), 3).first()
    assert r["agreement_ari"] > 0.95 and r["mean_max_posterior"] > 0.95 and r["normalized_entropy"] < 0.1
    assert B.model_agreement(frame(spark, x), 3, mixed=True).first()["agreement_ari"] is None


def test_mixture_settles_where_plain_em_does(spark):
    x, _ = planted(8, sizes=(80, 80), items=3, noise=0, apart=1.2)
    data = B.prepared(frame(spark, x))
    start = B.kmeans(data, [B.Job(2, 0)])[0]
    ms = B.mixtures(data, [B.Fit(B.Job(2, 0, kind=k), start.centres) for k in B.SHAPES], steps=40)
    for m in ms:
        r = (start.label(x)[:, None] == np.arange(2)).astype(float)
        lls = []
        for _ in range(41):
            s0 = r.sum(axis=0)
            means = (r.T @ x) / s0[:, None]
            covs = np.stack([(r[:, j, None] * (x - means[j])).T @ (x - means[j]) / s0[j] for j in range(2)])
            now = B.Mixture(m.job, s0 / s0.sum(), means, B._shaped(m.job.kind, s0, covs, 1e-4))
            logs = now.logs(x)
            top = logs.max(axis=1, keepdims=True)
            lls.append(float((top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))).sum()))
            r = np.exp(logs - top) / np.exp(logs - top).sum(axis=1, keepdims=True)
        assert any(m.loglik == pytest.approx(v, rel=1e-6) for v in lls)
        assert np.allclose([np.linalg.det(c) > 0 for c in m.covs], True)


def test_noise_items_are_named(spark):
    x, _ = planted(9)
    names = [f"item_{j}" for j in range(10)]
    r = B.variable_selection(frame(spark, x), names, 3, starts=4, resamples=5).first()
    assert r["applicable"] and set(r["dropped"]) == {"item_8", "item_9"} and r["n_signal"] == 8 and r["reduced_split_half"] > 0.9
    clear = B.variable_selection(frame(spark, x[:, :8]), names[:8], 3, starts=4, resamples=2).first()
    assert not clear["applicable"] and clear["dropped"] == []


def answers_of(spark, codes):
    rows = [(i, f"q{j}", "ab"[int(v)]) for i, r in enumerate(codes) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "id bigint, item string, level string")


def planted_answers(seed, n=200, blocks=3):
    rng = np.random.default_rng(seed)
    truth = np.repeat(np.arange(blocks), n)
    p = np.where(np.arange(3 * blocks) // 3 == truth[:, None], 0.85, 0.15)
    return (rng.random(p.shape) < p).astype(int), truth


def test_latent_classes_find_the_planted_number(spark):
    codes, _ = planted_answers(10)
    d = L.select(answers_of(spark, codes), range(2, 5), starts=4, resamples=3).toPandas().set_index("k")
    assert d["bic"].idxmin() == 3 and d["icl"].idxmin() == 3 and d.loc[3, "split_half"] > 0.5 and d.loc[3, "stability"] > 0.6
    assert list(d["n_params"]) == [k - 1 + k * 9 for k in (2, 3, 4)]
    for k in (2, 3, 4):
        bic = -2 * d.loc[k, "loglik"] + d.loc[k, "n_params"] * np.log(600)
        assert d.loc[k, "bic"] == pytest.approx(bic) and d.loc[k, "icl"] == pytest.approx(bic + 2 * d.loc[k, "normalized_entropy"] * 600 * np.log(k))


def test_latent_fit_is_plain_em(spark):
    codes, _ = planted_answers(11, 60, 2)
    answers = answers_of(spark, codes)
    c = L.coded(answers, [B.EVERYBODY, B.half(0)])
    assert c.n[0] == 120 and 30 < c.n[1] < 90
    (m,) = L.fit(c, [B.Job(2, 1)])
    h = np.zeros((120, 12))
    for i, r in enumerate(codes):
        h[i, [c.levels.index((f"q{j}", "ab"[v])) for j, v in enumerate(r)]] = 1
    logs = m.logs(h)
    ll = np.log(np.exp(logs).sum(axis=1))
    assert m.loglik == pytest.approx(ll.sum()) and np.allclose(m.theta[0::2] + m.theta[1::2], 1)
    r = np.exp(logs - ll[:, None])
    assert m.entropy == pytest.approx(-(r * np.log(r)).sum()) and np.allclose(m.weights, r.mean(axis=0), atol=1e-3)
    post = L.posteriors(c, m, answers).groupBy("id").pivot("class", [0, 1]).agg(F.first("p")).orderBy("id").toPandas()
    assert np.allclose(post[["0", "1"]].to_numpy(), r)


def test_held_people_have_few_partitions(spark):
    """Scans had as many tasks as the plan that made the people."""
    people = frame(spark, np.arange(300.0).reshape(-1, 1), 100)
    data = B.held(people)
    assert data.rdd.getNumPartitions() == 1
    assert data.count() == 300
    data.unpersist()


def test_spots_round_the_multiple(spark):
    """0.44999999999999996 * 10 is 4.5, which DuckDB rounds up; its decimal form is below the middle."""
    import duckdb

    x = [0.44999999999999996, 0.049999999999999996, 0.05, 0.15, 0.35, 0.35 - 2**-54, 0.949999999, -0.25]
    got = {(r["x"], r["y"]) for r in B.spots(spark.createDataFrame([(v, 0.0, 0) for v in x], "x double, y double, segment bigint"), 1).collect()}
    want = {(duckdb.execute("SELECT round(?::DOUBLE, 1)", [v]).fetchone()[0], 0.0) for v in x}
    assert got == want


def test_a_step_moves_no_rows(spark):
    """Every step shuffled its sums, a second stage of as many tasks as there are shuffle partitions."""
    data = B.prepared(spark.range(300).select("id", F.array(F.col("id").cast("double")).alias("f")))
    spark.sparkContext.setJobGroup("steps", "")
    try:
        (s,) = B.totals(data, lambda u, x, g: [np.array([len(x), x.sum()])])
        (one,) = B.drawn(data, [B.Job(1)], lambda i, x: (x[:, 0] == 7).astype(float), 0)
        tracker = spark.sparkContext.statusTracker()
        stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("steps")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert s.tolist() == [300, 300 * 299 / 2] and one.tolist() == [7.0]
    assert stages == [1, 1]


def test_patterns_have_few_partitions(spark):
    """every step read the few patterns in the session's shuffle partitions."""
    answers = spark.range(300).select("id", F.lit("q").alias("item"), (F.col("id") % 3).cast("string").alias("level"))
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "false")
    try:
        c = L.coded(answers, [B.EVERYBODY])
        assert c.patterns.rdd.getNumPartitions() == 1 and c.n.tolist() == [300] and c.patterns.count() == 3
    finally:
        spark.conf.unset("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")
    c.patterns.unpersist()


def test_models_together_step_as_each_alone(monkeypatch):
    rng = np.random.default_rng(2)
    x, u, g = rng.random((300, 4)), rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 3, 300).astype(np.int32)
    jobs = [B.Job(k, s, part, items, group) for k in (1, 3) for s in (0, 1) for part in (B.EVERYBODY, B.half(0), (7, 0.2, 0.2)) for items in (None, (0, 2)) for group in (None, 1)]
    centres = [rng.random((j.k, 4 if j.items is None else 2)) for j in jobs]
    centres[-1][1] = centres[-1][0]  # a tie: the lower group has everybody
    monkeypatch.setattr(B, "CELLS", 500)
    for job, c, got in zip(jobs, centres, B._grouped(list(zip(jobs, centres, strict=True)), u, x, g), strict=True):
        mine = B._seen(job, u, x, g)[1]
        d = ((mine[:, None] - c) ** 2).sum(axis=2)
        one = d.argmin(axis=1)[:, None] == np.arange(job.k)
        assert got == pytest.approx(np.concatenate([[d.min(axis=1).sum()], one.sum(axis=0), (one.T.astype(float) @ mine).ravel()]))
