"""Properties and planted truth of the survey operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import tails
from cohortlens.operators import choice, design, gower, kernels, latent, panel, profiling, reach, scaling, segments, typing, validity


def planted(spark, n=240, items=5, groups=3, seed=1):
    rng = np.random.default_rng(seed)
    own = np.arange(n) % groups
    centres = rng.normal(0, 3, (groups, items))
    x = centres[own] + rng.normal(0, 1, (n, items))
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, f array<double>"), own, x


def test_tails_against_tables():
    assert tails.f_tail(4.10, 2, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)


def test_midranks_and_nearest_level(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 5.0)], "x double")
    assert {r["value"]: r["midrank"] for r in gower.midranks(df, "x").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}
    levels = spark.createDataFrame([(1.0,), (3.0,)], "value double")
    near = gower.nearest_levels(spark.createDataFrame([(2.0,), (0.0,), (9.0,)], "x double"), levels, "x")
    assert {r["x"]: r["level"] for r in near.collect()} == {2.0: 1.0, 0.0: 1.0, 9.0: 3.0}


def test_gower_is_manhattan_of_embedding_and_spec_survives_json(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(rng.integers(1, 6)), float(rng.normal(50, 10)), "abc"[rng.integers(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, o double, n double, c string")
    spec = gower.fit_spec(df, {"o": gower.ORDINAL, "n": gower.NUMERIC, "c": gower.NOMINAL})
    spec = gower.GowerSpec.from_json(spec.to_json())
    e = gower.encode(df, spec)
    from cohortlens.functions.columns import manhattan

    a, b = e.alias("a"), e.alias("b")
    cols = lambda t: {c: F.col(f"{t}.{c}") for c in ("o", "n", "c")}
    gap = F.abs(gower.distance(spec, cols("a"), cols("b")) - manhattan(gower.embedding(spec, cols("a")), gower.embedding(spec, cols("b"))) / 3)
    assert a.crossJoin(b).agg(F.max(gap)).first()[0] < 1e-9


def test_scaling_of_a_constant_item_divides_by_one(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0)], "id int, item string, x double")
    for how in ("range", "standardize", "robust"):
        assert {r["x"] for r in scaling.scale(long, how).collect()} == {0.0}


def test_full_kmeans_finds_planted_groups(spark):
    people, own, _ = planted(spark)
    got = panel.final_segments(people, 3).select("id", "segment").toPandas().sort_values("id")
    assert kernels.ari(got["segment"].to_numpy(), own) > 0.95


def test_panel_recommends_planted_k(spark):
    people, _, _ = planted(spark, n=180)
    d = panel.diagnostics(people, range(2, 6), gaps=4, subsamples=4, splits=3, consensus=6)
    assert validity.recommend_k(validity.signals(d)).first()["k"] == 3


def test_models_find_planted_groups():
    rng = np.random.default_rng(3)
    own = np.arange(150) % 3
    x = np.array([[0, 0], [6, 0], [0, 6]])[own] + rng.normal(0, 1, (150, 2))
    for kind in ("full", "tied", "diag", "spherical"):
        assert kernels.ari(kernels.mixture(x, 3, np.random.default_rng(1), kind)["labels"], own) > 0.95
    d = np.sqrt(kernels.sq_distances(x, x))
    assert kernels.ari(kernels.linkage_labels(d.copy(), 3, "ward"), own) > 0.95
    assert kernels.ari(kernels.linkage_labels(d.copy(), 3, "average"), own) > 0.9
    codes = np.where(rng.random((150, 6)) < 0.9, (own[:, None] + np.arange(6)) % 2, rng.integers(0, 2, (150, 6)))
    assert kernels.latent(codes, [2] * 6, 2, np.random.default_rng(0))["loglik"] > -700
    mixed = np.column_stack([x[:, 0], own.astype(float)])
    lab, _, _ = kernels.kproto(mixed, 3, np.random.default_rng(0), np.array([False, True]), np.array([np.ptp(x[:, 0]), 1.0]), [None, None])
    assert kernels.ari(lab, own) > 0.9


def test_dip_tells_two_humps_from_one():
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(-4, 1, 200), rng.normal(4, 1, 200)])
    assert kernels.dip(two) > 3 * kernels.dip(rng.normal(0, 1, 400))


def test_em_never_lowers_the_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"q{j}", str(int(rng.random() < (0.9 if i % 2 == j % 2 else 0.2)))) for i in range(120) for j in range(4)]
    answers = spark.createDataFrame(rows, "id bigint, item string, level string")
    _, one = panel.lca_full(answers, 2, steps=1)
    post, five = panel.lca_full(answers, 2, steps=5)
    assert five >= one
    assert post.groupBy("id").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    pi, theta = latent.m_step(answers, post)
    assert theta.groupBy("item", "class").agg(F.sum("theta").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    assert abs(pi.agg(F.sum("pi")).first()[0] - 1) < 1e-9


def test_bh_definition(spark):
    p = spark.createDataFrame(list(zip("abcde", [0.01, 0.02, 0.03, 0.04, 0.5], strict=True)), "name string, p double")
    assert {r["name"] for r in profiling.bh_fdr(p).filter("significant").collect()} == set("abcd")


def test_scoring_does_not_depend_on_the_batch_and_counts_off_scale(spark):
    rule = typing.centroid_rule(["a", "b"], "range", {"a": (1.0, 4.0), "b": (1.0, 4.0)}, [[0.0, 0.0], [1.0, 1.0]])
    rows = [("x", 1.0, 1.0), ("y", 5.0, 4.0), ("z", 99.0, None)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    whole = {r["id"]: (r["segment"], r["confidence"], r["off_scale"]) for r in typing.score(typing.from_json(typing.to_json(rule)), df).collect()}
    assert [whole[i][0] for i in "xyz"] == [0, 1, 1] and whole["z"][2] == 1
    for row in rows:
        r = typing.score(rule, spark.createDataFrame([row], df.schema)).first()
        assert (r["segment"], r["confidence"], r["off_scale"]) == whole[row[0]]
    with pytest.raises(ValueError, match="_UNSCORABLE_ITEM:b"):
        typing.classify(rule, df.drop("b"))


def test_ranking_from_hand_draws(spark):
    draws = [[0, 2, 1], [0, 2, 1], [0, 1, 2], [0, 2, 1]]
    df = spark.createDataFrame([(i, "abc"[j], float(v)) for i, d in enumerate(draws) for j, v in enumerate(d)], "draw int, item string, value double")
    got = choice.ranking(df).orderBy("rank").collect()
    assert [r["item"] for r in got] == ["b", "c", "a"] and [r["prob_ahead"] for r in got] == [0.75, 1.0, None]


def test_choice_columns_and_codings(spark):
    df = spark.createDataFrame([("p", 1, "x", "1"), ("p", 1, "y", "-1"), ("p", 1, "z", "0")], "id string, block int, issue string, value string")
    assert choice.looks_like_choices(df)
    assert {r["item"]: r["choice"] for r in choice.read_choices(df).collect()} == {"x": "best", "y": "worst", "z": ""}
    assert choice.valid_sets(choice.read_choices(df)).count() == 3
    words = spark.createDataFrame([("p", 1, "x", "Bäst"), ("p", 1, "y", "sämst")], df.schema)
    assert [r["choice"] for r in choice.read_choices(words).orderBy("item").collect()] == ["best", "worst"]
    ratings = spark.createDataFrame([("p", 1, "x", "5")], df.schema)
    assert not choice.looks_like_choices(ratings)


def test_wide_export(spark):
    rows = [(i, *[3 if j == i % 3 else 1 if j == (i + 1) % 3 else 2 for j in range(3)] * 2) for i in range(20)]
    df = spark.createDataFrame(rows, "rid int, Q1_1 int, Q1_2 int, Q1_3 int, Q2_1 int, Q2_2 int, Q2_3 int")
    assert choice.wide_choice_groups(df) == 2
    tidy = choice.from_wide(df, "rid", 3, 1)
    assert tidy.filter("choice = 'best'").count() == 40
    with pytest.raises(ValueError):
        choice.from_wide(df, "rid", 3, 3)


def test_hierarchical_utilities_follow_counts(spark):
    rng = np.random.default_rng(2)
    u = np.array([2.0, 1.0, 0.0, -1.0, -2.0])
    rows = []
    for p in range(60):
        for s in range(6):
            shown = rng.permutation(5)[:4]
            order = shown[np.argsort(-(u[shown] + rng.gumbel(size=4)))]
            rows += [(p, s, f"i{x}", "best" if x == order[0] else "worst" if x == order[-1] else "") for x in shown]
    long = spark.createDataFrame(rows, "respondent_id bigint, set bigint, item string, choice string")
    draws, people = choice.hb_utilities(long, steps=600, burn=300, chains=1)
    mean = {r["item"]: r["u"] for r in people.groupBy("item").agg(F.avg("u").alias("u")).collect()}
    assert sorted(mean, key=lambda i: -mean[i]) == ["i0", "i1", "i2", "i3", "i4"]
    assert choice.split_rhat(draws.drop("chain")).first()["rhat"] < 1.5


def test_panel_defaults_are_the_reference_s_counts(spark):
    import inspect

    from cohortlens.operators import planner

    default = lambda f, *names: [inspect.signature(f).parameters[n].default for n in names]
    assert default(panel.diagnostics, "ks", "gaps", "subsamples", "splits", "consensus") == [range(2, 9), 20, 30, 10, 50]
    assert default(panel.bootstrap_jaccard, "reps") == [100] and default(reach.holdout, "splits") == [40]
    assert default(planner.sweep, "sizes", "repeats") == [(50, 75, 100, 150, 200, 300, 400), 5]


def test_registered_panels_use_the_defaults(spark, data, monkeypatch):
    from cohortlens.operators import planner
    from cohortlens.plans import catalog, fitting

    for module, name, query in ((panel, "diagnostics", "panel_full"), (panel, "bootstrap_jaccard", "clusterboot_jaccard"), (reach, "holdout", "turf_holdout"), (planner, "sweep", "planner_sweep"), (panel, "gmm_full", "gmm_full"), (panel, "lca_full", "lca_full")):
        given = {}
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, g=given, **b: g.update(b) or (_ for _ in ()).throw(KeyError))
        with pytest.raises(KeyError):
            catalog.QUERIES[query](spark, data)
        monkeypatch.setattr(module, name, whole)
        assert not given
    assert {r["k"] for r in fitting.panel_full(spark, data).select("k").collect()} == {2, 3}  # 15 people


def test_mixture_runs_until_it_settles(spark):
    people, _, _ = planted(spark, n=150)
    _, _, _, ll = panel.gmm_full(people, 3)
    assert panel.gmm_full(people, 3, steps=60)[3] == pytest.approx(ll, rel=1e-5)
    with pytest.warns(UserWarning, match="_NOT_SETTLED"):
        panel.gmm_full(people, 3, steps=1)


def test_partitions_are_of_everybody_or_not_computed(spark):
    people, own, _ = planted(spark, n=1800)
    got = {r["id"]: r["cluster"] for r in panel.consensus_partition(people, 3, reps=3).collect()}
    assert len(got) == 1800 and None not in got.values()
    few = panel.consensus_partition(people, 3, reps=3, most=1799).collect()
    assert len(few) == 1800 and {r["cluster"] for r in few} == {None}
    final = panel.final_segments(people, 3)
    one = panel.ward_agreement(people, final, 3).first()
    assert one["n_used"] == 1800 and one["ari"] > 0.9
    assert panel.ward_agreement(people, final, 3, most=1799).first()["ari"] is None


def test_hierarchical_utilities_are_of_everybody(spark):
    rows = [(p, s, f"i{(p + s + j) % 4}", ["best", "", "worst"][j]) for p in range(2100) for s in range(2) for j in range(3)]
    long = spark.createDataFrame(rows, "respondent_id bigint, set bigint, item string, choice string")
    draws, people = choice.hb_utilities(long, steps=60, burn=10, chains=1)
    assert people.select("respondent_id").distinct().count() == 2100
    one = draws.select("rhat", "n_used").distinct().collect()
    assert len(one) == 1 and one[0]["n_used"] == 2100
    assert np.isclose(choice.split_rhat(draws).first()["rhat"], one[0]["rhat"])


def test_unsettled_chains_are_drawn_longer(monkeypatch):
    lengths, data = ((60, 10), (90, 10), (120, 10)), (np.array([0, 1]), np.array([[0, 1, 2], [0, 1, 2]]), np.array([2, 2]), np.array([0, 1]), 2, 3, 1)
    for settled, kept in ((1e9, 10), (0.0, 22)):
        monkeypatch.setattr(choice, "SETTLED", settled)
        assert len(choice._settled(lengths, *data)[0]) == kept


def test_reach_greedy_equals_exhaustive_on_clear_data(spark, monkeypatch):
    hits = spark.createDataFrame([(p, i) for p in range(60) for i in (["a"] if p < 30 else ["b", "d"] if p < 50 else ["c"])], "id int, item string")
    items = list("abcd")
    full = reach.best_set(hits, items, 2)
    monkeypatch.setattr(reach, "EXHAUSTIVE", 0)
    greedy = reach.best_set(hits, items, 2)
    assert full[:2] == greedy[:2] == (["a", "b"], 50) and full[3] == 2
    assert reach.holdout(hits, items, 2, splits=4).filter("reach > 0.6").count() == 4


def test_design_shows_items_evenly(spark):
    long = design.make_design(spark, list("abcdefgh"), 4, 6, 20, block=10)
    one = design.describe(long.withColumnRenamed("task", "set")).first()
    assert one["never"] == 0 and one["shown_max"] - one["shown_min"] <= 2
    assert long.groupBy("respondent_id", "task").agg(F.countDistinct("item").alias("n")).filter("n <> 4").count() == 0
    with pytest.raises(ValueError, match="_DESIGN_TOO_FEW_ITEMS"):
        design.make_design(spark, ["a"], 2, 1, 1)


def test_lloyd_never_raises_the_objective(spark):
    people, _, _ = planted(spark, n=90)
    c = segments.first_centres(people, 3)
    cost = [segments.assign(people, segments.lloyd(people, c, s)).agg(F.sum("d2")).first()[0] for s in (0, 1, 3)]
    assert cost[0] >= cost[1] >= cost[2]


@pytest.mark.parametrize(("questions", "groups"), [(6, 2), (6, 3), (8, 4)])
def test_simulated_groups_are_as_far_apart_as_asked(questions, groups):
    from cohortlens.operators import planner

    x, own = planner.simulate(60000, questions, groups, 1.0, np.random.default_rng(3))
    means = np.array([x[own == g].mean(axis=0) for g in range(groups)])
    assert np.abs(np.diff(means, axis=0)).mean() / 0.8 == pytest.approx(1.0, rel=0.05)
    with pytest.raises(ValueError, match="_PLAN_TOO_TIGHT"):
        planner.simulate(10, questions, groups, 9.0, np.random.default_rng(3))


def test_a_screen_must_leave_items_out(spark):
    from cohortlens.operators import design

    with pytest.raises(ValueError, match="_DESIGN_TOO_FEW_ITEMS"):
        design.make_design(spark, ["a", "b", "c"], 3, 2, 4)


def test_silhouette_compares_everybody(spark, monkeypatch):
    """over 6,000 people rows were left out and distances sampled."""
    rng = np.random.default_rng(3)
    x, lab = rng.random((6_100, 2)), np.arange(6_100) % 3
    monkeypatch.setattr(validity, "TILE", 2_000)
    df = spark.createDataFrame([(i, int(s), [float(v) for v in f]) for i, (f, s) in enumerate(zip(x, lab, strict=True))], "id bigint, segment bigint, f array<double>")
    got = {r["id"]: r["silhouette"] for r in validity.silhouette(df).collect()}
    assert len(got) == 6_100
    for i in (0, 1, 6_099):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        m = [d[lab == s].sum() / ((lab == s).sum() - (s == lab[i])) for s in range(3)]
        a, b = m[lab[i]], min(m[s] for s in range(3) if s != lab[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-12


def test_pac_counts_pairs_by_pattern(spark, monkeypatch):
    """no row for each pair of ids; the same share as from all pairs."""
    rng = np.random.default_rng(4)
    rows = [(r, i, int(rng.integers(3))) for r in range(4) for i in range(60) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "rep bigint, id bigint, label bigint")
    monkeypatch.setattr(validity, "PATTERNS", 10)
    assert abs(validity.pac_of_labels(df).first()["pac"] - validity.pac(validity.consensus(df)).first()["pac"]) < 1e-12
    plan = validity.pac_of_labels(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
