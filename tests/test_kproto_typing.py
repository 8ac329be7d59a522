"""k-prototypes and typing rules: planted groups, empty groups, training and scoring alike."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import gower, kproto, typing
from cohortlens.streaming import scoring

KINDS = {"q1": gower.ORDINAL, "q2": gower.ORDINAL, "spend": gower.NUMERIC, "brand": gower.NOMINAL}


def mixed(spark, seed=0, n=60, order=None):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(3):
        for i in range(n):
            rows.append((g * n + i, float(np.clip(1 + 2 * g + rng.integers(-1, 2), 1, 5)), float(np.clip(5 - 2 * g + rng.integers(-1, 2), 1, 5)), 10.0 * g + float(rng.normal()), "xyz"[g] if rng.random() < 0.9 else "w"))
    rows = rows if order is None else [rows[i] for i in order]
    return spark.createDataFrame(rows, "id bigint, q1 double, q2 double, spend double, brand string")


@pytest.mark.parametrize("order", [None, "reversed", "shuffled"])
def test_planted_groups_in_any_order(spark, order):
    at = {None: None, "reversed": list(range(179, -1, -1)), "shuffled": list(np.random.default_rng(1).permutation(180))}[order]
    df = mixed(spark, order=at).repartition(3)
    spec = gower.fit_spec(df, KINDS)
    e = gower.encode(df, spec)
    best = kproto.fit(e, spec, 3, starts=4)
    own = {r["id"]: r["segment"] for r in kproto.assign(e, spec, best.rows).select("id", "segment").collect()}
    match = max(sum(own[i] == p[i // 60] for i in range(180)) for p in itertools.permutations(range(3)))
    assert match > 170
    assert best.cost == pytest.approx(kproto.assign(e, spec, best.rows).agg(F.sum("d")).first()[0])


def test_seeds_lie_apart(spark):
    df = mixed(spark)
    spec = gower.fit_spec(df, KINDS)
    drawn = kproto.seed(gower.encode(df, spec), spec, 3, list(range(12)))
    groups = [{round(r["spend"] / 10) for r in rows} for rows in drawn]
    assert sum(len(g) == 3 for g in groups) >= 7  # drawn evenly, two in nine would


def test_an_empty_group_restarts_at_the_worst_served(spark):
    df = mixed(spark)
    spec = gower.fit_spec(df, KINDS)
    e = gower.encode(df, spec)
    a, b = (e.filter(f"id = {i}").select(*KINDS).first().asDict() for i in (0, 60))
    best = kproto.fit(e, spec, 3, first=[[a, b, dict(b)]])  # nobody is nearest to a copy
    assert kproto.assign(e, spec, best.rows).select("segment").distinct().count() == 3


def test_fewer_patterns_than_groups_settle(spark):
    df = spark.createDataFrame([(i, float(i % 2), "ab"[i % 2]) for i in range(20)], "id bigint, x double, y string")
    spec = gower.fit_spec(df, {"x": gower.NUMERIC, "y": gower.NOMINAL})
    best = kproto.fit(gower.encode(df, spec), spec, 3, starts=2)
    assert best.cost == 0 and kproto.assign(gower.encode(df, spec), spec, best.rows).select("segment").distinct().count() == 2


def trained(spark):
    df = mixed(spark)
    spec = gower.fit_spec(df, KINDS)
    e = gower.encode(df, spec)
    best = kproto.fit(e, spec, 3, starts=2)
    return df, e, spec, best


def test_rules_score_as_at_training(spark):
    df, e, spec, best = trained(spark)
    rule = typing.from_json(typing.to_json(typing.gower_rule(spec, best.rows)))
    got = typing.score(rule, df).select("id", "segment")
    assert got.exceptAll(kproto.assign(e, spec, best.rows).select("id", "segment")).count() == 0 and got.count() == 180


def test_rules_take_words_gaps_and_unseen_answers(spark):
    _, _, spec, best = trained(spark)
    words = {"never": 1, "seldom": 2, "sometimes": 3, "often": 4, "always": 5}
    rule = typing.gower_rule(spec, best.rows, {"q1": words, "q2": words})
    rows = [(1, "Never", "always ", 0.0, "x"), (2, "1", "5", 0.0, "x"), (3, "never", "always", 0.0, "unheard of"), (4, "never", "always", 0.0, None), (5, None, "who knows", None, "x"), (6, "always", "never", float("inf"), "z")]
    new = spark.createDataFrame(rows, "id int, q1 string, q2 string, spend double, brand string")
    got = {r["id"]: r for r in typing.score(rule, new).collect()}
    assert got[1]["segment"] == got[2]["segment"] == got[3]["segment"] == got[4]["segment"] and got[1]["confidence"] == got[2]["confidence"]
    assert got[3]["confidence"] == got[4]["confidence"] < got[1]["confidence"]
    assert got[5]["segment"] is not None and got[6]["segment"] != got[1]["segment"]
    with pytest.raises(ValueError, match="_UNSCORABLE_ITEM:brand"):
        typing.score(rule, new.drop("brand"))
    assert typing.score(rule, new.filter("id < 0")).count() == 0


def test_mixed_rules_work_on_streams(spark, tmp_path):
    df, _, spec, best = trained(spark)
    rule = typing.gower_rule(spec, best.rows)
    df.write.parquet(str(tmp_path / "in"))
    s = scoring.score_stream(spark, rule, str(tmp_path / "in"), "id bigint, q1 double, q2 double, spend double, brand string")
    scoring.run(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), typing.score(rule, df)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 180


def brute_cv(rows, scaling):
    import hashlib

    sizes = {s: sum(r[1] == s for r in rows) for s in {r[1] for r in rows}}
    folds = min(5, *sizes.values())
    fold = {}
    for s in sizes:
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, t, _ in rows if t == s)
        fold |= {i: n % folds for n, (_, i) in enumerate(ids)}
    hits = dict.fromkeys(sizes, 0)
    for f in range(folds):
        train = np.array([x for i, _, x in rows if fold[i] != f])
        w = {"range": np.ptp(train, axis=0), "standardize": train.std(axis=0), "robust": np.subtract(*np.percentile(train, [75, 25], axis=0)), "none": np.ones(train.shape[1])}[scaling]
        w = np.where(w > 0, w, 1.0)
        c = {s: np.mean([x for i, t, x in rows if fold[i] != f and t == s], axis=0) for s in sizes}
        for i, s, x in rows:
            if fold[i] == f:
                hits[s] += min(sorted(c), key=lambda t: (((np.array(x) - c[t]) / w) ** 2).sum()) == s
    return {s: hits[s] / sizes[s] for s in sizes}, sum(hits.values()) / len(rows)


@pytest.mark.parametrize("scaling", ["range", "standardize", "robust", "none"])
def test_cross_validation_refits_scaling(spark, scaling):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(v) for v in rng.normal([i % 3, 0, 5 * (i % 3)], [1, 100, 4])]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, segment bigint, f array<double>").repartition(3)
    got = typing.cv_typing(df, scaling).collect()
    recall, accuracy = brute_cv(rows, scaling)
    assert {r["segment"]: r["recall"] for r in got} == pytest.approx(recall) and got[0]["accuracy"] == pytest.approx(accuracy)
    assert got[0]["lift"] == pytest.approx(accuracy - 40 / 120)


def test_cross_validation_refuses_tiny_classes(spark):
    tiny = spark.createDataFrame([(i, int(i == 0), [float(i)]) for i in range(20)], "id bigint, segment bigint, f array<double>")
    assert [(r["recall"], r["accuracy"]) for r in typing.cv_typing(tiny).collect()] == [(None, None)] * 2
    assert typing.cv_typing(tiny.filter("id < 0")).count() == 0
