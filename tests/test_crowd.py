"""Fits whose steps are taken inside one barrier stage."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from cohortlens.operators import batch as B
from cohortlens.operators import choice, crowd


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, f array<double>")


def plans(spark, name, work):
    """What ``work`` gives, and how many stages each job had that it started."""
    spark.sparkContext.setJobGroup(name, "")
    try:
        out, tracker = work(), spark.sparkContext.statusTracker()
        return out, [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_all_steps_are_one_stage(spark, monkeypatch):
    """Every seed and every step was a job of its own; the fits are those of a stage a step."""
    x = np.random.default_rng(1).random((400, 3))
    data = B.prepared(frame(spark, x))
    jobs = [B.Job(3, s) for s in range(3)] + [B.Job(2, 0, B.half(1), (0, 2))]
    fits, jobs_run = plans(spark, "crowd", lambda: B.kmeans(data, jobs))
    mixed, more = plans(spark, "crowd2", lambda: B.mixtures(data, [B.Fit(replace(fits[0].job, kind=k), fits[0].centres) for k in B.SHAPES]))
    assert sum(jobs_run) <= 4 and sum(more) <= 4
    monkeypatch.setattr(B, "places", lambda spark: 0)
    for a, b in zip(fits, B.kmeans(data, jobs), strict=True):
        assert np.allclose(a.centres, b.centres, atol=1e-9) and a.inertia == pytest.approx(b.inertia) and a.sizes.tolist() == b.sizes.tolist()
    for a, b in zip(mixed, B.mixtures(data, [B.Fit(m.job, fits[0].centres) for m in mixed]), strict=True):
        assert a.loglik == pytest.approx(b.loglik)


def test_errors_and_warnings_of_a_crowd_are_the_caller_s(spark):
    def work(c, batches):
        import warnings

        n = c.sum(np.array([sum(b.num_rows for b in batches), 1]))
        warnings.warn(f"rows {n[0]} of tasks {n[1]}", stacklevel=1)
        if n[0] > 5:
            raise ValueError("_MANY")
        return n.tolist()

    with pytest.warns(UserWarning, match="rows 5 of tasks 4"):
        assert crowd.agreed(spark.range(5), work) == [5, 4]
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="^_MANY$"):
        crowd.agreed(spark.range(6), work)
    with pytest.raises(ValueError, match="_NO_PEOPLE"):
        B.kmeans(B.prepared(frame(spark, np.zeros((0, 2)))), [B.Job(2)])


def test_null_tables_come_from_people_who_are_held(spark, monkeypatch):
    """F8: the people were made anew from the tables for their axes, their bounds and their number."""
    people = frame(spark, np.random.default_rng(2).random((50, 3)))
    want = sorted(map(tuple, B.null_people(people, 2).collect()))
    data = B.held(people)
    monkeypatch.setattr(B, "prepared", lambda people: 1 / 0)
    assert np.allclose([r[1] for r in want], [r[1] for r in sorted(map(tuple, B.null_people(data, 2).collect()))])
    data.unpersist()


def test_a_chain_s_people_lie_over_tasks(spark):
    """each chain held everybody in one task."""
    rows = [(p, s, f"i{(p + s + j) % 4}", ["best", "", "worst"][j]) for p in range(30) for s in range(2) for j in range(3)]
    draws, people = choice.hb_utilities(spark.createDataFrame(rows, "respondent_id bigint, set bigint, item string, choice string"), steps=30, burn=10)
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert draws.count() == 2 * 4 * 4 and {r["n_used"] for r in draws.collect()} == {30} and people.count() == 30 * 4


def test_sets_by_size_give_the_likelihood():
    """sets of any size are gathered place by place."""
    rng = np.random.default_rng(4)
    who = np.sort(rng.integers(0, 9, 60))
    shown = np.full((60, 5), -1)
    for r in shown:
        k = rng.integers(2, 6)
        r[:k] = np.sort(rng.permutation(6)[:k])
    best, worst = shown[:, 0], np.array([r[r >= 0][-1] for r in shown])
    beta = rng.normal(size=(9, 5))
    u = np.concatenate([beta, -beta.sum(axis=1, keepdims=True)], axis=1)
    want = np.zeros(9)
    for w, r, b, x in zip(who, shown, best, worst, strict=True):
        r = r[r >= 0]
        want[w] += u[w, b] - np.log(np.exp(u[w, r]).sum()) - u[w, x] - np.log(np.exp(-u[w, r[r != b]]).sum())
    assert np.allclose(choice._Sets(best, shown, worst, who, 9, 6).loglik(beta), want)


def test_sums_of_subsets_give_the_likelihood_block_by_block(spark, monkeypatch):
    """a set of m items took m look-ups and a logarithm of its own; also where utilities lie too far apart for sums of powers."""
    monkeypatch.setattr(choice, "BLOCK", 4)
    rng = np.random.default_rng(6)
    who = np.sort(rng.integers(0, 11, 70))
    shown = np.full((70, 6), -1)
    for r in shown:
        k = rng.integers(2, 7)
        r[:k] = np.sort(rng.permutation(7)[:k])
    best, worst = shown[:, 0], np.array([r[r >= 0][-1] for r in shown])
    sets = choice._Sets(best, shown, worst, who, 12, 7)
    assert [len(rows) for _, _, rows, _, _ in sets.blocks] == [3, 3, 3] and len(choice._Sets(best, shown, worst, who, 12, 7).blocks) == 3
    for wide in (1.0, 30.0, 200.0):
        beta = rng.normal(size=(12, 6)) * wide
        u = np.concatenate([beta, -beta.sum(axis=1, keepdims=True)], axis=1)
        want = np.zeros(12)
        for w, r, b, x in zip(who, shown, best, worst, strict=True):
            r = r[r >= 0]
            want[w] += u[w, b] - np.logaddexp.reduce(u[w, r]) - u[w, x] - np.logaddexp.reduce(-u[w, r[r != b]])
        got = sets.loglik(beta)
        assert np.allclose(got, want) if wide < 200 else np.isfinite(got).all()
