"""The classifiers' solvers against plain ones on small samples."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import linear, quality, toxicity


def sample_of(rows):
    """A Sample of (label, features)."""
    return linear.Sample(pa.table({"doc_id": list(range(len(rows))), "label": pa.array([y for y, _ in rows], pa.int32()), "features": pa.array([sorted(f) for _, f in rows], pa.list_(pa.int32()))}))


def some_rows(seed, n=40, features=25):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = i % 2
        out.append((y, {f for f in range(features) if rng.random() < (0.5 if f % 3 == y else 0.2)} | {features + y}))
    return out


def plain_ratio(rows, alpha=1.0):
    n = [sum(y == c for y, _ in rows) for c in (0, 1)]
    out = {}
    for f in set().union(*(fs for _, fs in rows)):
        k = [sum(y == c and f in fs for y, fs in rows) for c in (0, 1)]
        out[f] = np.log((k[1] + alpha) / (n[1] + 2 * alpha)) - np.log((k[0] + alpha) / (n[0] + 2 * alpha))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_log_count_ratios(seed):
    rows = some_rows(seed)
    got = quality.log_ratio(sample_of(rows), np.ones(len(rows), bool))
    want = plain_ratio(rows)
    assert {f: pytest.approx(got[f]) for f in want} == want and not np.delete(got, list(want)).any()


@pytest.mark.parametrize("cost", [0.05, 1.0])
def test_dual_descent_reaches_the_plain_optimum(cost):
    """The hinge-loss optimum is unique; a plain ascent on the matrix of products, in fixed order, finds the same weights."""
    rows = some_rows(3) + [(1, {0, 3}), (1, {6})]  # more of class 1
    s, n = sample_of(rows), len(rows)
    everyone = np.ones(n, bool)
    ratio = quality.log_ratio(s, everyone)
    w = quality.dual_descent(s, everyone, ratio, cost, epochs=3000)
    wide = 27
    x = np.array([[ratio[f] if f in fs else 0.0 for f in range(wide)] + [1.0] for _, fs in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    upper = np.array([cost * n / (2 * (y == v).sum()) for v in y])
    gram, alpha = (x @ x.T) * np.outer(y, y), np.zeros(n)
    for _ in range(4000):
        for i in range(n):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1), 0.0), upper[i])
    want = (alpha * y) @ x
    assert np.allclose(np.append(w[:wide], w[-1]), want, atol=1e-4)
    primal = 0.5 * want @ want + (upper * np.maximum(0, 1 - y * (x @ want))).sum()
    assert primal == pytest.approx(alpha.sum() - 0.5 * want @ want, rel=1e-4)


@pytest.mark.parametrize("penalty", [0.0, 4.0])
def test_counterfactual_fit_descends_the_plain_objective(penalty):
    """Adam on differences of the objective: weighted log loss, squared score changes of twins, ridge."""
    swaps, steps, ridge = 1, 12, 1e-2
    rng = random.Random(4)
    rows, ids = [], []
    for i, (y, fs) in enumerate(some_rows(5, n=40, features=12)):
        rows.append((y, fs | {20 + (rng.random() < (0.8 if y else 0.2))}))
        ids.append(2 * i)
        if i % 2 == 0 or i % 3 == 0:
            rows.append((y, (rows[-1][1] - {20, 21}) | ({20, 21} - rows[-1][1])))
            ids.append(2 * i + 1)
    s, ids = sample_of(rows), np.array(ids)
    first = ids % 2 == 0
    aside = (ids // 2) % 5 == 4
    use, twin = first & ~aside, ~first & ~aside
    ratio = plain_ratio([r for r, u in zip(rows, use, strict=True) if u])
    kept = sorted(f for f in ratio if sum(f in rows[i][1] for i in np.flatnonzero(use)) >= 3)
    x = np.array([[abs(ratio[f]) if f in fs else 0.0 for f in kept] for _, fs in rows])
    y = np.array([label for label, _ in rows], float)
    share = np.where(y == 1, 0.5 / (use & (y == 1)).sum(), 0.5 / (use & (y == 0)).sum()) * use
    own = np.array([np.flatnonzero(ids == i - i % 2)[0] for i in ids])

    def objective(v):
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        loss = -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        return loss + penalty * ((p - p[own])[twin] ** 2).sum() / twin.sum() + ridge / 2 * (v[:-1] ** 2).sum()

    v, m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        g = np.array([(objective(v + e) - objective(v - e)) / 2e-5 for e in 1e-5 * np.eye(len(v))])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v = v - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    judged = first & aside
    scaled = v[:-1] * np.array([abs(ratio[f]) for f in kept])
    slope, offset = linear.calibrate((x @ v[:-1] + v[-1])[judged], s.label[judged])
    weights, b = toxicity.fit(s, ids, swaps, penalty=penalty, ridge=ridge, steps=steps)
    assert np.allclose(weights[kept], scaled * slope, rtol=2e-3, atol=2e-4) and b == pytest.approx(v[-1] * slope + offset, rel=2e-3, abs=2e-3)
    assert not np.delete(weights, kept).any()
