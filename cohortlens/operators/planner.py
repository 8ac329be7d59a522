"""Study planning by simulation: how often a design of a given size finds the groups that are there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as N
from .panel import grid

#: Separation of neighbouring groups (Cohen's d) in each regime.
REGIMES = {"obvious": 2.0, "moderate": 1.0, "subtle": 0.6}


def simulate(n: int, questions: int, groups: int, effect: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(answers 1 to 5, groups): each group leans up on its own third of the questions and down on the next; refuses an effect off the scale.

    The lean is such that neighbouring groups' means are ``effect`` times the spread apart, on average over questions.
    """
    spread = 0.8
    own = np.arange(n) % groups
    shape = np.array([[1.0 if (q + g) % groups == 0 else -1.0 if (q + g) % groups == 1 else 0.0 for q in range(questions)] for g in range(groups)])
    lean = effect * spread / np.abs(np.diff(shape, axis=0)).mean() if groups > 1 else 0.0
    if 3 + lean > 5:
        raise ValueError("_PLAN_TOO_TIGHT")
    x = 3 + lean * shape[own] + spread * rng.standard_normal((n, questions))
    return np.clip(np.rint(x), 1, 5), own


def _run(shared: object, kind: str, k: int, rep: int) -> dict:
    sizes, questions, groups, seed = shared  # type: ignore[misc]
    n = sizes[rep // 1000]
    rng = np.random.default_rng([seed, list(REGIMES).index(kind), rep])
    x, own = simulate(n, questions, groups, REGIMES[kind], rng)
    scores = {}
    for j in range(2, min(6, n // 2) + 1):
        lab = N.kmeans(x, j, rng, 4)[0]
        half = rng.permutation(n)[: int(0.8 * n)]
        scores[j] = (N.silhouette(x, lab) + N.ari(N.kmeans(x[half], j, rng, 4)[0], lab[half]), lab)
    found = max(scores, key=lambda j: (scores[j][0], -j))
    return {"n_people": n, "found_k": found, "ari": N.ari(scores[found][1], own), "surest": float(scores[found][0])}


def sweep(spark: SparkSession, sizes: tuple[int, ...] = (50, 75, 100, 150, 200, 300, 400), questions: int = 6, groups: int = 3, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(regime, n_people, hit_rate, ari, runs): the share of simulated studies of each size that find the right number of groups."""
    tasks = [(r, groups, 1000 * i + j) for r in REGIMES for i in range(len(sizes)) for j in range(repeats)]
    runs = grid(spark, tasks, (sizes, questions, groups, seed), _run, "n_people int, found_k int, ari double, surest double")
    return runs.groupBy(F.col("kind").alias("regime"), "n_people").agg(F.avg((F.col("found_k") == F.col("k")).cast("double")).alias("hit_rate"), F.avg("ari").alias("ari"), F.count(F.lit(1)).alias("runs"))
