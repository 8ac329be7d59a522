"""Latent classes in batches: all numbers of classes, starts, halves and resamples advance in one scan a step.

Answers become code arrays once, and people with the same answers one row with a count for each part of the people, so that a step reads
as many rows as there are different answer patterns and moves nobody.  In a step each task turns its patterns into a 0/1 matrix; posteriors
and the sums that the next shares need are matrix products for each model.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B


@dataclass
class Coded:
    """Answer patterns (u, f: codes, w: people of each part), the level of each code and the number of people of each part."""

    patterns: DataFrame
    levels: list[tuple[str, str]]
    parts: list[B.Part]
    n: np.ndarray

    @property
    def item_of(self) -> np.ndarray:
        return np.unique([i for i, _ in self.levels], return_inverse=True)[1]

    def params(self, k: int) -> int:
        return k - 1 + k * (len(self.levels) - len({i for i, _ in self.levels}))


def coded(answers: DataFrame, parts: list[B.Part]) -> Coded:
    """From (id, item, level); a null level is no answer.  Items and levels are a questionnaire's, few."""
    spark = answers.sparkSession
    told = answers.filter("level is not null").select("id", F.col("item").cast("string").alias("item"), F.col("level").cast("string").alias("level"))
    levels = [(r["item"], r["level"]) for r in told.select("item", "level").distinct().orderBy("item", "level").collect()]
    codes = spark.createDataFrame([(i, lv, c) for c, (i, lv) in enumerate(levels)], "item string, level string, code int")
    people = told.join(codes, ["item", "level"]).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("f"))
    share = {s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1 << 40)) / float(1 << 40) for s in {p[0] for p in parts}}
    inside = [F.sum(((share[s] >= lo) & (share[s] < hi)).cast("bigint")) for s, lo, hi in parts]
    patterns = B.gathered(people.groupBy("f").agg(F.array(*inside).alias("w")).select(F.xxhash64("f").alias("u"), "f", "w"))
    sums = patterns.agg(*(F.coalesce(F.sum(F.col("w")[j]), F.lit(0)).alias(str(j)) for j in range(len(parts)))).first()
    return Coded(patterns, levels, parts, np.array(sums, float))


@dataclass
class Latent:
    job: B.Job
    weights: np.ndarray
    theta: np.ndarray  # levels x classes
    loglik: float = -np.inf
    entropy: float = 0.0
    steps: int = 0

    def logs(self, h: np.ndarray) -> np.ndarray:
        return h @ np.log(self.theta) + np.log(np.maximum(self.weights, 1e-300))

    def label(self, h: np.ndarray) -> np.ndarray:
        return self.logs(h).argmax(axis=1)


def _patterns(levels: int):
    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch.num_rows
        h = np.zeros((n, levels))
        h[np.repeat(np.arange(n), np.diff(batch.column(1).offsets.to_numpy())), batch.column(1).flatten().to_numpy()] = 1
        return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), h, batch.column(2).flatten().to_numpy().reshape(n, -1).astype(float)

    return matrix


def fit(c: Coded, jobs: list[B.Job], steps: int = 200, tol: float = 1e-6, alpha: float = 0.1) -> list[Latent]:
    """EM for each job from classes dealt to patterns by hash; shares are smoothed by alpha, so that no level is impossible."""
    item_of, part_of = c.item_of, {p: j for j, p in enumerate(c.parts)}
    same_item = (item_of[:, None] == item_of).astype(float)
    out: list[Latent | None] = [None] * len(jobs)
    open_ = list(range(len(jobs)))
    for step in range(steps + 1):
        now = [(jobs[i], out[i], part_of[jobs[i].part]) for i in open_]

        def work(u, h, w, now=now):
            sums = []
            for job, m, part in now:
                own = w[:, part]
                if m is None:
                    r, ll, ent = ((B.uniform(u, job.start, job.k) * job.k).astype(int)[:, None] == np.arange(job.k)).astype(float), 0.0, 0.0
                else:
                    logs = m.logs(h)
                    top = logs.max(axis=1, keepdims=True)
                    r = np.exp(logs - top)
                    total = r.sum(axis=1, keepdims=True)
                    ll = float(own @ (top + np.log(total))[:, 0])
                    r /= total
                    ent = -float(own @ (r * np.log(np.clip(r, 1e-12, 1))).sum(axis=1))
                r = r * own[:, None]
                sums.append(np.concatenate([[ll, ent], r.sum(axis=0), (h.T @ r).ravel()]))
            return sums

        left = []
        for i, s in zip(open_, B.totals(c.patterns, work, _patterns(len(c.levels))), strict=True):
            k = jobs[i].k
            s0, counts = s[2 : 2 + k], s[2 + k :].reshape(-1, k) + alpha
            new = Latent(jobs[i], s0 / max(s0.sum(), 1e-300), counts / (same_item @ counts), float(s[0]) if step else -np.inf, float(s[1]), step)
            settled = step > 1 and abs(new.loglik - out[i].loglik) < tol * (abs(out[i].loglik) + 1)
            if settled:  # what the likelihood and the entropy were told of
                new.weights, new.theta = out[i].weights, out[i].theta
            out[i] = new
            if not settled and step < steps:
                left.append(i)
        open_ = left
        if not open_:
            break
    if open_ or any(m.steps == steps for m in out):
        warnings.warn(f"_NOT_SETTLED: {steps} steps", stacklevel=2)
    return out  # type: ignore[return-value]


def _better(m: Latent) -> float:
    return -m.loglik


def _tables(c: Coded, pairs: list[tuple[Latent, Latent, B.Part]]) -> list[np.ndarray]:
    """People of a part by the classes that two models give them."""
    part_of = {p: j for j, p in enumerate(c.parts)}
    asked = [(a, b, part_of[p]) for a, b, p in pairs]

    def work(u, h, w):
        return [np.bincount(a.label(h) * b.job.k + b.label(h), w[:, p], a.job.k * b.job.k) for a, b, p in asked]

    return [t.reshape(a.job.k, b.job.k) for t, (a, b, _) in zip(B.totals(c.patterns, work, _patterns(len(c.levels))), pairs, strict=True)]


def information(loglik: float, entropy: float, params: int, n: float, k: int) -> tuple[float, float, float]:
    """(BIC, ICL, normalized entropy): ICL adds twice the entropy of the posteriors."""
    bic = -2 * loglik + params * float(np.log(max(n, 1)))
    return bic, bic + 2 * entropy, entropy / (n * float(np.log(k))) if k > 1 and n else 0.0


def select(answers: DataFrame, ks: range = range(2, 9), starts: int = 20, resamples: int = 15, share: float = 0.8, steps: int = 200) -> DataFrame:
    """(k, loglik, n_params, bic, icl, normalized_entropy, stability, split_half), one row for each number of classes.

    stability: the mean adjusted Rand index of the fit and fits to ``share`` of the people, on those.  split_half: of fits to both halves, on the
    second; null where a half has fewer than twice k or ten people.
    """
    halves = [B.half(0), B.half(1)]
    draws = [(2000 + r, 0.0, share) for r in range(resamples)]
    c = coded(answers, [B.EVERYBODY, *halves, *draws])
    fewer = max(3, starts // 2)
    jobs = [B.Job(k, s) for k in ks for s in range(starts)]
    jobs += [B.Job(k, s, part) for k in ks for part in [*halves, *draws] for s in range(fewer)]
    found = B.best(fit(c, jobs, steps), _better)
    pairs = [(found[B.Job(k)], found[B.Job(k, 0, d)], d) for k in ks for d in draws] + [(found[B.Job(k, 0, halves[0])], found[B.Job(k, 0, halves[1])], halves[1]) for k in ks]
    ari = [B.adjusted_rand(t) for t in _tables(c, pairs)]
    c.patterns.unpersist()
    rows = []
    for i, k in enumerate(ks):
        m: Latent = found[B.Job(k)]  # type: ignore[assignment]
        bic, icl, norm = information(m.loglik, m.entropy, c.params(k), c.n[0], k)
        stable = float(np.mean(ari[i * resamples : (i + 1) * resamples])) if resamples else None
        rows.append((k, m.loglik, c.params(k), float(bic), float(icl), float(norm), stable, ari[len(ks) * resamples + i] if c.n[1:3].min() >= max(2 * k, 10) else None))
    return answers.sparkSession.createDataFrame(rows, "k int, loglik double, n_params int, bic double, icl double, normalized_entropy double, stability double, split_half double")


def posteriors(c: Coded, m: Latent, answers: DataFrame) -> DataFrame:
    """(id, class, p, loglik) of everybody who answered; the model travels with the tasks."""
    levels, matrix, codes = len(c.levels), _patterns(len(c.levels)), c
    table = answers.sparkSession.createDataFrame([(i, lv, n) for n, (i, lv) in enumerate(codes.levels)], "item string, level string, code int")
    people = answers.join(table, ["item", "level"]).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("f"))
    kind = dict(answers.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            _, h, _ = matrix(pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), batch.column(1), pa.array([[0]] * n)], names=["u", "f", "w"]))
            logs = m.logs(h)
            top = logs.max(axis=1, keepdims=True)
            ll = (top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True)))[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.exp(logs - ll[:, None])), pa.list_(pa.float64())), pa.array(ll)], names=["id", "ps", "loglik"])

    out = people.select("id", "f").mapInArrow(run, f"id {kind}, ps array<double>, loglik double")
    return out.select("id", F.posexplode("ps").alias("class", "p"), "loglik").select("id", "class", "p", "loglik")
