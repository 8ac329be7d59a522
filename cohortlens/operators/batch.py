"""Many model fits advanced together: one scan of the data a step, however many models there are.

A ``Job`` is one model: its number of groups, its start, which people and which items it sees.  Models are small and live on the driver; a
step sends them to the tasks, every task goes through its people once for all jobs that have not settled, and each task's sums come
back to be added, so that a step is one stage and what returns follows the models and the tasks, not the people.  ``kmeans`` and ``mixtures``
run all their steps in one barrier stage, whose tasks keep their people and add their sums up among themselves; where Spark has none, a stage a step.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crowd import Crowd, agreed, places

Part = tuple[int, float, float]
EVERYBODY: Part = (0, 0.0, 1.0)


@dataclass(frozen=True)
class Job:
    k: int
    start: int = 0
    part: Part = EVERYBODY  # people whose hash under a seed lies from lo to below hi
    items: tuple[int, ...] | None = None  # positions of the items it sees; all if None
    group: int | None = None  # only rows of this replicate
    kind: str = "full"  # a mixture's covariances

    @property
    def task(self) -> Job:
        """The job without its start: jobs that share it are alternatives."""
        return replace(self, start=0)


def half(which: int, seed: int = 5) -> Part:
    return (seed, which / 2, (which + 1) / 2)


def prepared(people: DataFrame) -> DataFrame:
    """(u, f, g) of (id, f) and, if there is one, the replicate g: what the scans below read."""
    g = F.col("g").cast("int") if "g" in people.columns else F.lit(0)
    return people.select(F.xxhash64("id").alias("u"), F.col("f").cast("array<double>").alias("f"), g.alias("g"))


#: People of a task of a scan: few while cores are free, more where all are busy.
LEAST_ROWS, MOST_ROWS = 2_000, 50_000


def held(people: DataFrame) -> DataFrame:
    """prepared people, persisted in as many partitions as their number asks for.

    Every step scans them once, so a step has as many tasks as there are partitions; those of the plan that made the people may be hundreds for a few thousand rows.
    """
    return gathered(prepared(people))


def partitions(spark: SparkSession, n: int) -> int:
    """In how many partitions n people are scanned."""
    return max(1, min(ceil(n / LEAST_ROWS), max(spark.sparkContext.defaultParallelism, ceil(n / MOST_ROWS))))


def gathered(rows: DataFrame) -> DataFrame:
    """Rows with a key u, persisted in as many partitions as their number asks for."""
    found = rows.persist()
    n = found.count()
    out = found.repartition(partitions(rows.sparkSession, n), "u").persist()
    out.count()
    found.unpersist()
    return out


def uniform(u: np.ndarray, *salts: int) -> np.ndarray:
    """A number in (0, 1) for each key, another one for other salts."""
    x = u.astype(np.uint64)
    for s in salts:
        x = x + np.uint64((0x9E3779B97F4A7C15 * (s + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column(2).to_numpy()


def _within(part: Part, u: np.ndarray) -> np.ndarray:
    """Which people are of the part."""
    seed, lo, hi = part
    if (lo, hi) == (0.0, 1.0):
        return np.ones(len(u), bool)
    v = uniform(u, seed)
    return (v >= lo) & (v < hi)


def _seen(job: Job, u: np.ndarray, x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, answers) of the people and items that a job sees."""
    ok = _within(job.part, u)
    if job.group is not None:
        ok &= g == job.group
    x = x if job.items is None else x[:, list(job.items)]
    return (u, x) if ok.all() else (u[ok], x[ok])


@dataclass
class Share:
    """The people of one task of a crowd, as (u, x, g) of batches."""

    crowd: Crowd
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _together(data: DataFrame, fit: Callable[[Share], list]) -> list:
    return agreed(data, lambda crowd, batches: fit(Share(crowd, list(_blocks(batches, _matrix)))))


def _blocks(batches: Iterable[pa.RecordBatch], matrix: Callable) -> Iterator[tuple]:
    return (matrix(batch) for batch in batches if batch.num_rows)


def _added(parts: Iterable[list[np.ndarray] | None]) -> list[np.ndarray] | None:
    sums: list[np.ndarray] | None = None
    for part in parts:
        if part is not None:
            sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
    return sums


def totals(data: DataFrame | Share, work: Callable[..., list[np.ndarray]], matrix: Callable = _matrix) -> list[np.ndarray]:
    """Sums over all rows of the arrays that ``work`` gives for what ``matrix`` makes of a batch: (u, x, g) of prepared people."""
    if isinstance(data, Share):
        return data.crowd.meet(_added(work(*b) for b in data.blocks), _added) or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _added(work(*b) for b in _blocks(batches, matrix))
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([np.ravel(s) for s in sums], pa.list_(pa.float64()))], names=["job", "sums"])

    total: dict[int, np.ndarray] = {}
    for r in data.mapInArrow(run, "job int, sums array<double>").collect():  # one row a task and job
        total[r["job"]] = total[r["job"]] + np.array(r["sums"]) if r["job"] in total else np.array(r["sums"])
    return [total[j] for j in range(len(total))]


def _least(parts: Iterable[dict[int, tuple[float, np.ndarray]]]) -> dict[int, tuple[float, np.ndarray]]:
    out: dict[int, tuple[float, np.ndarray]] = {}
    for part in parts:
        for i, one in part.items():
            if i not in out or one[0] < out[i][0]:
                out[i] = one
    return out


def drawn(data: DataFrame | Share, jobs: list[Job], weigh: Callable[[int, np.ndarray], np.ndarray], salt: int) -> list[np.ndarray | None]:
    """For each job one of the people it sees, drawn with chances in proportion to ``weigh(job's number, answers)``; evenly where all weights are 0.

    Each person gets an exponential key with its weight as rate; the smallest key wins, in each task first and then overall.
    """

    def one(u: np.ndarray, x: np.ndarray, g: np.ndarray) -> dict[int, tuple[float, np.ndarray]]:
        best = {}
        for i, job in enumerate(jobs):
            keys, mine = _seen(job, u, x, g)
            if not len(mine):
                continue
            w, e = weigh(i, mine), -np.log(uniform(keys, job.start, salt, job.k))
            e = np.where(w > 0, e / np.maximum(w, 1e-300), 1e300 * (1 + e))
            j = int(e.argmin())
            best[i] = (float(e[j]), mine[j].copy())
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if best := _least(one(*b) for b in _blocks(batches, _matrix)):
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()]), pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], names=["job", "key", "f"])

    if isinstance(data, Share):
        least = data.crowd.meet(_least(one(*b) for b in data.blocks), _least)
    else:
        rows = data.mapInArrow(run, "job int, key double, f array<double>").collect()  # one row a task and job
        least = _least({r["job"]: (r["key"], r["f"])} for r in rows)
    return [np.array(least[i][1]) if i in least else None for i in range(len(jobs))]


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))


# --- k-means --------------------------------------------------------------------------------------


@dataclass
class Fit:
    job: Job
    centres: np.ndarray
    inertia: float = np.inf
    sizes: np.ndarray | None = None

    def label(self, x: np.ndarray) -> np.ndarray:
        return sq_distances(x if self.job.items is None else x[:, list(self.job.items)], self.centres).argmin(axis=1)


def seeds(data: DataFrame | Share, jobs: list[Job]) -> list[np.ndarray]:
    """First centres: people drawn one after the other with chances in proportion to the squared distance from the nearest one drawn before."""
    centres: list[list[np.ndarray]] = [[] for _ in jobs]
    for c in range(max(j.k for j in jobs)):
        open_ = [i for i, j in enumerate(jobs) if j.k > c]
        so_far = [np.array(centres[i]) for i in open_]
        weigh = (lambda i, x: np.ones(len(x))) if c == 0 else (lambda i, x, so_far=so_far: sq_distances(x, so_far[i]).min(axis=1))
        for i, who in zip(open_, drawn(data, [jobs[i] for i in open_], weigh, c), strict=True):
            if who is None:
                raise ValueError("_NO_PEOPLE")
            centres[i].append(who)
    return [np.array(c) for c in centres]


#: Distances that a task holds at a time.
CELLS = 1_000_000


def _grouped(now: list[tuple[Job, np.ndarray]], u: np.ndarray, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    """For each job and its centres: the sum of squared distances, and each group's people and sums.

    Jobs of as many groups that see the same items of the same replicate share products, and those of the same part a mask, so that hundreds of small
    models cost a task a few large operations and not hundreds of small ones.
    """
    alike: dict[tuple, list[int]] = {}
    for i, (job, _) in enumerate(now):
        alike.setdefault((job.items, job.k, job.group), []).append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(now)
    for (items, k, group), mine in alike.items():
        keys, answers = _seen(Job(k, items=items, group=group), u, x, g)
        at = {part: n for n, part in enumerate(dict.fromkeys(now[i][0].part for i in mine))}
        which = [at[now[i][0].part] for i in mine]
        c = np.stack([now[i][1] for i in mine])
        p = c.shape[2]
        sums = np.zeros((len(mine), 1 + k + k * p))
        rows = max(1, CELLS // len(mine))
        for a in range(0, len(keys), rows):
            few = answers[a : a + rows]
            counted = np.column_stack([np.ones(len(few)), few])
            left = np.stack([_within(part, keys[a : a + rows]) for part in at])[which]
            squares = (few * few).sum(axis=1)
            d = [np.maximum(0.0, squares - 2 * c[:, j] @ few.T + (c[:, j] * c[:, j]).sum(axis=1)[:, None]) for j in range(k)]
            least = reduce(np.minimum, d)
            sums[:, 0] += np.where(left, least, 0.0).sum(axis=1)
            for j in range(k):
                own = (d[j] == least) & left  # the lower group on ties
                left ^= own
                found = own.astype(float) @ counted
                sums[:, 1 + j] += found[:, 0]
                sums[:, 1 + k + j * p : 1 + k + (j + 1) * p] += found[:, 1:]
        for n, i in enumerate(mine):
            out[i] = sums[n]
    return out


def kmeans(data: DataFrame | Share, jobs: list[Job], steps: int = 100) -> list[Fit]:
    """A fit for each job, each settled or after ``steps``; a centre that loses all its people stays."""
    if isinstance(data, DataFrame) and places(data.sparkSession):
        return _together(data, lambda share: kmeans(share, jobs, steps))
    fits = [Fit(j, c) for j, c in zip(jobs, seeds(data, jobs), strict=True)]
    open_ = list(range(len(jobs)))
    for _ in range(steps):
        now = [(jobs[i], fits[i].centres) for i in open_]

        def work(u, x, g, now=now):
            return _grouped(now, u, x, g)

        left = []
        for i, s in zip(open_, totals(data, work), strict=True):
            f, k = fits[i], jobs[i].k
            n, sums = s[1 : 1 + k], s[1 + k :].reshape(k, -1)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], f.centres)
            settled = np.abs(new - f.centres).max() <= 1e-9 * (1 + np.abs(new).max())
            f.centres, f.inertia, f.sizes = new, float(s[0]), n
            if not settled:
                left.append(i)
        open_ = left
        if not open_:
            break
    else:
        warnings.warn(f"_NOT_SETTLED: {len(open_)} fits after {steps} steps", stacklevel=2)
    return fits


def best(fits: list, score: Callable = lambda f: f.inertia) -> dict[Job, object]:
    """The best fit of each task."""
    out: dict[Job, object] = {}
    for f in fits:
        if f.job.task not in out or score(f) < score(out[f.job.task]):
            out[f.job.task] = f
    return out


def reached(people: DataFrame, k: int, starts: int = 20, steps: int = 100, near: float = 1e-3) -> DataFrame:
    """(start, inertia, reached): fits from many starts, and whether each comes within ``near`` of the best; the mean of reached is the share."""
    data = held(people)
    fits = kmeans(data, [Job(k, s) for s in range(starts)], steps)
    data.unpersist()
    least = min(f.inertia for f in fits)
    return people.sparkSession.createDataFrame([(f.job.start, f.inertia, bool(abs(f.inertia - least) <= near * abs(least) + 1e-8)) for f in fits], "start int, inertia double, reached boolean")


# --- agreement of models --------------------------------------------------------------------------


def cross_counts(data: DataFrame, pairs: list[tuple[Callable, int, Callable, int, Job]]) -> list[np.ndarray]:
    """For each (labels a, number, labels b, number, job) how many people that the job sees have each pair of labels.  Labels are functions of all answers."""
    pairs_ = [(a, ka, b, kb, replace(j, items=None)) for a, ka, b, kb, j in pairs]

    def work(u, x, g):
        out = []
        for a, ka, b, kb, job in pairs_:
            _, mine = _seen(job, u, x, g)
            out.append(np.bincount(a(mine) * kb + b(mine), minlength=ka * kb).astype(float))
        return out

    return [t.reshape(p[1], p[3]) for t, p in zip(totals(data, work), pairs, strict=True)]


def adjusted_rand(table: np.ndarray) -> float:
    two = lambda v: float((v * (v - 1) / 2).sum())
    both, a, b, every = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), two(np.array([table.sum()]))
    expected = a * b / every if every else 0.0
    most = (a + b) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def best_jaccard(table: np.ndarray) -> np.ndarray:
    """For each row's group the largest overlap with a column's: common people over all people of either."""
    return (table / np.maximum(1, table.sum(axis=1)[:, None] + table.sum(axis=0) - table)).max(axis=1)


@dataclass
class Solution:
    """How far a k-means solution on some items can be trusted."""

    fit: Fit
    split_half: float
    jaccard: np.ndarray


def solutions(data: DataFrame, k: int, item_sets: list[tuple[int, ...] | None], starts: int = 10, resamples: int = 100, steps: int = 100) -> list[Solution]:
    """For each set of items the best fit, its split-half agreement and each group's mean best overlap with resampled fits; all in the same scans.

    Resamples see the 63.2% of people that a bootstrap sample of their number holds.
    """
    share = 1 - np.exp(-1)
    jobs = []
    for items in item_sets:
        jobs += [Job(k, s, items=items) for s in range(starts)]
        jobs += [Job(k, s, half(h), items) for h in (0, 1) for s in range(4)]
        jobs += [Job(k, s, (1000 + r, 0.0, share), items) for r in range(resamples) for s in range(2)]
    found = best(kmeans(data, jobs, steps))
    pairs = []
    for items in item_sets:
        whole, a, b = found[Job(k, items=items)], found[Job(k, 0, half(0), items)], found[Job(k, 0, half(1), items)]
        pairs.append((a.label, k, b.label, k, Job(k, 0, half(1))))
        pairs += [(whole.label, k, found[Job(k, 0, (1000 + r, 0.0, share), items)].label, k, Job(k, 0, (1000 + r, 0.0, share))) for r in range(resamples)]
    tables = cross_counts(data, pairs)
    out = []
    for i, items in enumerate(item_sets):
        mine = tables[i * (resamples + 1) : (i + 1) * (resamples + 1)]
        out.append(Solution(found[Job(k, items=items)], adjusted_rand(mine[0]), np.mean([best_jaccard(t) for t in mine[1:]], axis=0)))
    return out


def variable_selection(people: DataFrame, items: list[str], k: int, starts: int = 10, resamples: int = 100, noise: float = 0.05) -> DataFrame:
    """One row (applicable, dropped, n_signal, full_* and reduced_*: split_half, min_jaccard, mean_jaccard; reduced_is_cleaner).

    Items of which the segments explain less than ``noise`` of the variance are left out and the rest is clustered again; nothing is dropped for good.
    Not applicable, with nulls, where no item is noise or fewer than two are left.
    """
    spark = people.sparkSession
    data = held(people)
    fit = best(kmeans(data, [Job(k, s) for s in range(starts)]))[Job(k)]

    def spread(u, x, g):
        one = fit.label(x)[:, None] == np.arange(k)
        return [np.concatenate([one.sum(axis=0), (one.T.astype(float) @ x).ravel(), (x * x).sum(axis=0)])]

    (s,) = totals(data, spread)
    p = len(items)
    n, sums, squares = s[:k], s[k : k + k * p].reshape(k, p), s[k + k * p :]
    grand = sums.sum(axis=0) ** 2 / n.sum()
    between, total = (sums**2 / np.maximum(n, 1)[:, None]).sum(axis=0) - grand, squares - grand
    eta = np.where(total > 0, between / np.where(total > 0, total, 1), 0.0)
    signal = tuple(int(i) for i in np.flatnonzero(eta >= noise))
    dropped = [items[i] for i in range(p) if i not in signal]
    schema = "applicable boolean, dropped array<string>, n_signal int, full_split_half double, full_min_jaccard double, full_mean_jaccard double, reduced_split_half double, reduced_min_jaccard double, reduced_mean_jaccard double, reduced_is_cleaner boolean"
    if not dropped or len(signal) < 2:
        data.unpersist()
        return spark.createDataFrame([(False, dropped, len(signal), *[None] * 7)], schema)
    both = solutions(data, k, [None, signal], starts, resamples)
    data.unpersist()
    told = [(float(x.split_half), float(x.jaccard.min()), float(x.jaccard.mean())) for x in both]
    cleaner = told[1][1] >= told[0][1] - 1e-9 and told[1][0] >= told[0][0] - 1e-9
    return spark.createDataFrame([(True, dropped, len(signal), *told[0], *told[1], cleaner)], schema)


# --- principal axes and data without groups -------------------------------------------------------


@dataclass
class Axes:
    n: int
    mean: np.ndarray
    axes: np.ndarray  # one a row, the widest first; the largest loading of each is positive
    variance: np.ndarray


def principal_axes(data: DataFrame) -> Axes:
    """From the matrix of sums of products, items x items of them, of all people."""

    def work(u, x, g):
        return [np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])]

    found = totals(data, work)
    if not found:
        raise ValueError("_NO_PEOPLE")
    p = int(round((-1 + np.sqrt(4 * len(found[0]) - 3)) / 2))
    n, sums, squares = found[0][0], found[0][1 : 1 + p], found[0][1 + p :].reshape(p, p)
    mean = sums / n
    values, vectors = np.linalg.eigh(squares / n - np.outer(mean, mean))
    axes = vectors.T[::-1]
    axes = axes * np.where(axes[np.arange(p), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Axes(int(n), mean, axes, np.maximum(0.0, values[::-1]))


def pca_2d(people: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """people with x and y on the two widest principal axes, and the share of variance of each; with one item y is 0."""
    a = principal_axes(prepared(people))
    total = float(a.variance.sum())
    names = ["x", "y"]
    for name, axis in zip(names, a.axes[:2], strict=False):
        terms = [(F.col("f")[j] - F.lit(float(a.mean[j]))) * F.lit(float(w)) for j, w in enumerate(axis)]
        people = people.withColumn(name, sum(terms[1:], terms[0]))
    if len(a.axes) == 1:
        people = people.withColumn("y", F.lit(0.0))
    shares = [float(v / total) if total > 0 else 0.0 for v in a.variance[:2]]
    return people, (shares[0], shares[1] if len(shares) > 1 else 0.0)


def spots(points: DataFrame, digits: int = 9) -> DataFrame:
    """(x, y, segment, n): one row for each position on a grid of ``digits`` decimals, with its number of people and the segment of most of them, the lower on ties.

    The multiple is rounded, as SQL engines do, and not the number's decimal form: the two differ just below the middle between two positions.
    """
    near = lambda c: F.round(F.col(c) * 10.0**digits) / 10.0**digits
    at = points.select(near("x").alias("x"), near("y").alias("y"), "segment").groupBy("x", "y", "segment").agg(F.count(F.lit(1)).alias("m"))
    return at.groupBy("x", "y").agg(F.min_by("segment", F.struct(-F.col("m"), F.col("segment"))).alias("segment"), F.sum("m").alias("n"))


def null_people(people: DataFrame, reps: int, kinds: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(id, f, g): ``reps`` tables, g of them, as large as people but without groups, drawn where they are read.

    Without kinds answers fill the box along the principal axes evenly.  With kinds, one an item, each item is drawn on its own: ``numeric``
    evenly over its range, others evenly from the levels that occur, of which a questionnaire has few.  People who are held already are taken as they are.
    """
    spark, data = people.sparkSession, people if "u" in people.columns else prepared(people)
    if kinds is None:
        a = principal_axes(data)

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z = (_matrix(batch)[1] - a.mean) @ a.axes.T
                    yield pa.RecordBatch.from_arrays([pa.array(range(z.shape[1]), pa.int32()), pa.array(z.min(axis=0)), pa.array(z.max(axis=0))], names=["i", "lo", "hi"])

        rows = data.mapInArrow(bounds, "i int, lo double, hi double").collect()  # one row a batch and axis
        ends = [[(r["lo"], r["hi"]) for r in rows if r["i"] == i] for i in range(len(a.axes))]
        n, lo, hi = a.n, np.array([min(e)[0] for e in ends]), np.array([max(h for _, h in e) for e in ends])
        make = lambda v: (lo + v * (hi - lo)) @ a.axes + a.mean
    else:
        numeric = [k == "numeric" for k in kinds]
        ends = [f(F.col("f")[j]).alias(f"{name}{j}") for j in range(len(kinds)) for name, f in (("lo", F.min), ("hi", F.max))]
        one = data.agg(F.count(F.lit(1)).alias("n"), *ends, *(F.array_sort(F.collect_set(F.col("f")[j])).alias(f"s{j}") for j in range(len(kinds)) if not numeric[j])).first()
        n = one["n"]
        levels = [None if numeric[j] else np.array(one[f"s{j}"]) for j in range(len(kinds))]

        def make(v):
            return np.stack([one[f"lo{j}"] + v[:, j] * (one[f"hi{j}"] - one[f"lo{j}"]) if lv is None else lv[(v[:, j] * len(lv)).astype(int)] for j, lv in enumerate(levels)], axis=1)

    p = len(kinds) if kinds is not None else len(lo)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            x = make(np.stack([uniform(at.view(np.uint64), seed, j) for j in range(p)], axis=1)) if len(at) else np.zeros((0, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array((at % reps).astype(np.int32))], names=["id", "f", "g"])

    return spark.range(n * reps).mapInArrow(draw, "id bigint, f array<double>, g int")


def single_cluster(people: DataFrame, references: int = 20, starts: int = 4, kinds: list[str] | None = None) -> DataFrame:
    """One row (single, gap_one, gap_two, gap_two_se): whether one group describes the people as well as two.

    Gaps are means over reference tables without groups, of everybody's number, of log within-sums less the data's own; one group holds unless
    two are better by more than the references' standard error.
    """
    spark = people.sparkSession
    data = held(people)
    none = held(null_people(data, references, kinds))
    own = best(kmeans(data, [Job(k, s) for k in (1, 2) for s in range(starts if k > 1 else 1)]))
    ref = best(kmeans(none, [Job(k, s, group=r) for k in (1, 2) for r in range(references) for s in range(min(2, starts) if k > 1 else 1)]))
    data.unpersist()
    none.unpersist()
    log = lambda v: float(np.log(max(v, 1e-300)))
    gap, se = {}, {}
    for k in (1, 2):
        w = np.array([log(ref[Job(k, group=r)].inertia) for r in range(references)])
        gap[k], se[k] = float(w.mean()) - log(own[Job(k)].inertia), float(w.std() * np.sqrt(1 + 1 / references))
    return spark.createDataFrame([(gap[1] >= gap[2] - se[2], gap[1], gap[2], se[2])], "single boolean, gap_one double, gap_two double, gap_two_se double")


# --- Gaussian mixtures ----------------------------------------------------------------------------

SHAPES = ("full", "tied", "diag", "spherical")


@dataclass
class Mixture:
    job: Job
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = -np.inf
    n: float = 0.0

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, people x components."""
        out = np.empty((len(x), self.job.k))
        for j in range(self.job.k):
            c = np.linalg.cholesky(self.covs[j])
            out[:, j] = np.log(max(self.weights[j], 1e-300)) - 0.5 * (np.linalg.solve(c, (x - self.means[j]).T) ** 2).sum(axis=0) - np.log(np.diag(c)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        return self.logs(x).argmax(axis=1)

    def proper(self) -> bool:
        """Whether every covariance is one that has a density."""
        try:
            return bool(np.isfinite(np.linalg.cholesky(self.covs)).all())
        except np.linalg.LinAlgError:
            return False

    @property
    def bic(self) -> float:
        k, p = self.means.shape
        shape = {"full": k * p * (p + 1) / 2, "tied": p * (p + 1) / 2, "diag": k * p, "spherical": k}[self.job.kind]
        return -2 * self.loglik + (k - 1 + k * p + shape) * float(np.log(max(self.n, 1)))


def _shaped(kind: str, s0: np.ndarray, covs: np.ndarray, reg: float) -> np.ndarray:
    k, p = covs.shape[:2]
    if kind == "tied":
        covs = np.stack([np.einsum("k,kpq->pq", s0, covs) / s0.sum()] * k)
    elif kind != "full":
        d = np.stack([np.diag(c) for c in covs])
        covs = np.stack([np.diag(v if kind == "diag" else np.full(p, v.mean())) for v in d])
    return covs + reg * np.eye(p)


def mixtures(data: DataFrame | Share, fits: list[Fit], steps: int = 200, reg: float = 1e-4, tol: float = 1e-6) -> list[Mixture]:
    """A mixture for each k-means fit and covariance shape (the fit's job names it), by EM that begins with the fit's groups."""
    if isinstance(data, DataFrame) and places(data.sparkSession):
        return _together(data, lambda share: mixtures(share, fits, steps, reg, tol))
    out: list[Mixture | None] = [None] * len(fits)
    open_ = list(range(len(fits)))
    for step in range(steps + 1):
        now = [(fits[i], out[i]) for i in open_]

        def work(u, x, g, now=now):
            sums = []
            for fit, m in now:
                _, mine = _seen(fit.job, u, x, g)
                if m is None:
                    r, ll = (fit.label(mine)[:, None] == np.arange(fit.job.k)).astype(float), 0.0
                else:
                    logs = m.logs(mine)
                    top = logs.max(axis=1, keepdims=True) if len(mine) else np.zeros((0, 1))
                    r = np.exp(logs - top)
                    ll = float((top[:, 0] + np.log(r.sum(axis=1))).sum())
                    r /= r.sum(axis=1, keepdims=True)
                sums.append(np.concatenate([[ll], r.sum(axis=0), (r.T @ mine).ravel(), np.einsum("nk,np,nq->kpq", r, mine, mine).ravel()]))
            return sums

        left = []
        for i, s in zip(open_, totals(data, work), strict=True):
            job = fits[i].job
            k, p = fits[i].centres.shape
            s0 = s[1 : 1 + k]
            means = s[1 + k : 1 + k + k * p].reshape(k, p) / np.maximum(s0, 1e-12)[:, None]
            covs = s[1 + k + k * p :].reshape(k, p, p) / np.maximum(s0, 1e-12)[:, None, None] - np.einsum("kp,kq->kpq", means, means)
            new = Mixture(job, s0 / s0.sum(), means, _shaped(job.kind, s0, covs, reg), float(s[0]) if step else -np.inf, float(s0.sum()))
            settled = step > 1 and new.loglik - out[i].loglik < tol * abs(new.loglik)
            if not new.proper():
                new.loglik, settled = -np.inf, True
            out[i] = new
            if not settled and step < steps:
                left.append(i)
        if step == steps and not settled:
            warnings.warn(f"_NOT_SETTLED: {steps} steps", stacklevel=2)
        open_ = left
        if not open_:
            break
    return [m for m in out if m is not None]


def model_agreement(people: DataFrame, k: int, starts: int = 3, mixed: bool = False) -> DataFrame:
    """One row (agreement_ari, covariance, mean_max_posterior, normalized_entropy): the segments of k-means against the mixture of least BIC among four covariance shapes.

    Null for mixed data, whose codes no Gaussian describes.
    """
    spark, schema = people.sparkSession, "agreement_ari double, covariance string, mean_max_posterior double, normalized_entropy double"
    if mixed:
        return spark.createDataFrame([(None, None, None, None)], schema)
    data = held(people)
    fits = kmeans(data, [Job(k, s) for s in range(max(10, starts))])
    first = sorted(fits, key=lambda f: f.inertia)[:starts]
    found = mixtures(data, [Fit(replace(f.job, kind=kind), f.centres) for f in first for kind in SHAPES])
    m, base = min(found, key=lambda m: m.bic), first[0]

    def sure(u, x, g):
        logs = m.logs(x)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [np.array([len(x), p.max(axis=1).sum(), -(p * np.log(p + 1e-12)).sum()])]

    (s,) = totals(data, sure)
    (table,) = cross_counts(data, [(base.label, k, m.label, k, Job(k))])
    data.unpersist()
    return spark.createDataFrame([(adjusted_rand(table), m.job.kind, float(s[1] / s[0]), float(max(0.0, s[2] / s[0] / np.log(k)))) if k > 1 else (1.0, m.job.kind, 1.0, 0.0)], schema)
