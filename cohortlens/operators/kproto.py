"""k-prototypes over encoded mixed answers: seeded by squared Gower distance, all starts in the same scans.

Everything is columns and aggregates: a seed is the person with the smallest exponential key, a prototype the medians, middle levels and modes of
its group, and a group that lost everybody restarts at the person that is served worst.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gower


@dataclass
class Prototypes:
    start: int
    rows: list[dict]
    cost: float = float("inf")


def _uniform(*salts: int) -> Column:
    return (F.pmod(F.xxhash64("id", *(F.lit(s) for s in salts)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _distances(spec: gower.GowerSpec, protos: list[dict]) -> list[Column]:
    own = {c: F.col(c) for c in spec.kinds}
    return [gower.distance(spec, own, {c: F.lit(p[c]) for c in spec.kinds}) for p in protos]


def seed(encoded: DataFrame, spec: gower.GowerSpec, k: int, starts: list[int]) -> list[list[dict]]:
    """k people for each start, each drawn with chances in proportion to the squared distance from the nearest one drawn before."""
    who = F.struct(*spec.kinds)
    protos: list[list[dict]] = [[] for _ in starts]
    for c in range(k):
        keys = []
        for s, have in zip(starts, protos, strict=True):
            e = -F.log(_uniform(s, c))
            near = F.least(*_distances(spec, have)) if len(have) > 1 else _distances(spec, have)[0] if have else F.lit(1.0)
            keys.append(F.when(near > 0, e / (near * near)).otherwise(1e300 * (1 + e)))  # evenly where everybody sits on a prototype
        one = encoded.agg(*(F.min_by(who, key).alias(f"s{i}") for i, key in enumerate(keys))).first()
        for i, have in enumerate(protos):
            if one[f"s{i}"] is None:
                raise ValueError("_NO_PEOPLE")
            have.append(one[f"s{i}"].asDict())
    return protos


def nearest(spec: gower.GowerSpec, protos: list[dict]) -> Column:
    """(d, cluster) of the nearest prototype, the first on ties."""
    return F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("cluster")) for i, d in enumerate(_distances(spec, protos)))))


def fit(encoded: DataFrame, spec: gower.GowerSpec, k: int, starts: int = 10, steps: int = 100, first: list[list[dict]] | None = None) -> Prototypes:
    """The start of least total distance, after each has settled: same prototypes as in the step before, or as in an earlier one.

    encoded: id and the spec's columns, as gower.encode gives them.  first: prototypes to begin with, instead of drawn ones.
    """
    encoded = encoded.select("id", *spec.kinds).persist()
    drawn = seed(encoded, spec, k, list(range(starts))) if first is None else first
    runs = [Prototypes(s, p) for s, p in enumerate(drawn)]
    seen: list[list[list[dict]]] = [[] for _ in runs]
    open_ = list(range(len(runs)))
    for _ in range(steps):
        stacked = encoded.select(*spec.kinds, F.explode(F.array(*(F.struct(F.lit(i).alias("run"), nearest(spec, runs[i].rows).alias("n")) for i in open_))).alias("z"))
        stacked = stacked.select(*spec.kinds, (F.col("z.run") * k + F.col("z.n.cluster")).alias("group"), F.col("z.run").alias("run"), F.col("z.n.d").alias("d"))
        new = {r["group"]: {c: r[c] for c in spec.kinds} for r in gower.update_prototypes(stacked, spec, "group").collect()}  # k x starts rows
        worst = stacked.groupBy("run").agg(F.sum("d").alias("cost"), F.max("d").alias("far"), F.max_by(F.struct(*spec.kinds), F.struct("d", *spec.kinds)).alias("who"))
        left = []
        for r in worst.collect():
            run, i = runs[r["run"]], r["run"]
            run.cost = r["cost"]
            seen[i].append(run.rows)
            rows, spare = [], r["far"] > 0
            for c in range(k):
                if i * k + c in new:
                    rows.append(new[i * k + c])
                else:  # the worst served person begins the group anew; one group a step
                    rows.append(r["who"].asDict() if spare else run.rows[c])
                    spare = False
            if rows not in seen[i]:
                run.rows = rows
                left.append(i)
        open_ = sorted(left)
        if not open_:
            break
    else:
        warnings.warn(f"_NOT_SETTLED: {len(open_)} starts after {steps} steps", stacklevel=2)
    encoded.unpersist()
    return min(runs, key=lambda r: (r.cost, r.start))


def assign(encoded: DataFrame, spec: gower.GowerSpec, protos: list[dict]) -> DataFrame:
    """encoded with segment and d of the nearest prototype."""
    n = nearest(spec, protos)
    return encoded.withColumns({"segment": n["cluster"].cast("bigint"), "d": n["d"]})
