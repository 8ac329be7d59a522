"""Unduplicated reach: who is served by which set of items, and which set serves most people."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sets to try one by one before searching greedily.
EXHAUSTIVE = 200_000
#: Bits of a set of items.
MOST_ITEMS = 62


def top_items(long: DataFrame, n: int = 3) -> DataFrame:
    """(id, item) hits: each person's n items of highest x, ties to the smaller item."""
    by = Window.partitionBy("id").orderBy(F.desc("x"), "item")
    return long.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).select("id", "item")


def masks(hits: DataFrame, items: list[str]) -> DataFrame:
    """(mask, n): distinct sets of hit items as bits, and how many people have each.  All later steps look at these few rows."""
    return _person_masks(hits, items).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def _person_masks(hits: DataFrame, items: list[str]) -> DataFrame:
    if len(items) > MOST_ITEMS:
        raise ValueError(f"_TOO_MANY_ITEMS:{len(items)}")
    bit = F.create_map(*(F.lit(v) for i, x in enumerate(items) for v in (x, 1 << i)))
    return hits.select("id", bit[F.col("item")].alias("b")).distinct().groupBy("id").agg(F.sum("b").alias("mask"))


def reach_of(mask_counts: DataFrame, sets: DataFrame) -> DataFrame:
    """sets (set_mask, ...) with ``reached``: people with at least one item of the set.

    The people's masks are grouped first, so the join is of distinct masks with candidate sets and not of people.
    """
    hit = mask_counts.join(F.broadcast(sets), F.col("mask").bitwiseAND(F.col("set_mask")) != 0)
    return sets.join(hit.groupBy("set_mask").agg(F.sum("n").alias("reached")), "set_mask", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))


def best_set(hits: DataFrame, items: list[str], size: int) -> tuple[list[str], int, str, int | None]:
    """(items, people reached, 'exhaustive' or 'greedy', number of sets that tie): the first best in order of item numbers.

    At most MOST_ITEMS items.  The candidate sets have a known number, so the exhaustive search is a join; the greedy one adds
    the item that reaches most, the first on ties.
    """
    m = masks(hits, items)
    spark = hits.sparkSession
    size = max(1, min(size, len(items)))
    if comb(len(items), size) <= EXHAUSTIVE:
        sets = spark.createDataFrame([(sum(1 << i for i in c), n) for n, c in enumerate(combinations(range(len(items)), size))], "set_mask bigint, nth bigint")
        r = reach_of(m, sets)
        top = r.agg(F.max("reached").alias("t")).first()["t"]
        tied = r.filter(F.col("reached") == top).agg(F.min_by("set_mask", "nth").alias("s"), F.count(F.lit(1)).alias("ties")).first()
        return [x for i, x in enumerate(items) if tied["s"] >> i & 1], int(top), "exhaustive", int(tied["ties"])
    chosen, mask, top = [], 0, 0
    for _ in range(size):
        sets = spark.createDataFrame([(mask | 1 << i, i) for i in range(len(items)) if not mask >> i & 1], "set_mask bigint, nth bigint")
        best = reach_of(m, sets).orderBy(F.desc("reached"), "nth").first()
        mask, top = best["set_mask"], best["reached"]
        chosen.append(best["nth"])
    return [items[i] for i in sorted(chosen)], int(top), "greedy", None


def incremental(hits: DataFrame, items: list[str], chosen: list[str], n_people: int) -> DataFrame:
    """(step, item, reached, gain, alone) as shares: chosen items in the order in which each adds most, the first on ties."""
    spark = hits.sparkSession
    m = masks(hits, items)
    left, mask, rows = [items.index(c) for c in chosen], 0, []
    alone = {r["nth"]: r["reached"] for r in reach_of(m, spark.createDataFrame([(1 << i, i) for i in left], "set_mask bigint, nth bigint")).collect()}
    before = 0
    for step in range(1, len(chosen) + 1):
        best = reach_of(m, spark.createDataFrame([(mask | 1 << i, i) for i in left], "set_mask bigint, nth bigint")).orderBy(F.desc("reached"), "nth").first()
        mask, i = best["set_mask"], best["nth"]
        rows.append((step, items[i], best["reached"] / n_people, (best["reached"] - before) / n_people, alone[i] / n_people))
        before = best["reached"]
        left.remove(i)
    return spark.createDataFrame(rows, "step bigint, item string, reached double, gain double, alone double")


def best_mask(masks_: np.ndarray, n: np.ndarray, n_items: int, size: int) -> int:
    """The first set of ``size`` items that reaches most people, each mask's people counted by n; greedy beyond EXHAUSTIVE sets."""
    if comb(n_items, size) <= EXHAUSTIVE:
        sets = np.array([sum(1 << i for i in c) for c in combinations(range(n_items), size)], np.int64)
        reached = np.concatenate([((sets[lo : lo + 2048, None] & masks_) != 0) @ n for lo in range(0, len(sets), 2048)])
        return int(sets[reached.argmax()])
    mask = 0
    for _ in range(size):
        gain = [-1 if mask >> i & 1 else n[(masks_ & (mask | 1 << i)) != 0].sum() for i in range(n_items)]
        mask |= 1 << int(np.argmax(gain))
    return mask


def turf(hits: DataFrame, items: list[str], size: int = 3, splits: int = 40, most_ties: int = 12) -> DataFrame:
    """One row: the best set's items in the order in which each adds most, what each adds and reaches alone, the set's reach, what a set chosen on one half reaches
    in the other, how much the headline overstates, and which sets tie.

    Columns: items, gains, alone, reach, holdout_reach, optimism (null below 20 people), search, n_tied (null after a greedy search), tied_items (the
    first ``most_ties`` of several), n_people, n_items.
    """
    spark = hits.sparkSession
    n = hits.agg(F.countDistinct("id").alias("n")).first()["n"]
    chosen, reached, search, ties = best_set(hits, items, size)
    steps = incremental(hits, items, chosen, n).orderBy("step").collect()
    held = holdout(hits, items, len(chosen), splits).agg(F.avg("reach").alias("r")).first()["r"]
    tied: list[list[str]] = []
    if ties is not None and ties > 1:
        sets = spark.createDataFrame([(sum(1 << i for i in c), j) for j, c in enumerate(combinations(range(len(items)), len(chosen)))], "set_mask bigint, nth bigint")
        rows = reach_of(masks(hits, items), sets).filter(F.col("reached") == reached).orderBy("nth").limit(most_ties).collect()
        tied = [[x for i, x in enumerate(items) if r["set_mask"] >> i & 1] for r in rows]
    share = reached / n if n else 0.0
    row = ([r["item"] for r in steps], [r["gain"] for r in steps], [r["alone"] for r in steps], share, held, None if held is None else share - held, search, ties, tied, n, len(items))
    return spark.createDataFrame([row], "items array<string>, gains array<double>, alone array<double>, reach double, holdout_reach double, optimism double, search string, n_tied int, tied_items array<array<string>>, n_people bigint, n_items int")


def worth_telling(answers: DataFrame, size: int = 3, top_n: int = 3, least_people: int = 40) -> DataFrame:
    """One row (people, items, told) of (id, item), all that a study has: whether reach of sets of ``size`` says anything: enough people, and items of which a person accepts a third at most."""
    one = answers.agg(F.countDistinct("id").alias("people"), F.countDistinct("item").alias("items"))
    return one.withColumn("told", (F.col("people") >= least_people) & (F.col("items") >= max(size + 2, 3 * top_n)))


def holdout(hits: DataFrame, items: list[str], size: int, splits: int = 40, seed: int = 42) -> DataFrame:
    """(split, reach): reach among one half of the people of the best set of the other half; null below 20 people.

    People are grouped by (half, mask) for all splits at once; what a task searches is masks and counts.
    """
    people = _person_masks(hits, items)
    halves = people.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("half", F.pmod(F.xxhash64("id", "split", F.lit(seed)), F.lit(2)))
    counts = halves.groupBy("split", "half", "mask").agg(F.count(F.lit(1)).alias("n"))
    n_items = len(items)
    k = max(1, min(size, n_items))

    def run(rows):
        import pandas as pd

        total = rows["n"].sum()
        if total < 20:
            return pd.DataFrame({"split": [int(rows["split"].iat[0])], "reach": [None]}, dtype=object)
        a, b = rows[rows["half"] == 0], rows[rows["half"] == 1]
        mask = best_mask(a["mask"].to_numpy(), a["n"].to_numpy(), n_items, k)
        reach = b["n"].to_numpy()[(b["mask"].to_numpy() & mask) != 0].sum() / max(1, b["n"].sum())
        return pd.DataFrame({"split": [int(rows["split"].iat[0])], "reach": [float(reach)]})

    return counts.groupBy("split").applyInPandas(run, "split int, reach double")
