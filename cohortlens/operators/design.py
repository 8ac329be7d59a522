"""Balanced best-worst questionnaires: search, balance report and the study planner's rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _search(items: int, per_set: int, sets: int, rng: np.random.Generator, seen: np.ndarray, passes: int = 2) -> np.ndarray:
    """sets x per_set item numbers of one person: decks dealt in turn, then swaps while they lower the sum of squared pair counts."""
    deck: list[int] = []
    plan = np.empty((sets, per_set), int)
    for s in range(sets):
        row: list[int] = []
        while len(row) < per_set:
            if not deck:
                deck = rng.permutation(items).tolist()
            at = next((i for i, x in enumerate(deck) if x not in row), None)
            if at is None:
                deck = rng.permutation(items).tolist() + deck
                continue
            row.append(deck.pop(at))
        plan[s] = row
    for row in plan:
        for i in row:
            seen[i, row] += 1
    for _ in range(passes):
        for a in range(sets):
            for i in range(per_set):
                for b in range(a + 1, sets):
                    x = plan[a, i]
                    for j in range(per_set):
                        y = plan[b, j]
                        if x in plan[b] or y in plan[a]:
                            continue
                        ra, rb = np.delete(plan[a], i), np.delete(plan[b], j)
                        change = (2 * (seen[y, ra] - seen[x, ra]) + 2).sum() + (2 * (seen[x, rb] - seen[y, rb]) + 2).sum()
                        if change < 0:
                            for u, rows in ((x, ra), (y, rb)):
                                seen[u, rows] -= 1
                                seen[rows, u] -= 1
                            for u, rows in ((y, ra), (x, rb)):
                                seen[u, rows] += 1
                                seen[rows, u] += 1
                            plan[a, i], plan[b, j] = y, x
                            x = y
    return plan


def make_design(spark: SparkSession, items: list[str], per_set: int, sets: int, people: int, seed: int = 42, block: int = 50) -> DataFrame:
    """(respondent_id, task, position, item), numbered from 1.

    Blocks of ``block`` people are searched in separate tasks, each balancing pairs over its own people.
    """
    if per_set < 2:
        raise ValueError("_DESIGN_SET_TOO_SMALL")
    if len(items) <= per_set:
        raise ValueError("_DESIGN_TOO_FEW_ITEMS")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["block"].iat[0])
        rng, seen = np.random.default_rng([seed, at]), np.zeros((len(items), len(items)), int)
        out = []
        for p in sorted(rows["person"]):
            plan = _search(len(items), per_set, sets, rng, seen)
            out += [(f"R{p + 1:04d}", s + 1, i + 1, items[x]) for s, row in enumerate(plan) for i, x in enumerate(row)]
        return pd.DataFrame(out, columns=["respondent_id", "task", "position", "item"])

    numbers = spark.range(people).select(F.col("id").alias("person"), F.floor(F.col("id") / block).alias("block"))
    return numbers.groupBy("block").applyInPandas(run, "respondent_id string, task int, position int, item string")


def pair_balance(long: DataFrame) -> DataFrame:
    """(a, b, together) for each pair of items, a < b, also of those never shown together; over (respondent_id, set, item)."""
    return _balance(long, _shown_sets(long))


def _shown_sets(long: DataFrame) -> DataFrame:
    """(items, n): the different sets of items on a screen, in order, and how often each is shown; far fewer than screens."""
    at = long.filter("respondent_id is not null and set is not null")
    return at.groupBy("respondent_id", "set").agg(F.sort_array(F.collect_list("item")).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("n"))


def _balance(long: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select("n", "items", F.explode("items").alias("a"))
    n = one.select("n", "a", F.explode("items").alias("b")).filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("together"))
    items = long.select("item").distinct()
    every = items.selectExpr("item a").crossJoin(F.broadcast(items.selectExpr("item b"))).filter("a < b")
    return every.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("together", F.lit(0)).alias("together"))


def describe(long: DataFrame) -> DataFrame:
    """One row: least and most times an item or a pair is shown, and pairs never shown."""
    shown = long.groupBy("item").count().agg(F.min("count").alias("shown_min"), F.max("count").alias("shown_max"), F.count(F.lit(1)).alias("items"))
    pairs = pair_balance(long).agg(F.min("together").alias("pair_min"), F.max("together").alias("pair_max"), F.count_if(F.col("together") == 0).alias("never"))
    return shown.crossJoin(pairs)


def recommend_size(cells: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row: the smallest n of (regime, n_people, hit_rate), moderate regime, whose hit rate and whose mean from there up reach the threshold."""
    on = Window.orderBy("n_people").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    m = cells.filter("regime = 'moderate'").withColumn("later", F.avg("hit_rate").over(on))
    return m.agg(F.min(F.when((F.col("hit_rate") >= threshold) & (F.col("later") >= threshold), F.col("n_people"))).alias("recommended_n"))
