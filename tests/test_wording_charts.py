"""Words for numbers and questions, chart data, and what a report leaves out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import wording
from cohortlens.operators import charts, reach
from cohortlens.sources import ingest


def told(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_short_labels(spark):
    got = told(spark, ["I like planning things rather than deciding last minute", "short_one?", "I", "Supercalifragilisticexpialidocious words follow here", "to the of and " * 5, None], "string", wording.short_label)
    assert got == ["like planning things…", "short one", "I", "Supercalifragilisticexpialidocious…", "to…", None]


@pytest.mark.parametrize(("share", "phrase"), [(0.52, "about half (52%)"), (0.34, "about 1 in 3 (34%)"), (0.4, "40%"), (0.1, "about 1 in 10 (10%)"), (0.02, "2%"), (0.25, "about 1 in 4 (25%)")])
def test_fractions(spark, share, phrase):
    assert told(spark, [share], "double", wording.fraction) == [phrase]


def test_verdicts_and_plurals(spark):
    assert [wording.plural(u) for u in ("group", "class", "box", "branch")] == ["groups", "classes", "boxes", "branches"]
    assert told(spark, [0.7, 0.6, 0.1], "double", wording.persistence_verdict) == ["holds", "boundary is a choice", "scatters"]
    assert told(spark, [0.9, 0.6, 0.1], "double", wording.neighbours_verdict) == ["barely distinguishable", "shade into one another", "own territory"]
    assert told(spark, [0.9, 0.85, 0.7, 0.5, None], "double", lambda a: wording.typing_verdict(a, F.lit(0.72))) == ["safe to deploy", "workable", "workable", "unstable", "not estimated"]
    assert told(spark, [0.2, 0.9], "double", lambda d: wording.hopkins_doubts(d, F.lit(3))) == [["same answers", "few items"], ["few items"]]


def test_neighbours_are_told_once(spark):
    rows = [(0, 1, 0.9, 3), (1, 0, 0.7, 9), (2, 0, 0.5, 1), (3, 1, 0.6, 2), (3, 2, 0.4, 2), (1, 2, 0.3, 1)]
    got = charts.neighbour_pairs(spark.createDataFrame(rows, "closest int, second int, mean_shadow double, n int")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0.9, 3), (1, 3, 0.6, 2), (0, 2, 0.5, 1), (2, 3, 0.4, 2)]


def test_grid_falls_to_the_nearest_centre(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (100, 2)) + 4 * (np.arange(100) % 2)[:, None])]
    pts = spark.createDataFrame(rows, "id int, segment int, x double, y double")
    grid = charts.decision_grid(pts, 30).toPandas()
    centres = np.array([[np.mean([r[k] for r in rows if r[1] == s]) for k in (2, 3)] for s in (0, 1)])
    want = ((grid[["x", "y"]].to_numpy()[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert len(grid) == 900 and (grid["region"] == want).all()
    lo, hi = min(r[2] for r in rows), max(r[2] for r in rows)
    assert grid["x"].min() == pytest.approx(lo - 0.07 * (hi - lo)) and grid["x"].max() == pytest.approx(hi + 0.07 * (hi - lo))
    assert charts.map_agreement(pts).first()["agree"] > 0.97 and charts.decision_grid(pts.limit(0), 5).count() == 0


def test_histograms_fit_the_smallest_segment(spark):
    rows = [(0, i / 399) for i in range(400)] + [(1, i / 80) for i in range(81)]
    h = charts.histogram(spark.createDataFrame(rows, "segment int, value double")).toPandas()
    assert h["bin"].max() == 9 and h.groupby("segment")["n"].sum().tolist() == [400, 81] and h[h.segment == 1]["n"].tolist().count(9) >= 1
    fixed = charts.histogram(spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 0.99)], "segment int, value double"), 0.0, 1.0, 40).toPandas()
    assert sorted(zip(fixed["bin"], fixed["n"], strict=True)) == [(0, 1), (39, 2)]
    one = charts.histogram(spark.createDataFrame([(0, 2.0)] * 5, "segment int, value double")).toPandas()
    assert one["n"].tolist() == [5] and one["bin"].tolist() == [5]


def test_one_chart_that_fails_leaves_the_others(spark):
    good = spark.range(3)
    out, errors = charts.build_all({"good": lambda: good, "none": lambda: None, "plan": lambda: good.select("nowhere"), "run": lambda: good.select(F.raise_error(F.lit("broken")).alias("x"))})
    assert list(out) == ["good"] and [e.split(":")[0] for e in errors] == ["plan", "run"]


@pytest.mark.parametrize(("people", "items", "told"), [(40, 9, True), (39, 9, False), (40, 8, False), (60, 14, True)])
def test_reach_is_told_of_long_lists_only(spark, people, items, told):
    hits = spark.createDataFrame([(i, f"x{i % items}") for i in range(people)] + [(0, f"x{j}") for j in range(items)], "id int, item string")
    assert reach.worth_telling(hits).first()["told"] == told


def test_ids_of_new_files(spark):
    df = spark.createDataFrame([(i, i % 3, f"p{i}@x.org", i) for i in range(30)], "q1 int, q2 int, email string, id int")
    assert ingest.pick_id_column(df, ["q1", "q2"]) == "email" and ingest.pick_id_column(df, ["q1", "q2"], "q2") == "q2"
    assert ingest.pick_id_column(df.select("q2", "id"), ["q2", "id"]) == "id" and ingest.pick_id_column(df.select("q2"), []) is None


def test_reach_report(spark):
    """Pure noise overstates its best set; sets that tie are told; too many items are refused."""
    rng = np.random.default_rng(2)
    hits = spark.createDataFrame([(i, f"x{j:02}") for i in range(100) for j in rng.permutation(20)[:3].tolist()], "id int, item string")
    items = sorted(f"x{j:02}" for j in range(20))
    r = reach.turf(hits, items).first()
    assert r["optimism"] > 0.05 and r["holdout_reach"] < r["reach"] and sum(r["gains"]) == pytest.approx(r["reach"]) and r["search"] == "exhaustive" and len(r["items"]) == 3
    assert r["gains"][0] == max(r["alone"])
    tie = reach.turf(spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "id int, item string"), ["a", "b", "c"], 2).first()
    assert tie["n_tied"] == 3 and tie["tied_items"] == [["a", "b"], ["a", "c"], ["b", "c"]]
    with pytest.raises(ValueError, match="_TOO_MANY_ITEMS:63"):
        reach.masks(hits, [str(i) for i in range(63)])


def test_best_masks_are_the_first_best():
    rng = np.random.default_rng(3)
    from itertools import combinations

    for _ in range(20):
        masks, n = np.unique(rng.integers(1, 1 << 8, 60)), None
        n = rng.integers(1, 9, len(masks))
        want = max(combinations(range(8), 3), key=lambda c: (n[(masks & sum(1 << i for i in c)) != 0].sum(), tuple(-i for i in c)))
        assert reach.best_mask(masks, n, 8, 3) == sum(1 << i for i in want)
