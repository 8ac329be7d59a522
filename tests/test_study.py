"""Studies from file to files: each method on planted groups, forced items, refusals, and scoring new people with what was written."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import scaling, study, views


def agreement(found, truth):
    k = max(found.values()) + 1
    return max(np.mean([p[found[i]] == t for i, t in truth.items()]) for p in itertools.permutations(range(max(k, max(truth.values()) + 1)), k))


def export(tmp_path, kind, n=150, seed=0):
    rng = np.random.default_rng(seed)
    head = "respondent_id,q1,q2,q3,q4,brand,gender" if kind == "mixed" else "respondent_id,q1,q2,q3,q4,gender" if kind == "ratings" else "respondent_id,a,b,c,d,e,f,gender"
    lines, truth = [head], {}
    for i in range(n):
        g = i % 3
        truth[f"r{i:03}"] = g
        q = [str(int(np.clip((1 if (j + g) % 3 else 5) + rng.integers(-1, 2), 1, 5))) for j in range(4)]
        brand = ["north", "south", "east"][g if rng.random() < 0.9 else int(rng.integers(3))]
        picks = [("yes" if rng.random() < (0.9 if j // 2 == g else 0.1) else "no") for j in range(6)]
        sex = ["man", "woman"][int(rng.integers(2))]
        lines.append(",".join([f"r{i:03}", *(q if kind != "picks" else picks), *([brand] if kind == "mixed" else []), sex]))
    p = tmp_path / f"{kind}.csv"
    p.write_text("\n".join(lines) + "\n")
    return str(p), truth


@pytest.mark.parametrize(("kind", "method", "files"), [
    ("ratings", "kmeans", ["segment_centroids.csv", "segment_stability_jaccard.csv", "variable_importance.csv", "typing_rule.json"]),
    ("mixed", "kproto", ["segment_prototypes.csv", "typing_rule.json"]),
    ("picks", "lca", ["latent_class_profiles.csv", "latent_class_typing_rule.json"]),
])
def test_from_file_to_files(spark, tmp_path, kind, method, files):
    path, truth = export(tmp_path, kind)
    out = str(tmp_path / "out")
    s = study.run_file(spark, path, out, k=3, resamples=3)
    found = {r["id"]: r["segment"] for r in s.assignments.collect()}
    assert s.manifest["method"] == method and set(found) == set(truth) and agreement(found, truth) > 0.9
    for f in [*files, "segment_assignments.csv", "segment_sizes.csv", "run_manifest.json", "segmentation_report.md", "segmentation_report.html"]:
        assert (tmp_path / "out" / f).exists(), f
    manifest = json.loads((tmp_path / "out/run_manifest.json").read_text())
    assert manifest["k"] == 3 and manifest["n_respondents"] == 150 and "gender" not in manifest["items"] and "respondent_id" not in manifest["items"]
    written = spark.read.option("header", "true").csv(f"{out}/segment_assignments.csv")
    assert {r["id"]: int(r["segment"]) for r in written.collect()} == found
    rule = "latent_class_typing_rule.json" if method == "lca" else "typing_rule.json"
    new = study.score_file(spark, f"{out}/{rule}", path, out)
    assert new.columns[0] == "respondent_id"
    again = {r["respondent_id"]: r["segment"] for r in new.collect()}
    assert np.mean([again[i] == found[i] for i in found]) > 0.97


def test_forced_items_and_refusals(spark, tmp_path):
    path, _ = export(tmp_path, "mixed")
    from cohortlens.sources import ingest

    df = ingest.read_table(spark, path)
    _, method, items, _ = ingest.auto_prepare(df, force_items=["q1", "q4", "gender", "nowhere"])
    assert method == "kproto" and items == ["q1", "q4", "gender"]
    with pytest.raises(ValueError, match="_AUTO_NO_ITEMS"):
        ingest.auto_prepare(df, force_items=["q1", "gender"])
    with pytest.raises(ValueError, match="_TWO_ITEMS_NEEDED"):
        study.run(df.selectExpr("respondent_id", "q1", "1 as same", "2 as flat"), items=["q1", "same", "flat"], k=2)
    assert study.run(df, items=["q1", "q3"], k=2, resamples=2).manifest["items"] == ["q1", "q3"]


def test_the_number_of_groups_is_found(spark, tmp_path):
    path, truth = export(tmp_path, "ratings", n=90)
    from cohortlens.sources import ingest

    s = study.run(ingest.read_table(spark, path), resamples=3)
    assert s.manifest["k"] == 3 and s.tables["k_selection_diagnostics"].count() > 1


def choices_of(spark, n_items, n_people=45, sets=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_people):
        for t in range(sets):
            shown = rng.choice(n_items, 4, replace=False)
            u = shown * 0.6 + rng.gumbel(size=4)
            rows += [(f"p{i:02}", t, f"item {x:02}", "best" if j == u.argmax() else "worst" if j == u.argmin() else "") for j, x in enumerate(shown)]
    return spark.createDataFrame(rows, "respondent_id string, set int, item string, choice string")


def test_choice_studies_write_what_to_launch(spark, tmp_path):
    tables = study.save_choices(choices_of(spark, 10), str(tmp_path / "o"), steps=120, burn=60, splits=4)
    top = tables["item_utilities"].limit(3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and {r["item"] for r in top} & {"item 09", "item 08"}
    wide = spark.read.option("header", "true").csv(str(tmp_path / "o/respondent_utilities.csv"))
    assert wide.count() == 45 and len(wide.columns) == 11
    launch = tables["what_to_launch"].collect()
    assert len(launch) == 3 and launch[0]["combined_reach"] == pytest.approx(sum(r["incremental_reach"] for r in launch)) and launch[0]["expected_reach_holdout"] <= 1
    assert (tmp_path / "o/what_to_launch.csv").exists()


def test_short_lists_say_nothing_of_reach(spark):
    assert "what_to_launch" not in study.choice_tables(choices_of(spark, 5, 42, 3), steps=40, burn=20)


def ratings_with_gaps(spark, n=80):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in rng.normal([1 + 3 * (i % 2), 5 - 3 * (i % 2), 0], [0.5, 0.5, 1]))
        rows.append((f"r{i:02}", None if i % 9 == 0 else a, float("inf") if i % 11 == 0 else b, float("nan") if i == 5 else c, None if i % 4 else 0.1, 7.0, None))
    return spark.createDataFrame(rows, "id string, b double, a double, c double, flat double, same double, empty double").repartition(3)


def test_people_are_mapped_as_the_long_form_says(spark):
    df, items = ratings_with_gaps(spark), ["b", "a", "c", "flat", "same", "empty"]
    people, kept, params = study._numeric(df, items)
    assert kept == ["a", "b", "c"]
    long = scaling.drop_constant(scaling.impute_mean(df.unpivot("id", items, "item", "x")))
    for mine, want in (("raw", long), ("f", scaling.scale(long, "range"))):
        got, whole = ({r["id"]: r["f"] for r in d.collect()} for d in (people.select("id", F.col(mine).alias("f")), views.to_features(want)))
        assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i]) for i in whole)
    assert params == {r["item"]: (r["shift"], r["spread"]) for r in scaling.scale_fit(long, "range").collect()}
    people.unpersist()


def test_a_study_of_few_people_is_few_tasks(spark):
    """Tables are neither made anew for each look at them nor kept in as many parts as the session's joins have."""
    df, sc = ratings_with_gaps(spark).persist(), spark.sparkContext
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    sc.setJobGroup("few tasks", "")
    try:
        s = study.run(df, "id", ["a", "b", "c"], 2, resamples=2)
        assert s.tables["segment_sizes"].crossJoin(s.tables["variable_importance"]).count() == 6
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    track = sc.statusTracker()
    stages = {i for j in track.getJobIdsForGroup("few tasks") for i in track.getJobInfo(j).stageIds}
    assert 0 < sum(found.numCompletedTasks for i in stages if (found := track.getStageInfo(i))) < 200
