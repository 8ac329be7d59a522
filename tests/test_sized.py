"""Steps over orders and customers lie in as many partitions as there are lines for."""

from __future__ import annotations

import numpy as np
import pytest
import re

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from cohortlens.operators import design, validity, views
from cohortlens.plans import preferring
from cohortlens.sources import ingest


def test_choices_follow_the_number_of_lines(spark, data, monkeypatch):
    """A task's share grew with the tables."""
    want = sorted(views.choices(spark, data).collect())
    monkeypatch.setattr(views, "LINES", 500)
    c = views.choices(spark, data)
    assert c.rdd.getNumPartitions() == -(-views.table(spark, data, "lineitem").count() // 500)
    assert sorted(c.collect()) == want


def test_pairs_of_screens_are_counted_without_a_join_of_screens(spark):
    """F22, F23; a repeated item counts as often as a join of the rows would."""
    rows = [(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "b"), (2, 1, "c"), (None, 1, "a"), (None, 1, "b")]
    got = design.pair_balance(spark.createDataFrame(rows, "respondent_id int, set int, item string")).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 2), ("a", "c", 0), ("b", "c", 1)]


def test_hits_are_kept(spark, data):
    """every step of a search read the tables again."""
    hits, _, _ = preferring._hits(spark, data)
    assert hits.storageLevel.useMemory
    hits.unpersist()


def test_many_parts_lie_by_key(spark, data, monkeypatch):
    """lines met their parts in the session's shuffle partitions, however many lines there were."""
    want = sorted(views.choices(spark, data).collect())
    monkeypatch.setattr(views, "PARTS_SENT", 10)
    monkeypatch.setattr(views, "LINES", 500)
    c = views.choices(spark, data)
    n = -(-views.table(spark, data, "lineitem").count() // 500)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert dict(re.findall(r"RepartitionByExpression \[(\w+)#\d+L?\], (\d+)", plan)) == dict.fromkeys(["l_partkey", "p_partkey", "l_orderkey", "o_orderkey"], str(n))
    assert sorted(c.collect()) == want


def test_first_sets_lie_in_as_many_partitions_as_choices(spark, data, monkeypatch):
    """first sets were joined and pivoted in the session's shuffle partitions."""
    want = sorted(preferring._wide(spark, data).collect())
    monkeypatch.setattr(views, "LINES", 500)
    w = preferring._wide(spark, data)
    assert w.rdd.getNumPartitions() == views.dealt_choices(spark, data)[1] > 4
    assert sorted(w.collect()) == want


def test_different_values_are_told_apart_in_parts(spark, monkeypatch):
    """one task held all values of all columns of its rows; equal numbers and times count once as before."""
    from datetime import datetime

    rows = [(i, [0.0, -0.0, None, float("nan")][i % 4], f"t{i % 3}", datetime(2024, 10, 27, 0, i % 2), i % 2 == 0, b"\xff" if i % 2 else b"\xfe", [i % 5]) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d timestamp, e boolean, f binary, g array<int>")
    want = df.agg(*(F.countDistinct(c) for c in df.columns)).first()
    monkeypatch.setattr(ingest, "ROWS", 50)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by, old=DataFrame.repartition: parts.append(n) or old(self, n, *by))
    parts = []
    assert ingest._distinct(df, df.columns, dict(df.dtypes)) == dict(enumerate(want))
    assert parts == [9]


def test_hopkins_tiles_are_all_pairs(spark, monkeypatch):
    """every probe met every person as a row; boxes too far away are skipped, and copies, one at the same place and the person itself count as before."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random((900, 3)), rng.normal(0.5, 0.01, (300, 3))])
    x[5] = x[4]
    asked = np.concatenate([x[:200], rng.random((150, 3)) * 1.4 - 0.2])
    own = np.concatenate([np.arange(200), np.full(150, -1)])
    d = ((asked[:, None] - x) ** 2).sum(axis=2)
    d[np.arange(200), np.arange(200)] = np.inf
    assert np.allclose(validity._nearest(asked, own, x, np.arange(len(x))), d.min(axis=1), atol=0, rtol=1e-12)
    monkeypatch.setattr(validity, "TILE", 200)
    real = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, f array<double>")
    probes = spark.createDataFrame([(i if i < 200 else -i, r.tolist(), i < 200) for i, r in enumerate(asked)], "id bigint, f array<double>, is_person boolean")
    near = np.sqrt(d.min(axis=1))
    h = validity.hopkins(real, probes)
    assert "CartesianProduct" not in (plan := h._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert h.first()[0] == pytest.approx(near[200:].sum() / near.sum(), rel=1e-12)
