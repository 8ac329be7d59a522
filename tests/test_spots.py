"""Positions of people who lack an item, and of those who lie in the very middle between two positions."""

from __future__ import annotations

import numpy as np

from cohortlens.operators import views
from cohortlens.plans import catalog

import oracle

KINDS = ["click", "error", "purchase", "signup", "view"]


def events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_people_who_lack_an_item_keep_their_places(spark, tmp_path):
    """an array of the answered items alone was read by place, so that one person without views failed the whole query."""
    rng = np.random.default_rng(5)
    rows = [(u, k, round(float(v), 2)) for u in range(40) for k, v in zip(KINDS, rng.exponential(50, 5), strict=True)]
    lack = {(1, "error"), (7, "view"), (9, "click"), (9, "purchase"), (11, "signup")}
    rows = [r for r in rows if r[:2] not in lack] + [(None, "view", 3.0), (12, "view", None)]
    folder = events(spark, tmp_path, [(i, *r) for i, r in enumerate(rows)])
    for name in ("map_spots", "assign_nearest_centroid", "segment_sizes"):
        files = oracle.duckdb.connect()
        files.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        oracle.same(catalog.QUERIES[name](spark, folder).toPandas(), files.execute(catalog.ORACLES[name]).df())


def test_means_add_values_in_the_order_of_events(spark, tmp_path):
    """the order in which tasks met decided the last digit, and with it the position of people in the very middle."""
    rows = [(3, 1, "view", 0.3), (2, 1, "view", 0.2), (1, 1, "view", 0.1), (4, 1, "view", None), (5, 2, "view", None)]
    folder = events(spark, tmp_path, rows)
    got = {r["id"]: r["x"] for r in views.ratings_in_order(spark, folder).collect()}
    assert got == {1: (0.1 + 0.2 + 0.3) / 3, 2: None} and 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
