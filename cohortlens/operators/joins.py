"""Joins of respondents with a second file: by key, or by position where there is no key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str = "row", first: str | None = None) -> DataFrame:
    """df with its rows numbered from 0 without gaps, in its own order.

    Rows are numbered inside their partition; a count of each partition, the only thing that reaches the driver, says how many come before.  df is
    evaluated twice and must give the same rows in the same order, as a scan does.  first: a column whose least value orders the partitions.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), (F.min(first) if first else F.min("_at")).alias("o")).collect()
    before, total = [], 0
    for r in sorted(counts, key=lambda r: (r["o"], r["p"])):
        before.append((r["p"], total))
        total += r["n"]
    table = df.sparkSession.createDataFrame(before, "_p bigint, _before bigint")  # one row a partition
    joined = at.withColumn("_p", part).join(F.broadcast(table), "_p")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_before")


def join_background(segments: DataFrame, background: DataFrame, key: str | None = None, on: str = "id") -> DataFrame:
    """background with the column segment: of the person whose ``on`` has the same text as ``key``, people in both only; by position where key is None or missing.

    By position both need the same number of rows, or ValueError("_ROWS_DIFFER") is raised.
    """
    if key is not None and key in background.columns:
        seg = segments.select(F.col(on).cast("string").alias("_key"), "segment")
        return background.withColumn("_key", F.col(key).cast("string")).join(seg, "_key").drop("_key")
    a, b = numbered(segments.select("segment"), "_row"), numbered(background, "_row")
    if a.count() != b.count():
        raise ValueError("_ROWS_DIFFER")
    return b.join(a, "_row").drop("_row")
