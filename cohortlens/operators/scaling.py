"""Scaling, imputation, constant items and coding over the long form (id, item, x).

Parameters have one row an item, so they are joined by broadcast; the answers themselves are only scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_number, positive_or_one


def scale_fit(long: DataFrame, how: str) -> DataFrame:
    """(item, shift, spread) of range, standardize or robust scaling; a spread of zero divides by one."""
    if how == "range":
        shift, spread = F.min("x"), F.max("x") - F.min("x")
    elif how == "standardize":
        shift, spread = F.avg("x"), F.stddev_pop("x")
    elif how == "robust":
        shift, spread = F.percentile("x", F.lit(0.5)), F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))
    else:
        raise ValueError(f"no parameters for scaling {how!r}")
    return long.groupBy("item").agg(shift.alias("shift"), spread.alias("spread")).withColumn("spread", positive_or_one(F.col("spread")))


def scale_apply(long: DataFrame, params: DataFrame) -> DataFrame:
    return long.join(F.broadcast(params), "item").select("id", "item", ((F.col("x") - F.col("shift")) / F.col("spread")).alias("x"))


def scale(long: DataFrame, how: str = "range") -> DataFrame:
    """(id, item, x) scaled by range, standardize, robust, ipsative (less the row's mean) or none."""
    if how == "none":
        return long
    if how == "ipsative":
        means = long.groupBy("id").agg(F.avg("x").alias("m"))
        return long.join(means, "id").select("id", "item", (F.col("x") - F.col("m")).alias("x"))
    return scale_apply(long, scale_fit(long, how))


def impute_mean(long: DataFrame) -> DataFrame:
    """Nulls and numbers that are not finite take their item's mean."""
    clean = long.withColumn("x", clean_number(F.col("x")))
    means = clean.groupBy("item").agg(F.avg("x").alias("m"))
    return clean.join(F.broadcast(means), "item").select("id", "item", F.coalesce("x", "m").alias("x"))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Nulls of a pick-any column take its commonest value, the smallest on ties."""
    mode = df.filter(F.col(column).isNotNull()).groupBy(column).count().agg(F.min_by(column, F.struct(-F.col("count"), column)).alias("_mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(column, F.coalesce(column, "_mode")).drop("_mode")


def drop_incomplete(long: DataFrame, n_items: int) -> DataFrame:
    """Only respondents who answered all items."""
    whole = long.withColumn("x", clean_number(F.col("x"))).groupBy("id").agg(F.count("x").alias("n")).filter(F.col("n") == n_items)
    return long.join(whole.select("id"), "id", "left_semi")


def drop_constant(long: DataFrame, least: float = 1e-12) -> DataFrame:
    """Only items whose sample standard deviation is above ``least``."""
    varied = long.groupBy("item").agg(F.stddev_samp("x").alias("sd")).filter(F.col("sd") > least)
    return long.join(F.broadcast(varied.select("item")), "item", "left_semi")


def code_levels(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Adds ``code``: the rank from 0 of the value's text among the column's levels; nulls are the level ``missing`` or stay null."""
    text = F.col(column).cast("string")
    df = df.withColumn("_level", text if missing is None else F.coalesce(text, F.lit(missing)))
    levels = df.filter("_level is not null").select("_level").distinct().withColumn("code", F.row_number().over(Window.orderBy("_level")).cast("bigint") - 1)
    return df.join(levels, "_level", "left").drop("_level")  # small levels are broadcast by their measured size


def recode(text: Column, scales: list[list[str]]) -> Column:
    """Position from 1 of a phrase in the scale that holds it; null elsewhere."""
    words = {w: i for s in scales for i, w in enumerate(s, 1)}
    return F.create_map(*(F.lit(v) for pair in words.items() for v in pair))[F.lower(F.trim(text))]
