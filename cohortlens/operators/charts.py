"""Data of charts: who lies next to whom, which group each spot of a map falls to, histograms whose bins fit the smallest group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour_pairs(neighbours: DataFrame, most: int = 4) -> DataFrame:
    """(a, b, mean_shadow, n): of (closest, second, mean_shadow, n) the pairs that are most alike, each once, in the direction that is."""
    pair = Window.partitionBy("a", "b").orderBy(F.desc("mean_shadow"), "closest")
    both = neighbours.withColumns({"a": F.least("closest", "second"), "b": F.greatest("closest", "second")})
    both = both.withColumn("_n", F.row_number().over(pair)).filter("_n = 1")  # one row for each pair of segments
    return both.orderBy(F.desc("mean_shadow"), "a", "b").limit(most).select("a", "b", "mean_shadow", "n")


def map_centres(points: DataFrame) -> DataFrame:
    """(segment, cx, cy) of (segment, x, y)."""
    return points.groupBy("segment").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def _nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    packed = centres.agg(F.collect_list(F.struct("segment", "cx", "cy")).alias("cs"))  # one row a segment
    d = lambda c: F.struct(((F.col("x") - c["cx"]) ** 2 + (F.col("y") - c["cy"]) ** 2).alias("d"), c["segment"].alias("segment"))
    return points.crossJoin(F.broadcast(packed)).withColumn("region", F.array_min(F.transform("cs", d))["segment"]).drop("cs")


def decision_grid(points: DataFrame, steps: int = 320, margin: float = 0.07) -> DataFrame:
    """(i, j, x, y, region): which segment's centre on the map is nearest to each spot of a grid over all points, with a margin."""
    centres = map_centres(points)
    ends = points.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    grid = points.sparkSession.range(steps * steps).select((F.col("id") % steps).cast("int").alias("i"), (F.col("id") / steps).cast("int").alias("j"))
    out = grid.crossJoin(F.broadcast(ends))
    for c, at in (("x", "i"), ("y", "j")):
        span = F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}")).otherwise(1.0)
        out = out.withColumn(c, F.col(f"lo{c}") - margin * span + F.col(at) / (steps - 1) * (1 + 2 * margin) * span)
    return _nearest(out.filter("lox is not null").select("i", "j", "x", "y"), centres)


def map_agreement(points: DataFrame) -> DataFrame:
    """One row (n, agree): how often the nearest centre on the map is a person's own segment's."""
    told = _nearest(points.select("segment", "x", "y"), map_centres(points))
    return told.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("region") == F.col("segment")).cast("double")).alias("agree"))


def histogram(values: DataFrame, lo: float | None = None, hi: float | None = None, bins: int | None = None) -> DataFrame:
    """(segment, bin, n, share) of (segment, value): bins of equal width, the last with its right end; share is of the segment.

    Ends are those of all values, if not given.  bins: as many as the smallest segment bears, 1.15 times the root of its people, from 10 to 26, if not given.
    """
    one = values.groupBy("segment").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    one = one.agg(F.min("n").alias("least"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    count = F.lit(bins) if bins else F.least(F.lit(26), F.greatest(F.lit(10), F.floor(F.sqrt("least") * 1.15))).cast("int")
    one = one.select(count.alias("bins"), F.coalesce(F.lit(lo), "lo").alias("lo"), F.coalesce(F.lit(hi), "hi").alias("hi"))
    flat = F.col("hi") <= F.col("lo")
    one = one.select("bins", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("lo") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))
    found = values.filter("value is not null").crossJoin(F.broadcast(one)).filter("value >= lo and value <= hi")
    found = found.groupBy("segment", F.least(at, F.col("bins") - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("segment")))


def build_all(charts: dict[str, Callable[[], DataFrame | None]]) -> tuple[dict[str, DataFrame], list[str]]:
    """(data by chart, what failed): each chart's data is computed on its own, so that one that fails leaves the others; None is left out."""
    out, errors = {}, []
    for name, make in charts.items():
        try:
            df = make()
            if df is not None:
                df.write.format("noop").mode("overwrite").save()  # plans fail where they run
                out[name] = df
        except Exception as e:
            errors.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
    return out, errors
