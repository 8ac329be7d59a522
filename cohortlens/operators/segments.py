"""Assignment to centres, segment summaries and the per-person fit, over (id, f) with f an array of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import shared_distance


def distances(people: DataFrame, centres: DataFrame) -> DataFrame:
    """people with ``d``: an array of (far, squared distance, segment), nearest first, the lower segment on ties.

    Answers that one of both lacks count nothing; a centre that shares none is far, with a null distance, and comes last.
    The centres are few (one a segment) and travel as one broadcast row, so this is one narrow stage.
    """
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("segment", F.col("f").alias("c")))).alias("cs"))
    both = F.transform("cs", lambda c: F.struct(shared_distance(F.col("f"), c["c"]).alias("d2"), c["segment"].alias("segment")))
    d = F.array_sort(F.transform(both, lambda c: F.struct(c["d2"].isNull().alias("far"), c["d2"].alias("d2"), c["segment"].alias("segment"))))
    return people.crossJoin(F.broadcast(packed)).withColumn("d", d).drop("cs")


def assign(people: DataFrame, centres: DataFrame) -> DataFrame:
    """people with segment and d2 of the nearest centre."""
    return distances(people, centres).withColumn("segment", F.col("d")[0]["segment"]).withColumn("d2", F.col("d")[0]["d2"]).drop("d")


def first_centres(people: DataFrame, k: int) -> DataFrame:
    """(segment, f): the people of the k smallest ids."""
    few = people.filter("id is not null").orderBy("id").limit(k)
    return few.select((F.row_number().over(Window.orderBy("id")) - 1).cast("bigint").alias("segment"), "f")


def centroids(labelled: DataFrame) -> DataFrame:
    """(segment, f): means of a segment's people."""
    at = labelled.select("segment", F.posexplode("f").alias("pos", "x")).groupBy("segment", "pos").agg(F.avg("x").alias("m"))
    return at.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("f"))


def lloyd(people: DataFrame, centres: DataFrame, steps: int) -> DataFrame:
    """centres after some steps of assignment and averaging; a centre that loses all its people stays."""
    for _ in range(steps):
        new = centroids(assign(people, centres).select("segment", "f"))
        kept = centres.withColumnRenamed("f", "old").join(new, "segment", "left").select("segment", F.coalesce("f", "old").alias("f"))
        rows = kept.collect()  # k rows
        centres = people.sparkSession.createDataFrame(rows, kept.schema)
    return centres


def sizes(labelled: DataFrame) -> DataFrame:
    """(segment, n, share), shares rounded half to even at three digits."""
    n = labelled.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 3))


def weighted_share(labelled: DataFrame, weight: str) -> DataFrame:
    """(segment, population_share); weights that are negative, null or not finite count nothing."""
    w = F.col(weight)
    w = F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), 0.0).otherwise(w)
    sums = labelled.groupBy("segment").agg(F.sum(w).alias("w"))
    return sums.select("segment", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("population_share"))


def shadow_fit(people: DataFrame, centres: DataFrame, *also: str) -> DataFrame:
    """(id, closest, second, shadow, fit) and what ``also`` names of people: s = 2 d1 / (d1 + d2) of the distances to the two nearest centres; fit = 1 - s."""
    d = distances(people, centres)
    d1, d2 = F.sqrt(F.col("d")[0]["d2"]), F.sqrt(F.col("d")[1]["d2"])
    s = F.when(d1 + d2 > 0, 2 * d1 / (d1 + d2)).otherwise(0.0)
    return d.select("id", F.col("d")[0]["segment"].alias("closest"), F.col("d")[1]["segment"].alias("second"), s.alias("shadow"), F.bround(1 - s, 3).alias("fit"), *also)


def neighbours(fits: DataFrame) -> DataFrame:
    """(closest, second, mean_shadow, n) over people by their two nearest segments."""
    return fits.groupBy("closest", "second").agg(F.avg("shadow").alias("mean_shadow"), F.count(F.lit(1)).alias("n"))


def defining_items(labelled_long: DataFrame, top: int = 4) -> DataFrame:
    """(segment, item, diff, side): the items in which a segment's mean lies furthest above and below everyone's."""
    means = labelled_long.groupBy("segment", "item").agg(F.avg("x").alias("m"))
    grand = labelled_long.groupBy("item").agg(F.avg("x").alias("g"))
    diff = means.join(F.broadcast(grand), "item").withColumn("diff", F.col("m") - F.col("g"))
    up, down = Window.partitionBy("segment").orderBy(F.desc("diff"), "item"), Window.partitionBy("segment").orderBy("diff", "item")
    n = F.count(F.lit(1)).over(Window.partitionBy("segment"))
    half = F.greatest(F.lit(1), F.least(F.lit(top), F.floor(n / 2)))
    d = diff.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).withColumn("half", half)
    side = F.when(F.col("up") <= F.col("half"), "high").when(F.col("down") <= F.col("half"), "low")
    return d.withColumn("side", side).filter("side is not null").select("segment", "item", "diff", "side")


def picks(labelled: DataFrame, column: str) -> DataFrame:
    """(segment, pick, share, overall): each segment's commonest answer, its share there and among everyone."""
    n = labelled.groupBy("segment", column).count()
    share = n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("segment")))
    overall = n.groupBy(column).agg(F.sum("count").alias("c")).withColumn("overall", F.col("c") / F.sum("c").over(Window.partitionBy())).drop("c")
    best = share.groupBy("segment").agg(F.min_by(F.struct(column, "share"), F.struct(-F.col("count"), column)).alias("b")).select("segment", F.col("b")[column].alias("pick"), F.col("b")["share"].alias("share"))
    return best.join(F.broadcast(overall.withColumnRenamed(column, "pick")), "pick")
