"""Latent classes over long categorical answers (id, item, level): one E step, one M step, and the fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import log_sum_exp


def m_step(answers: DataFrame, post: DataFrame, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(class weights: class, pi; shares: item, level, class, theta) from posteriors (id, class, p).

    Levels that a class never shows still count alpha: levels come from all answers.
    """
    pi = post.groupBy("class").agg(F.avg("p").alias("pi"))
    n = answers.join(post, "id").groupBy("item", "level", "class").agg(F.sum("p").alias("n"))
    grid = answers.select("item", "level").distinct().crossJoin(F.broadcast(pi.select("class")))
    full = grid.join(n, ["item", "level", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + alpha)
    sums = full.groupBy("item", "class").agg(F.sum("n").alias("s"))
    return pi, full.join(F.broadcast(sums), ["item", "class"]).select("item", "level", "class", (F.col("n") / F.col("s")).alias("theta"))


def e_step(answers: DataFrame, pi: DataFrame, theta: DataFrame) -> DataFrame:
    """(id, class, p, loglik): posteriors and each person's log-likelihood.

    Classes are few: an answer's log shares travel as one array, and a person's are summed class by class in one aggregation.
    """
    classes = [(r["class"], float(r["pi"])) for r in pi.orderBy("class").collect()]
    logs = theta.groupBy("item", "level").agg(F.map_from_entries(F.collect_list(F.struct("class", F.log("theta").alias("l")))).alias("ls"))  # one row a level
    shown = answers.join(F.broadcast(logs), ["item", "level"])
    sums = shown.groupBy("id").agg(*(F.sum(F.col("ls")[c]).alias(f"l{n}") for n, (c, _) in enumerate(classes)))
    joint = F.array(*(F.col(f"l{n}") + F.log(F.lit(w)) for n, (_, w) in enumerate(classes)))
    told = sums.select("id", joint.alias("ls")).select("id", "ls", log_sum_exp(F.col("ls")).alias("loglik"))
    each = F.explode(F.arrays_zip(F.array(*(F.lit(c) for c, _ in classes)).alias("class"), F.col("ls").alias("l"))).alias("z")
    kind = dict(pi.dtypes)["class"]
    return told.select("id", each, "loglik").select("id", F.col("z.class").cast(kind).alias("class"), F.exp(F.col("z.l") - F.col("loglik")).alias("p"), "loglik")
