"""What sets segments apart: shares of variance, association, tests and multiple-testing control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.columns import role_reading


def moments(labelled_long: DataFrame) -> DataFrame:
    """(item, n, k, between, within) of (segment, item, x): one aggregation by segment and item, and one over its few rows."""
    by = labelled_long.groupBy("segment", "item").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    by = by.withColumn("g", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("item")) / F.sum("n").over(Window.partitionBy("item")))
    return by.groupBy("item").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))


def eta_squared(labelled_long: DataFrame) -> DataFrame:
    """(item, eta_squared, role)."""
    total = F.col("between") + F.col("within")
    e = moments(labelled_long).select("item", F.bround(F.when(total > 0, F.col("between") / total).otherwise(0.0), 3).alias("eta_squared"))
    return e.withColumn("role", role_reading(F.col("eta_squared")))


def anova(labelled_long: DataFrame) -> DataFrame:
    """(item, f, df1, df2)."""
    m = moments(labelled_long)
    return m.select("item", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def chi_squared(labelled: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row (chi2, df, n, rows, cols) of the contingency of a and b, nulls left out; Yates' correction at one degree of freedom.

    Empty cells enter through the margins: sum (o - e)^2 / e over all cells, with zero-count cells from the cross of the two
    margins, which have as many rows as the columns have levels.
    """
    cells = labelled.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    full = rows.crossJoin(F.broadcast(cols)).join(cells, ["a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    every = Window.partitionBy()
    full = full.withColumn("n", F.sum("o").over(every)).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    shape = full.agg(F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"))
    off = F.abs(F.col("o") - F.col("e"))
    cut = off - F.least(F.lit(0.5), off)
    s = full.agg(F.sum(off**2 / F.col("e")).alias("plain"), F.sum(cut**2 / F.col("e")).alias("cut"), F.max("n").alias("n")).crossJoin(shape)
    df = (F.col("rows") - 1) * (F.col("cols") - 1)
    return s.select(F.when(F.lit(yates) & (df == 1), F.col("cut")).otherwise(F.col("plain")).alias("chi2"), df.alias("df"), "n", "rows", "cols")


def cramers_v2(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Cramer's V squared with Bergsma's correction."""
    c = chi_squared(labelled, a, b, yates=False)
    n, r, k = F.col("n"), F.col("rows"), F.col("cols")
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - (r - 1) * (k - 1) / (n - 1))
    room = F.least(r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) - 1
    return c.select(F.when((F.least(r, k) >= 2) & (room > 0), phi2 / room).otherwise(0.0).alias("v2"))


def kruskal(labelled: DataFrame, value: str) -> DataFrame:
    """One row (h, df): Kruskal-Wallis with correction for ties; midranks come from counts of values, not from ranking rows."""
    cells = labelled.filter(F.col(value).isNotNull()).groupBy("segment", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ties = cells.groupBy("v").agg(F.sum("c").alias("t"))
    upto = F.sum("t").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = ties.withColumn("rank", upto - (F.col("t") - 1) / 2)
    by = cells.join(ranks, "v").groupBy("segment").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("n"))
    h = by.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    t = ties.agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("t"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.crossJoin(t).select((raw / (1 - F.col("t") / (n**3 - n))).alias("h"), (F.col("k") - 1).alias("df"))


def group_medians(labelled: DataFrame, value: str) -> DataFrame:
    return labelled.groupBy("segment").agg(F.percentile(value, F.lit(0.5)).alias("median"))


def bh_fdr(pvalues: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds significant: Benjamini-Hochberg step-up over (name, p)."""
    by, every = Window.orderBy("p", "name"), Window.partitionBy()
    r = pvalues.withColumn("i", F.row_number().over(by)).withColumn("m", F.count(F.lit(1)).over(every))
    last = F.max(F.when(F.col("p") <= F.col("i") / F.col("m") * alpha, F.col("i"))).over(every)
    return r.withColumn("significant", F.col("i") <= F.coalesce(last, F.lit(0))).drop("i", "m")


def profile_traits(labelled: DataFrame, traits: list[str], most_levels: int = 12, alpha: float = 0.05) -> DataFrame:
    """(name, test, statistic, df, p, significant) of background traits against segments, the surest first.

    Text and numbers of few levels go to chi-squared, other numbers to Kruskal-Wallis.
    """
    spark = labelled.sparkSession
    kinds = dict(labelled.dtypes)
    levels = labelled.agg(*(F.countDistinct(t).alias(t) for t in traits)).first()
    rows = []
    for t in traits:
        if kinds[t] == "string" or levels[t] <= most_levels:
            if levels[t] < 2:
                continue
            c = chi_squared(labelled, "segment", t).first()
            rows.append((t, "chi-squared", c["chi2"], int(c["df"]), tails.chi2_tail(c["chi2"], c["df"])))
        else:
            h = kruskal(labelled, t).first()
            rows.append((t, "Kruskal-Wallis", h["h"], int(h["df"]), tails.chi2_tail(h["h"], h["df"])))
    return bh_fdr(spark.createDataFrame(rows, "name string, test string, statistic double, df int, p double"), alpha).orderBy("p", "name")
