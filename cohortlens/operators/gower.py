"""Gower's mixed-scale distance: midranks, specification, encoding, embedding and prototypes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import positive_or_one

NUMERIC, ORDINAL, NOMINAL = "numeric", "ordinal", "nominal"
#: A level that the data the specification was fitted on never showed.
UNSEEN = float("-inf")


def midranks(df: DataFrame, column: str) -> DataFrame:
    """(value, midrank): the mean rank of equal values; from counts of values, so the rows are only grouped."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("midrank", upto - (F.col("n") - 1) / 2).select("value", F.col("midrank").cast("double").alias("midrank"))


def nearest_levels(values: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """Adds ``level``: the nearest of ``levels.value``, the lower on ties.

    Distinct values and levels are sorted together once; the last level before and the first after are running values of that
    order, and only distinct values pass through it, not the rows.
    """
    marks = values.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("mark", F.lit(None).cast("double"))
    marks = marks.union(levels.select("value", F.col("value").cast("double").alias("mark")))
    before, after = Window.orderBy("value", F.col("mark").isNull()), Window.orderBy(F.desc("value"), F.col("mark").isNull())
    found = marks.withColumn("lo", F.last("mark", True).over(before)).withColumn("hi", F.last("mark", True).over(after)).filter("mark is null")
    near = F.when(F.col("hi").isNull() | (F.col("value") - F.col("lo") <= F.col("hi") - F.col("value")), F.col("lo")).otherwise(F.col("hi"))
    return values.join(found.select(F.col("value").alias(column), near.alias("level")), column, "left")


@dataclass
class GowerSpec:
    """What distances need, fitted once: kinds, scales and centres by column, ranks of ordinal values, levels of nominal ones."""

    kinds: dict[str, str]
    scale: dict[str, float] = field(default_factory=dict)
    centre: dict[str, object] = field(default_factory=dict)
    ranks: dict[str, dict[float, float]] = field(default_factory=dict)
    levels: dict[str, list] = field(default_factory=dict)

    def to_json(self) -> dict:
        """Plain values; the unseen level is the text "-inf"."""
        safe = lambda v: "-inf" if v == UNSEEN else v
        return {"kinds": self.kinds, "scale": self.scale, "centre": {k: safe(v) for k, v in self.centre.items()}, "ranks": {c: [[k, v] for k, v in r.items()] for c, r in self.ranks.items()}, "levels": {c: [safe(v) for v in x] for c, x in self.levels.items()}}

    @classmethod
    def from_json(cls, d: dict) -> GowerSpec:
        back = lambda v: UNSEEN if v == "-inf" else v
        return cls(d["kinds"], d["scale"], {k: back(v) for k, v in d["centre"].items()}, {c: {float(k): v for k, v in r} for c, r in d["ranks"].items()}, {c: [back(v) for v in x] for c, x in d["levels"].items()})


def fit_spec(df: DataFrame, kinds: dict[str, str]) -> GowerSpec:
    """The scale of a numeric column is its range, of an ordinal one the range of midranks; centres are median, median level and mode."""
    spec = GowerSpec(dict(kinds))
    for c, kind in kinds.items():
        if kind == NOMINAL:
            rows = df.filter(F.col(c).isNotNull()).groupBy(c).count().collect()  # one row a level
            spec.levels[c] = sorted(r[c] for r in rows)
            spec.centre[c] = min(rows, key=lambda r: (-r["count"], r[c]))[c] if rows else None
            spec.scale[c] = 1.0
        elif kind == ORDINAL:
            rows = midranks(df, c).orderBy("value").collect()
            spec.ranks[c] = {float(r["value"]): r["midrank"] for r in rows}
            span = rows[-1]["midrank"] - rows[0]["midrank"] if rows else 0.0
            spec.scale[c] = span if span > 0 else 1.0
            spec.centre[c] = df.agg(F.percentile(c, F.lit(0.5))).first()[0]
        else:
            lo, hi, mid = df.agg(F.min(c), F.max(c), F.percentile(c, F.lit(0.5))).first()
            spec.scale[c] = float(hi - lo) if lo is not None and hi > lo else 1.0
            spec.centre[c] = mid
    return spec


def encode(df: DataFrame, spec: GowerSpec) -> DataFrame:
    """Ordinal columns become midranks of their nearest known level, unseen nominal levels UNSEEN; nulls the centre."""
    for c, kind in spec.kinds.items():
        if kind == NOMINAL:
            continue
        if kind == ORDINAL:
            levels = df.sparkSession.createDataFrame([(k, v) for k, v in spec.ranks[c].items()], "value double, rank double")
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(spec.centre[c]).cast("double")))
            near = nearest_levels(df.select(c).distinct(), levels, c).join(F.broadcast(levels.withColumnRenamed("value", "level")), "level").select(c, "rank")
            df = df.join(F.broadcast(near) if len(spec.ranks[c]) <= 10_000 else near, c).withColumn(c, F.col("rank")).drop("rank")
        else:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(spec.centre[c]).cast("double")))
    return df


def distance(spec: GowerSpec, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean over columns of |difference| / scale, or of mismatch."""
    parts = [F.when(a[c].eqNullSafe(b[c]), 0.0).otherwise(1.0) if kind == NOMINAL else F.abs(a[c] - b[c]) / F.lit(spec.scale[c]) for c, kind in spec.kinds.items()]
    return sum(parts[1:], parts[0]) / len(parts)


def embedding(spec: GowerSpec, cols: dict[str, Column]) -> Column:
    """An array whose Manhattan distance is the number of columns times Gower's distance."""
    out = []
    for c, kind in spec.kinds.items():
        if kind == NOMINAL:
            known = [F.when(cols[c] == F.lit(v), 0.5).otherwise(0.0) for v in spec.levels[c]]
            out += [*known, F.when(cols[c].isin(spec.levels[c]), 0.0).otherwise(0.5)]
        else:
            out.append(cols[c] / F.lit(spec.scale[c]))
    return F.array(*out)


def update_prototypes(labelled: DataFrame, spec: GowerSpec, by: str = "segment") -> DataFrame:
    """One row a segment: medians of numeric columns, the level nearest the median midrank of ordinal ones, modes (smallest on ties) of nominal ones."""
    out = labelled.groupBy(by).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c, kind in spec.kinds.items() if kind != NOMINAL), F.count(F.lit(1)).alias("n"))
    for c, kind in spec.kinds.items():
        if kind == NOMINAL:
            mode = labelled.groupBy(by, c).count().groupBy(by).agg(F.min_by(c, F.struct(-F.col("count"), c)).alias(c))
            out = out.join(mode, by)
        elif kind == ORDINAL:
            ranks = [F.struct(F.abs(F.lit(v) - F.col(c)).alias("d"), F.lit(v).alias("r")) for v in sorted(spec.ranks[c].values())]
            out = out.withColumn(c, F.array_min(F.array(*ranks))["r"])
    return out


def unit(x: Column) -> Column:
    return positive_or_one(x)
