"""Column builders over array<double> features; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def shared_distance(a: Column, b: Column) -> Column:
    """squared_distance over what neither lacks; null where that is nothing."""
    shared = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda d: d.isNotNull())
    return F.when(F.size(shared) > 0, total(shared))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def positive_or_one(x: Column) -> Column:
    """A spread to divide by: 1 where there is none."""
    return F.when(x > 0, x).otherwise(F.lit(1.0))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(total(F.transform(values, lambda x: F.exp(x - top))))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    return F.transform(values, lambda x: F.exp(x - top) / total(F.transform(values, lambda y: F.exp(y - top))))


def norm_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def clean_number(x: Column) -> Column:
    """Null for a number that is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def banded(x: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The first band's name whose lower limit x reaches."""
    out: Column | None = None
    for least, name in bands:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    assert out is not None
    return out.otherwise(otherwise)


def hopkins_reading(h: Column) -> Column:
    return banded(h, [(0.75, "strong"), (0.60, "moderate"), (0.45, "weak")], "none")


def jaccard_reading(j: Column) -> Column:
    return banded(j, [(0.85, "highly stable"), (0.75, "stable"), (0.60, "pattern"), (0.50, "doubtful")], "dissolved")


def dip_reading(p: Column) -> Column:
    return F.when(p < 0.01, "strong").when(p < 0.05, "moderate").when(p < 0.10, "weak").otherwise("none")


def role_reading(share: Column) -> Column:
    return banded(share, [(0.15, "drives segmentation"), (0.05, "contributes")], "near-noise (consider dropping)")


def tendency(hopkins: Column, dip_p: Column) -> Column:
    """Which of two clustering-tendency tests speak for groups; null without a dip test."""
    return F.when(dip_p.isNull(), F.lit(None)).when((hopkins >= 0.60) & (dip_p < 0.05), "both").when((hopkins >= 0.60), "hopkins only").when(dip_p < 0.05, "dip only").otherwise("neither")
