"""Words for numbers and questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import banded

#: Words that a shortened question does not end with.
LOOSE_ENDS = "to for of in on at a an the and or rather than with by from that as is are my own it about would will can".split()


def short_label(text: Column, most: int = 30) -> Column:
    """A question of at most ``most`` characters: cut after a word that can end a phrase, with an ellipsis; without a leading I and its question mark."""
    flat = F.trim(F.regexp_replace(text, r"[\s_]+", " "))
    flat = F.regexp_replace(F.regexp_replace(flat, r"[\s?]+$", ""), r"^[Ii] +", "")
    head = F.regexp_extract(flat, rf"^(.{{1,{most}}}) ", 1)
    loose = "|".join(LOOSE_ENDS)
    kept = F.regexp_replace(F.concat(F.lit(" "), head), rf"(?i)( ({loose}))+$", "")
    first = F.regexp_extract(flat, r"^([^ ]+)", 1)  # a first word alone stays, however long or loose
    kept = F.when(F.trim(kept) == "", first).otherwise(F.trim(kept))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(kept, F.lit("…")))


def plural(unit: str) -> str:
    return f"{unit}es" if unit[-2:] in ("ch", "sh") or unit[-1:] in ("s", "x", "z") else f"{unit}s"


def fraction(share: Column) -> Column:
    """about half, about 1 in 3 to 10, each with its percentage, where that is within three points; else the percentage."""
    percent = F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))
    near = F.array_min(F.transform(F.sequence(F.lit(3), F.lit(10)), lambda d: F.struct(F.abs(share - 1 / d).alias("off"), d.alias("d"))))
    one_in = F.concat(F.lit("about 1 in "), near["d"].cast("string"), F.lit(" ("), percent, F.lit(")"))
    return F.when(share >= 0.45, F.concat(F.lit("about half ("), percent, F.lit(")"))).when(near["off"] <= 0.03, one_in).otherwise(percent)


def hopkins_doubts(distinct_share: Column, items: Column) -> Column:
    """Why the Hopkins statistic reads high on these data: many people with the same answers, or few items; an empty array where nothing speaks against it."""
    return F.array_compact(F.array(F.when(distinct_share < 0.5, F.lit("same answers")), F.when((items > 0) & (items <= 3), F.lit("few items"))))


def typing_verdict(accuracy: Column, baseline: Column) -> Column:
    return F.when(accuracy.isNull(), F.lit("not estimated")).when((accuracy >= 0.85) & (accuracy - baseline >= 0.15), "safe to deploy").when(accuracy >= 0.60, "workable").otherwise("unstable")


def persistence_verdict(weakest: Column) -> Column:
    """Of the least share of a segment that stays together with one group fewer."""
    return banded(weakest, [(0.70, "holds"), (0.55, "boundary is a choice")], "scatters")


def neighbours_verdict(worst: Column) -> Column:
    """Of the closest pair's mean shadow."""
    return banded(worst, [(0.80, "barely distinguishable"), (0.55, "shade into one another")], "own territory")
