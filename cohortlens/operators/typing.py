"""Typing rules: score new people with a saved rule, in batch or on a stream.

A rule is a JSON object.  Scoring broadcasts it inside column expressions, so that it is one narrow stage without a
shuffle, and one person's result never depends on the others in the batch.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import softmax, total
from . import batch, gower


def centroid_rule(items: list[str], scaling: str, params: dict[str, tuple[float, float]], centres: list[list[float]], centre: dict[str, float] | None = None) -> dict:
    """params: item to (shift, spread); centres in scaled units; centre: what an unanswered item counts as."""
    return {
        "method": "centroid", "items": items, "scaling": scaling, "shift": [params[i][0] for i in items], "spread": [params[i][1] for i in items],
        "centres": centres, "fill": [(centre or {}).get(i, params[i][0] + (params[i][1] / 2 if scaling == "range" else 0.0)) for i in items],
    }


def to_json(rule: dict) -> str:
    return json.dumps(rule, ensure_ascii=False, sort_keys=True)


def from_json(text: str) -> dict:
    return json.loads(text)


def _need(df: DataFrame, rule: dict) -> None:
    missing = [i for i in rule["items"] if i not in df.columns]
    if missing:
        raise ValueError(f"_UNSCORABLE_ITEM:{missing[0]}")


def classify(rule: dict, df: DataFrame) -> DataFrame:
    """df with segment, confidence and off_scale.

    confidence is the nearest centre's share of the inverse distances, at three digits; off_scale counts answers outside the range of
    training, with a hundredth of it to spare, and is 0 for other scalings.  The lower segment wins ties.
    """
    _need(df, rule)
    raw = [F.col(i).cast("double") for i in rule["items"]]
    raw = [F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x) for x in raw]
    filled = [F.coalesce(x, F.lit(float(f))) for x, f in zip(raw, rule["fill"], strict=True)]
    if rule["scaling"] == "ipsative":
        mean = sum(filled[1:], filled[0]) / len(filled)
        scaled = [x - mean for x in filled]
    elif rule["scaling"] == "none":
        scaled = filled
    else:
        scaled = [(x - F.lit(float(s))) / F.lit(float(w)) for x, s, w in zip(filled, rule["shift"], rule["spread"], strict=True)]
    d = F.array(*(F.struct(F.sqrt(sum(((x - F.lit(float(c))) ** 2 for x, c in zip(scaled, cs, strict=True)), F.lit(0.0))).alias("d"), F.lit(i).cast("bigint").alias("segment")) for i, cs in enumerate(rule["centres"])))
    out = df.withColumn("_d", d)
    best = F.array_min("_d")
    inverse = lambda s: 1 / (s["d"] + 1e-9)
    share = inverse(best) / total(F.transform("_d", inverse))
    off: Column = F.lit(0)
    if rule["scaling"] == "range":
        for x, lo, w in zip(raw, rule["shift"], rule["spread"], strict=True):
            room = 1e-9 + 0.01 * w
            off = off + F.coalesce(((x < lo - room) | (x > lo + w + room)).cast("int"), F.lit(0))
    return out.withColumn("segment", best["segment"]).withColumn("confidence", F.bround(share, 3)).withColumn("off_scale", off.cast("bigint")).drop("_d")


def lca_rule(labelled: DataFrame, items: list[str], alpha: float = 0.5) -> dict:
    """Class weights and smoothed answer shares of (segment, items...); one aggregation over the unpivoted answers."""
    tall = labelled.select("segment", *(F.coalesce(F.col(i).cast("string"), F.lit("MISSING")).alias(i) for i in items)).unpivot("segment", items, "item", "level")
    rows = tall.groupBy("item", "segment", "level").count().collect()  # items x classes x levels
    classes = sorted({r["segment"] for r in rows})
    levels = {i: sorted({r["level"] for r in rows if r["item"] == i}) for i in items}
    n = {(r["item"], r["segment"], r["level"]): r["count"] for r in rows}
    sizes = {c: sum(n.get((items[0], c, v), 0) for v in levels[items[0]]) for c in classes}
    every = sum(sizes.values())
    theta = [[[(n.get((i, c, v), 0) + alpha) / (sizes[c] + alpha * len(levels[i])) for v in levels[i]] for c in classes] for i in items]
    return {"method": "lca", "items": items, "classes": classes, "weights": [sizes[c] / every for c in classes], "levels": [levels[i] for i in items], "theta": theta}


def classify_lca(rule: dict, df: DataFrame) -> DataFrame:
    """df with segment and confidence (the largest posterior, three digits); an answer that training never showed has no say."""
    _need(df, rule)
    k = len(rule["classes"])
    logs = [F.lit(w) for w in rule["weights"]]
    score = F.array(*(F.log(w) for w in logs))
    for item, levels, theta in zip(rule["items"], rule["levels"], rule["theta"], strict=True):
        votes = F.create_map(*(F.lit(v) for j, lv in enumerate(levels) for v in [lv, j]))
        table = F.array(*(F.array(*(F.log(F.lit(theta[c][j])) for c in range(k))) for j in range(len(levels))))
        at = votes[F.coalesce(F.col(item).cast("string"), F.lit("MISSING"))]
        score = F.when(at.isNull(), score).otherwise(F.zip_with(score, table[F.coalesce(at, F.lit(0))], lambda a, b: a + b))
    out = df.withColumn("_lp", score).withColumn("_p", softmax(F.col("_lp")))
    top = F.array_position("_lp", F.array_max("_lp"))
    classes = F.array(*(F.lit(c) for c in rule["classes"]))
    return out.withColumn("segment", F.element_at(classes, top.cast("int"))).withColumn("confidence", F.bround(F.array_max("_p"), 3)).drop("_lp", "_p")


def gower_rule(spec: gower.GowerSpec, prototypes: list[dict], likert: dict[str, dict[str, float]] | None = None) -> dict:
    """Prototypes in encoded units, with the specification that training fitted: scales, ranks of levels, known answers.

    likert: for items that arrive as words, what each word (lower case) counts.
    """
    return {"method": "gower", "items": list(spec.kinds), "spec": spec.to_json(), "prototypes": prototypes, "likert": likert or {}}


def _encoded(rule: dict, spec: gower.GowerSpec, df: DataFrame, item: str) -> Column:
    """An item in the units of training, by look-ups in the rule alone; an unseen or missing pick-one answer is null."""
    x = F.col(item)
    if spec.kinds[item] == gower.NOMINAL:
        return F.when(x.isin(spec.levels[item]), x)
    if points := rule["likert"].get(item):
        number = F.create_map(*(F.lit(v) for w, n in points.items() for v in (w, float(n))))[F.lower(F.trim(x.cast("string")))]
        x = F.coalesce(number, F.expr(f"try_cast(`{item}` AS double)"))
    elif dict(df.dtypes)[item] == "string":
        x = F.expr(f"try_cast(`{item}` AS double)")
    x = x.cast("double")
    x = F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(spec.centre[item]).cast("double"))
    if spec.kinds[item] == gower.NUMERIC:
        return x
    near = F.array(*(F.struct(F.abs(x - F.lit(level)).alias("off"), F.lit(level).alias("level"), F.lit(rank).alias("rank")) for level, rank in sorted(spec.ranks[item].items())))
    return F.array_min(near)["rank"]  # the lower level on ties


def classify_gower(rule: dict, df: DataFrame) -> DataFrame:
    """df with segment and confidence by Gower's distance to the rule's prototypes, one narrow stage without joins.

    Ratings take the rank of the nearest level that training showed, missing ones training's centre; an answer to a pick-one item that training
    never showed is a full mismatch with every prototype.  Words of a Likert item count what the rule says.  The lower segment wins ties.
    """
    _need(df, rule)
    spec = gower.GowerSpec.from_json(rule["spec"])
    own = {i: _encoded(rule, spec, df, i) for i in rule["items"]}
    out = df.withColumns({f"_e{n}": own[i] for n, i in enumerate(rule["items"])})
    at = {i: F.col(f"_e{n}") for n, i in enumerate(rule["items"])}

    def part(i: str, p: dict) -> Column:
        if spec.kinds[i] == gower.NOMINAL:
            return F.when(at[i] == F.lit(p[i]), 0.0).otherwise(1.0)
        return F.abs(at[i] - F.lit(float(p[i]))) / F.lit(float(spec.scale[i]))

    d = F.array(*(F.struct((sum((part(i, p) for i in rule["items"]), F.lit(0.0)) / len(rule["items"])).alias("d"), F.lit(c).cast("bigint").alias("segment")) for c, p in enumerate(rule["prototypes"])))
    out = out.withColumn("_d", d)
    share = (1 / (F.array_min("_d")["d"] + 1e-9)) / total(F.transform("_d", lambda s: 1 / (s["d"] + 1e-9)))
    return out.withColumn("segment", F.array_min("_d")["segment"]).withColumn("confidence", F.bround(share, 3)).drop("_d", *(f"_e{n}" for n in range(len(rule["items"]))))


def score(rule: dict, df: DataFrame) -> DataFrame:
    """By the rule's method; works unchanged on a streaming DataFrame."""
    return {"lca": classify_lca, "gower": classify_gower}.get(rule["method"], classify)(rule, df)


def cv_accuracy(labelled: DataFrame, folds: int = 5) -> DataFrame:
    """One row (accuracy, baseline, lift) of nearest-centroid typing of (id, segment, f), over folds stratified by segment in order of id.

    The centroids of all but one fold come from sums by segment, fold and position less the fold's own, so there is one pass
    over the people and a join with folds x segments rows.
    """
    rank = F.row_number().over(Window.partitionBy("segment").orderBy("id"))
    d = labelled.withColumn("fold", F.pmod(rank - 1, F.lit(folds)))
    at = d.select("segment", "fold", F.posexplode("f").alias("pos", "x")).groupBy("segment", "fold", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    tot = at.groupBy("segment", "pos").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = at.join(tot, ["segment", "pos"]).select("segment", "fold", "pos", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("m"))
    c = rest.groupBy("fold", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    c = c.groupBy("fold").agg(F.collect_list(F.struct("segment", "c")).alias("cs"))
    dist = F.array_min(F.transform("cs", lambda c: F.struct(total(F.zip_with(F.col("f"), c["c"], lambda x, y: (x - y) * (x - y))).alias("d"), c["segment"].alias("segment"))))["segment"]
    told = d.join(F.broadcast(c), "fold").select("segment", dist.alias("typed"))
    acc = told.agg(F.avg((F.col("segment") == F.col("typed")).cast("double")).alias("accuracy"))
    base = labelled.groupBy("segment").count().agg((F.max("count") / F.sum("count")).alias("baseline"))
    return acc.crossJoin(base).withColumn("lift", F.col("accuracy") - F.col("baseline"))


def stratified_folds(labelled: DataFrame, folds: int | Column) -> DataFrame:
    """labelled (id, segment, ...) with fold: people of a segment, in order of md5 of the id, are dealt round.

    Ranks are two-level, so that no task sorts a whole segment: buckets of the hash are counted first, then people are ranked inside theirs.
    """
    h = F.md5(F.col("id").cast("string").cast("binary"))
    d = labelled.withColumn("_h", h).withColumn("_b", F.substring(h, 1, 3))
    counts = d.groupBy("segment", "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("segment").orderBy("_b")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("segment", "_b").orderBy("_h", "id"))
    d = d.withColumn("_r", rank).join(counts, ["segment", "_b"])
    n = folds if isinstance(folds, Column) else F.lit(folds)
    return d.withColumn("fold", F.pmod(F.col("_before") + F.col("_r") - 1, n)).drop("_h", "_b", "_r", "_before")


def cv_typing(labelled: DataFrame, scaling: str = "range") -> DataFrame:
    """(segment, n, recall, accuracy, baseline, lift) of nearest-centroid typing of (id, segment, f) in raw units, one row a segment; scaling is fitted anew without each fold.

    Five stratified folds, fewer where a segment has fewer people.  Accuracy, lift and recall are null where a segment has one person only or there are
    fewer than ten people.  One aggregate by segment, fold and item gives every fold's scaling and centroids, as what all other folds have; only
    quantiles (``robust``) take a second one, over each person's four other folds.
    """
    if scaling not in ("range", "standardize", "robust", "none"):
        raise ValueError(f"no parameters for scaling {scaling!r}")
    spark = labelled.sparkSession
    sizes = {r["segment"]: r["n"] for r in labelled.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a segment
    n, kind = sum(sizes.values()), dict(labelled.dtypes)["segment"]
    schema = f"segment {kind}, n bigint, recall double, accuracy double, baseline double, lift double"
    if not sizes:
        return spark.createDataFrame([], schema)
    base = max(sizes.values()) / n
    if min(sizes.values()) < 2 or n < 10:
        return spark.createDataFrame([(s, m, None, None, base, None) for s, m in sorted(sizes.items())], schema)
    folds = min(5, *sizes.values())
    # What is persisted lies in as many partitions as its rows ask for, not in the session's number of them.
    d = stratified_folds(labelled.select("id", "segment", "f"), folds).repartition(batch.partitions(spark, n), "id").persist()
    x = F.col("x")
    by = d.select("segment", "fold", F.posexplode("f").alias("pos", "x")).groupBy("segment", "fold", "pos").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    cells = by.collect()  # folds x segments x items
    names, items = sorted(sizes), 1 + max((r["pos"] for r in cells), default=-1)
    count, added, squares = (np.zeros((len(names), folds, items)) for _ in range(3))
    lo, hi = np.full(count.shape, np.inf), np.full(count.shape, -np.inf)
    for r in cells:
        if r["n"]:
            at = names.index(r["segment"]), r["fold"], r["pos"]
            count[at], added[at], squares[at], lo[at], hi[at] = r["n"], r["s"], r["q"], r["lo"], r["hi"]
    iqr = {}
    if scaling == "robust":
        other = spark.range(folds).select(F.col("id").cast("int").alias("out"))
        rest = d.join(F.broadcast(other), F.col("fold") != F.col("out")).select("out", F.posexplode("f").alias("pos", "x"))
        found = rest.groupBy("out", "pos").agg((F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"))
        iqr = {(r["out"], r["pos"]): r["iqr"] for r in found.collect()}  # folds x items
    rules: list[list[dict]] = []
    for out in range(folds):
        train = np.arange(folds) != out
        n_, s_, q_ = (v[:, train].sum(axis=1) for v in (count, added, squares))
        every = np.maximum(n_.sum(axis=0), 1)
        if scaling == "range":
            spread = hi[:, train].max(axis=(0, 1)) - lo[:, train].min(axis=(0, 1))
        elif scaling == "standardize":
            spread = np.sqrt(np.maximum(0.0, q_.sum(axis=0) / every - (s_.sum(axis=0) / every) ** 2))
        elif scaling == "robust":
            spread = np.array([iqr.get((out, pos)) or 0.0 for pos in range(items)])
        else:
            spread = np.ones(items)
        # Shifts cancel in distances: of the scaled space only the spreads count.
        w = np.where(spread > 0, spread, 1.0)
        means = np.where(n_ > 0, s_ / np.maximum(n_, 1), np.nan)
        rules.append([{"segment": name, "c": [{"m": float(m), "w": float(v)} for m, v in zip(means[j], w, strict=True)]} for j, name in enumerate(names)])
    # As an Arrow table: rows of Python would start workers only to be read.
    parts = pa.list_(pa.struct([("segment", pa.array(names).type), ("c", pa.list_(pa.struct([("m", pa.float64()), ("w", pa.float64())])))]))
    c = spark.createDataFrame(pa.table({"fold": range(folds), "cs": pa.array(rules, parts)}))
    apart = lambda v, p: ((v - p["m"]) / p["w"]) * ((v - p["m"]) / p["w"])
    typed = F.array_min(F.transform("cs", lambda t: F.struct(total(F.zip_with(F.col("f"), t["c"], apart)).alias("d"), t["segment"].alias("segment"))))["segment"].cast(kind)
    told = d.join(F.broadcast(c), "fold").select("segment", (typed == F.col("segment")).cast("bigint").alias("ok"))
    out = told.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))
    every = out.agg((F.sum("ok") / F.sum("n")).alias("accuracy"))
    return out.crossJoin(every).select("segment", "n", (F.col("ok") / F.col("n")).alias("recall"), "accuracy", F.lit(base).alias("baseline"), (F.col("accuracy") - base).alias("lift"))
