"""A whole study: from an export or a table to segments, their description, a typing rule, a report and a manifest.

Ratings go to k-means, ratings with pick-one answers to k-prototypes, pick-one answers alone to latent classes.  The number of groups comes from the
panel's votes or from the selection of latent classes, unless it is given.  Everything but small tables stays in the plan; names of files are fixed.
"""

from __future__ import annotations

import html
import json
import platform
from dataclasses import dataclass, field
from datetime import UTC, datetime
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_number
from ..sources import ingest
from . import batch, choice, gower, kproto, latent_batch, panel, profiling, reach, segments, typing, validity
from .joins import numbered

#: An item whose sample standard deviation is not above this tells nobody apart.
CONSTANT = 1e-12


@dataclass
class Study:
    """assignments: (id, segment, fit or confidence); tables: what is written beside them, by file name; rule; manifest."""

    assignments: DataFrame
    rule: dict
    manifest: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _with_id(clean: DataFrame, plan: ingest.Plan) -> DataFrame:
    """clean with the column id: the study's own, else a row number."""
    ids = plan.of("id")
    clean = clean.drop("row_idx")
    return clean.withColumnRenamed(ids[0], "id") if ids and ids[0] in clean.columns else numbered(clean, "id")


def _two(items: list[str]) -> list[str]:
    if len(items) < 2:
        raise ValueError("_TWO_ITEMS_NEEDED")
    return items


def _numeric(clean: DataFrame, items: list[str]) -> tuple[DataFrame, list[str], dict[str, tuple[float, float]]]:
    """(people, items, params): people (id, raw, f), persisted, of answers with means for gaps, without items that everybody answers alike.

    raw and f, raw scaled by range, are in order of items; params: (shift, spread) of each.  All that filling and scaling need are a few numbers an
    item, from one aggregation, so that people are mapped where they lie and never joined with themselves.
    """
    items = sorted(set(items))
    answers = clean.select("id", F.array(*(clean_number(F.col(f"`{c}`").cast("double")) for c in items)).alias("x"))
    told = [(F.count, "c"), (F.avg, "m"), (F.var_pop, "v"), (F.min, "lo"), (F.max, "hi")]
    one = answers.agg(F.count(F.lit(1)).alias("n"), *(f(F.col("x")[j]).alias(f"{name}{j}") for j in range(len(items)) for f, name in told)).first()
    n = one["n"]
    varied = [j for j in range(len(items)) if n > 1 and one[f"c{j}"] and sqrt(one[f"v{j}"] * one[f"c{j}"] / (n - 1)) > CONSTANT]  # filled gaps lie at the mean
    kept = _two([items[j] for j in varied])
    fill = [(F.col("x")[j], F.lit(one[f"m{j}"])) for j in varied]
    spreads = [one[f"hi{j}"] - one[f"lo{j}"] or 1.0 for j in varied]
    scales = F.array(*(F.struct(F.lit(one[f"lo{j}"]).alias("shift"), F.lit(w).alias("spread")) for j, w in zip(varied, spreads, strict=True)))
    people = answers.select("id", F.array(*(F.coalesce(x, m) for x, m in fill)).alias("raw")).repartition(batch.partitions(clean.sparkSession, n), "id")
    people = people.withColumn("f", F.zip_with("raw", scales, lambda x, p: (x - p["shift"]) / p["spread"])).persist()
    return people, kept, {c: (one[f"lo{j}"], w) for c, j, w in zip(kept, varied, spreads, strict=True)}


def _segment_numeric(clean: DataFrame, items: list[str], k: int | None, resamples: int) -> Study:
    spark = clean.sparkSession
    people, items, params = _numeric(clean, items)
    tables = {}
    if k is None:
        diagnostics = panel.diagnostics(people.select("id", "f"))
        tables["k_selection_diagnostics"] = diagnostics
        k = int(validity.recommend_k(validity.signals(diagnostics)).first()["k"])
    (found,) = batch.solutions(batch.prepared(people), k, [None], resamples=resamples)
    order = sorted(range(k), key=lambda j: found.fit.centres[j].tolist())
    centres = [[float(v) for v in found.fit.centres[j]] for j in order]
    centre_table = spark.createDataFrame(pa.table({"segment": range(k), "f": centres}))
    fits = segments.shadow_fit(people, centre_table, "raw") if k > 1 else people.select("id", F.lit(0).alias("closest"), F.lit(1.0).alias("fit"), "raw")
    held = fits.select("id", F.col("closest").alias("segment"), "fit", "raw").persist()
    own = held.select("id", "segment", "fit")
    answer = F.explode(F.arrays_zip(F.array(*(F.lit(c) for c in items)).alias("item"), F.col("raw").alias("x")))
    labelled = held.select("segment", answer.alias("a")).select("segment", "a.item", "a.x")
    tables |= {
        "segment_centroids": labelled.groupBy("segment", "item").agg(F.avg("x").alias("mean")),
        "segment_stability_jaccard": spark.createDataFrame([(i, float(found.jaccard[j])) for i, j in enumerate(order)], "segment int, jaccard double"),
        "variable_importance": profiling.eta_squared(labelled),
        "segment_sizes": segments.sizes(own),
    }
    typed = typing.cv_typing(held.select("id", "segment", F.col("raw").alias("f"))).first()
    manifest = {"split_half_ARI": found.split_half, "typing_cv_accuracy": typed["accuracy"], "per_segment_jaccard": {f"Segment {i}": float(found.jaccard[j]) for i, j in enumerate(order)}}
    return Study(own, typing.centroid_rule(items, "range", params, centres), manifest | {"k": k, "items": items}, tables)


def _segment_mixed(clean: DataFrame, numbers: list[str], picks: list[str], k: int | None) -> Study:
    kinds = {c: gower.ORDINAL for c in numbers} | {c: gower.NOMINAL for c in picks}
    table = clean.select("id", *(F.col(f"`{c}`").cast("double").alias(c) for c in numbers), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("MISSING")).alias(c) for c in picks))
    levels = table.agg(*(F.countDistinct(f"`{c}`").alias(c) for c in kinds)).first()
    kinds = {c: kind for c, kind in kinds.items() if levels[c] > 1}
    _two(list(kinds))
    spec = gower.fit_spec(table, kinds)
    encoded = gower.encode(table.select("id", *kinds), spec).persist()
    tables = {}
    if k is None:  # votes on the embedding, whose distances are Gower's
        points = encoded.select("id", gower.embedding(spec, {c: F.col(c) for c in kinds}).alias("f"))
        diagnostics = panel.diagnostics(points)
        tables["k_selection_diagnostics"] = diagnostics
        k = int(validity.recommend_k(validity.signals(diagnostics)).first()["k"])
    found = kproto.fit(encoded, spec, k)
    rows = sorted(found.rows, key=lambda p: [str(p[c]) for c in kinds])
    own = kproto.assign(encoded, spec, rows)
    rule = typing.gower_rule(spec, rows)
    scored = typing.score(rule, table).select("id", "segment", F.col("confidence").alias("fit")).persist()
    labelled = own.select("segment", *(F.col(f"`{c}`").cast("string").alias(c) for c in kinds))
    tables |= {"segment_prototypes": gower.update_prototypes(own, spec), "segment_sizes": segments.sizes(scored), "segment_levels": labelled.unpivot("segment", list(kinds), "item", "level").groupBy("segment", "item", "level").count()}
    return Study(scored, rule, {"k": k, "items": list(kinds), "total_distance": found.cost}, tables)


def _segment_categorical(clean: DataFrame, items: list[str], k: int | None, resamples: int) -> Study:
    text = clean.select("id", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("MISSING")).alias(c) for c in items))
    levels = text.agg(*(F.countDistinct(f"`{c}`").alias(c) for c in items)).first()
    items = _two([c for c in items if levels[c] > 1])
    answers = text.unpivot("id", items, "item", "level").persist()
    tables = {}
    if k is None:
        chosen = latent_batch.select(answers, resamples=resamples)
        tables["lca_selection_diagnostics"] = chosen
        k = int(validity.recommend_k_lca(chosen).first()["k"])
    coded = latent_batch.coded(answers, [batch.EVERYBODY])
    m = max(latent_batch.fit(coded, [batch.Job(k, s) for s in range(20)]), key=lambda m: m.loglik)
    post = latent_batch.posteriors(coded, m, answers)
    own = post.groupBy("id").agg(F.max_by("class", F.struct("p", -F.col("class"))).cast("bigint").alias("segment"), F.max("p").alias("fit")).persist()
    spark = clean.sparkSession
    profile = spark.createDataFrame([(i, lv, c, float(m.theta[n, c])) for n, (i, lv) in enumerate(coded.levels) for c in range(k)], "item string, level string, class int, probability double")
    tables |= {"latent_class_profiles": profile, "segment_sizes": segments.sizes(own)}
    rule = typing.lca_rule(text.join(own.select("id", "segment"), "id"), items)
    return Study(own, rule, {"k": k, "items": items, "loglik": m.loglik}, tables)


def run(df: DataFrame, id_column: str | None = None, items: list[str] | None = None, k: int | None = None, resamples: int = 100) -> Study:
    """A study of a table of answers, one row a person, which is read several times: one that is dear to make is best persisted.

    items: exactly these, instead of what auto_prepare takes.  Raises ValueError("_TWO_ITEMS_NEEDED") where fewer than two items tell people apart.
    """
    clean, method, chosen, plan = ingest.auto_prepare(df, id_column, items)
    people = _with_id(clean, plan)
    kinds = dict(people.dtypes)
    numbers = [c for c in chosen if kinds[c] != "string"]
    if method == "kmeans":
        study = _segment_numeric(people, chosen, k, resamples)
    elif method == "kproto":
        study = _segment_mixed(people, numbers, [c for c in chosen if c not in numbers], k)
    else:
        study = _segment_categorical(people, chosen, k, min(resamples, 15))
    n = study.assignments.count()
    study.manifest = {"timestamp_utc": datetime.now(UTC).isoformat(timespec="seconds"), "method": method, "n_respondents": n, "n_items": len(study.manifest["items"]), "notes": plan.notes, "library_versions": {"python": platform.python_version(), "spark": df.sparkSession.version}} | study.manifest
    return study


def html_report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A page of small tables, ``most`` rows of each."""
    cell = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))
    out = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>']
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out) + "</body></html>"


def save(study: Study, out: str) -> None:
    """Writes the assignments and each table as CSV folders, the rule and the manifest as JSON, and the report as Markdown and HTML."""
    spark = study.assignments.sparkSession
    latent = study.manifest["method"] == "lca"
    ingest.write_table(study.assignments, f"{out}/segment_assignments.csv")
    for name, table in study.tables.items():
        ingest.write_table(table, f"{out}/{name}.csv")
    ingest.write_text(spark, typing.to_json(study.rule), f"{out}/{'latent_class_typing_rule' if latent else 'typing_rule'}.json")
    ingest.write_text(spark, json.dumps(study.manifest, indent=2, ensure_ascii=False), f"{out}/run_manifest.json")
    ingest.write_text(spark, ingest.report("Segmentation report", study.tables), f"{out}/segmentation_report.md")
    ingest.write_text(spark, html_report("Segmentation report", study.tables), f"{out}/segmentation_report.html")


def run_file(spark: SparkSession, path: str, out: str, **settings) -> Study:
    """run() over an export, and save()."""
    study = run(ingest.read_table(spark, path), **settings)
    save(study, out)
    return study


def score_file(spark: SparkSession, rule_path: str, path: str, out: str) -> DataFrame:
    """New people of an export, scored by a saved rule and written with their ids as new_assignments.csv."""
    rule = typing.from_json(ingest.head_bytes(spark, rule_path, 1 << 26).decode())
    df = ingest.read_table(spark, path)
    name = ingest.pick_id_column(df, rule["items"])
    scored = typing.score(rule, df)
    told = [c for c in ("segment", "confidence", "off_scale") if c in scored.columns]
    kept = scored.select(*([F.col(f"`{name}`")] if name else []), *told)
    ingest.write_table(kept, f"{out}/new_assignments.csv")
    return kept


def choice_tables(choices: DataFrame, size: int = 3, steps: int | None = None, burn: int | None = None, splits: int = 40) -> dict[str, DataFrame]:
    """What a best-worst study comes to, by file name, from (respondent_id, set, item, choice).

    item_utilities: the ranking with how sure each place is, counts beside it and the chains' R-hat.  respondent_utilities: a row a respondent, a column an
    item, from 0 to 100.  what_to_launch: the set of ``size`` items of widest reach, where there are people and items enough to say something.
    """
    spark = choices.sparkSession
    draws, people = (x.persist() for x in choice.hb_utilities(choices, steps, burn))
    items = sorted(r["item"] for r in people.select("item").distinct().collect())
    stack = draws.select((F.col("draw") * F.lit(1000) + F.col("chain")).alias("draw"), "item", "value")  # chains are few
    sure = draws.agg(F.max("rhat").alias("rhat"))
    ranked = choice.ranking(stack).join(choice.counts(choice.valid_sets(choices)), "item").crossJoin(sure).orderBy("rank")
    wide = choice.rescaled(people).groupBy("respondent_id").pivot("item", items).agg(F.first("score"))
    out = {"item_utilities": ranked, "respondent_utilities": wide}
    everyone = people.select(F.col("respondent_id").alias("id"), "item", F.col("u").alias("x"))
    hits = reach.top_items(everyone, 3)
    if reach.worth_telling(everyone, size).first()["told"]:
        best = reach.turf(hits, items, size, splits).first()
        rows = [(n, x, a, g, best["reach"], best["holdout_reach"]) for n, (x, a, g) in enumerate(zip(best["items"], best["alone"], best["gains"], strict=True), 1)]
        out["what_to_launch"] = spark.createDataFrame(rows, "rank int, item string, reach_alone double, incremental_reach double, combined_reach double, expected_reach_holdout double")
    return out


def save_choices(choices: DataFrame, out: str, **settings) -> dict[str, DataFrame]:
    """choice_tables(), each written as a CSV folder."""
    tables = choice_tables(choices, **settings)
    for name, table in tables.items():
        ingest.write_table(table, f"{out}/{name}.csv")
    return tables
