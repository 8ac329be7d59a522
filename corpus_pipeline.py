"""The training-corpus pipeline: documents in, shards of shuffled token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import linear, mixing, quality, token_shards
from cohortlens.llm.common import Workspace
from cohortlens.llm.decontaminate import uncontaminated
from cohortlens.llm.near_dup import near_duplicates


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.3 or more, by a model of the labels of sf_dir; rows without an id or text are scored too."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return linear.above(docs, model.weights, model.offset, linear.word_and_shape, 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates; documents without an id all stay.  Rows that repeat in all
    columns count once; a doc_id with several texts keeps them all."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("_row", F.xxhash64(*docs.columns)).dropDuplicates(["doc_id", "_row"])
    return rows.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in passages of the benchmark."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that it takes several times has as many rows, one that it does not take has none."""
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text", "source"))
    times = mixing.mix(docs.select(key.alias("doc_id"), "text", "source")).filter("taken > 0").select(F.col("doc_id").alias("_key"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    times = times.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_times"))))
    rows = docs.withColumn("_key", key).withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("n_chars", "source")))
    return rows.join(times, ["_key", "_nth"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token sequences in training order, written, and a digest of each sequence."""
    return token_shards.written_digests(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("tokens", token_output)]
#: No SQL expresses the model, the tokenizer or the permutation; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before wrote."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
