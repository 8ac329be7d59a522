"""Score respondents as they arrive: the batch rule on a stream, stateless, so any trigger and restart give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import typing


def score_stream(spark: SparkSession, rule: dict, source: str, schema: str, kind: str = "parquet", files_a_trigger: int = 64) -> DataFrame:
    """A streaming DataFrame of the files that appear under ``source``, scored."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).format(kind).load(source)
    return typing.score(rule, new)


def run(scored: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now, exactly once, and ends."""
    return scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
