"""Resumable ingest: what has arrived since the last run is processed once, from the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def resume(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, schema=None) -> StreamingQuery:
    """Starts a run over all Parquet files of source that no earlier run with this checkpoint has taken, and ends."""
    schema = schema or spark.read.parquet(source).schema
    rows = transform(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
