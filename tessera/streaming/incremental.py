"""A table that grows by files, read as a stream, and its aggregates kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregates


def scan_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 16) -> DataFrame:
    """The Parquet files that appear under path, with the schema of like."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_aggregate(stream: DataFrame, groups: Sequence[str], reductions: Sequence[aggregates.Reduction], name: str, checkpoint: str) -> StreamingQuery:
    """Runs an aggregate over all that has arrived, into an in-memory table, and stops when no file is left."""
    out = aggregates.aggregate(stream, groups, reductions).writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
