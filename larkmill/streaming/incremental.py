"""The engine's aggregates and joins over unbounded input, for rows that arrive as files.

The batch operators take streaming DataFrames as they are; what a stream needs besides is a
watermark, so that state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(stream: DataFrame, time: str, keys: list[str], values: dict[str, Column], *, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Grouped aggregates by window of event time; rows later than ``late`` are dropped with their windows' state."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*(v.alias(n) for n, v in values.items()))


def enriched(stream: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Each arriving row joined with a table; ``how``: inner or left_semi."""
    return stream.join(dimension, on, how)


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, exactly once for each checkpoint, and stop."""
    result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
