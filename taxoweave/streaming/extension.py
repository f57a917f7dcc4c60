"""Inputs and metrics as streams. The alignment itself is a batch job; this is an addition to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_stream(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """Streamed inputs (ord, name) with the reference of their name, if it has one: a stream-static join."""
    names = refs.groupBy(F.lower("name").alias("k")).agg(F.min_by("id", "ord").alias("match_id"))
    return inputs.join(names, F.lower("name") == F.col("k"), "left").select(*inputs.columns, "match_id")


def first_within(inputs: DataFrame, key: str = "id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten when they can't come again within ``delay``."""
    return inputs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def metric_windows(metrics: DataFrame, window: str = "60 seconds", delay: str = "2 minutes") -> DataFrame:
    """Mean, least and greatest of each metric by tumbling window."""
    w = F.window("ts", window)
    return metrics.withWatermark("ts", delay).groupBy(w, "name").agg(F.avg("value").alias("avg"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
