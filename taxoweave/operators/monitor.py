"""Metrics as rows: rolling and session figures, alerts, recommendations, benchmark summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the alerts.
THRESHOLDS = {"cpu_usage": 80.0, "memory_usage": 85.0, "api_response_time": 30.0, "error_rate": 5.0}


def rolling(metrics: DataFrame, last: int = 60, by: str = "name", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Mean, least and greatest of the last values of each metric, this one included."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(last - 1), 0)
    return metrics.withColumns({"avg": F.avg("value").over(w), "low": F.min("value").over(w), "high": F.max("value").over(w), "count": F.count("value").over(w)})


def latest(metrics: DataFrame, n: int, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    return metrics.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def alerts(metrics: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """Rows over the threshold of their name (lower case, spaces as underscores), with a message."""
    key = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), key)
    return metrics.withColumn("threshold", limit).where(F.col("value") > F.col("threshold")).withColumn("message", F.concat(F.lit("Metric '"), "name", F.lit("' exceeded threshold: "), F.col("value").cast("string"), F.lit(" > "), F.col("threshold").cast("string")))


def session(rows: DataFrame, by: str, **counts: Column) -> DataFrame:
    """Per session: sums of what is given, and the rates of matches, cache hits and speed."""
    out = rows.groupBy(by).agg(*[F.sum(c).alias(k) for k, c in counts.items()])
    return out.withColumns(
        {
            "match_rate": F.col("matched") / F.greatest("processed", F.lit(1)) * 100,
            "cache_hit_rate": F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)) * 100,
            "processing_speed": F.try_divide(F.col("processed"), F.col("seconds")),
        }
    )


def history(sessions: DataFrame, n: int = 10, order: str = "session") -> DataFrame:
    """Sums and averages of the last n sessions."""
    last = sessions.orderBy(F.col(order).desc()).limit(n)
    return last.agg(
        F.count("*").alias("sessions"), F.sum("processed").alias("processed"), F.sum("matched").alias("matched"), F.sum("seconds").alias("seconds"),
        (F.sum("matched") / F.greatest(F.lit(1), F.sum("processed")) * 100).alias("match_rate"), (F.sum("processed") / F.greatest(F.lit(1.0), F.sum("seconds"))).alias("processing_speed"), F.avg("processed").alias("per_session"),
    )


def export(metrics: DataFrame, sessions: DataFrame, exported_at: str, n: int = 100, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row: the last n metrics in order of time, the last session, and the sums of the last ten."""
    last = latest(metrics, n, order)
    recent = last.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*metrics.columns).alias("m")))), lambda x: x["m"]).alias("recent_metrics"))  # n rows
    current = sessions.orderBy(F.col("session").desc()).limit(1).select(F.struct("*").alias("current_session"))
    past = history(sessions).select(F.struct("*").alias("historical_stats"))
    return recent.join(current, how="left").crossJoin(past).withColumn("export_time", F.lit(exported_at))


def benchmark(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, least, greatest and sample deviation (0 for one run)."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))


def recommendations(speed: Column, hit_rate: Column, api_seconds: Column, memory_pct: Column) -> Column:
    rules = [(speed < 1.0, "raise the batch size or the parallelism"), (hit_rate < 30, "keep the cache or lengthen its time to live"), (api_seconds > 10.0, "lower the batch size or retry"), (memory_pct > 80, "lower the cache size or the chunks")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def automatic_recommendations(auto_rate: Column, per_call: Column, speed: Column) -> Column:
    rules = [(auto_rate < 50, "extend the synonyms"), (per_call < 5, "raise the batch size"), (speed < 10, "give it more cores")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
