"""Service metrics over an event table or stream (an extension; the same functions serve both)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def error_rate(events: DataFrame, minutes: int = 5, step: str = "15 seconds", watermark: str | None = None) -> DataFrame:
    """(start, errors, total, rate): errors a second over sliding windows."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    w = F.window("ts", f"{minutes} minutes", step)
    bad = F.count_if(F.col("event_type") == "error")
    return rows.groupBy(w).agg(bad.alias("errors"), F.count("*").alias("total"), (bad / (60 * minutes)).alias("rate")).select(F.col("window.start").alias("start"), "errors", "total", "rate")


def p95(events: DataFrame, minutes: int = 5, watermark: str | None = None) -> DataFrame:
    """(start, p95) of value over tumbling windows; approximate on a stream, exact in a batch."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    q = F.percentile_approx("value", 0.95, 10000) if events.isStreaming else F.percentile("value", F.lit(0.95))
    return rows.groupBy(F.window("ts", f"{minutes} minutes")).agg(q.alias("p95")).select(F.col("window.start").alias("start"), "p95")


def counters(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """(start, event_type, n) by the hour."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def held(windows: DataFrame, value: str, above: float, times: int, step: float, by: list[str] | None = None) -> DataFrame:
    """(by..., from, to, windows): runs of at least `times` neighbouring windows above a threshold.

    Neighbours start `step` seconds apart. Runs are found for each of `by`; a label's windows over the
    threshold meet in one task, of the others none.
    """
    over = windows.where(F.col(value) > above)
    own = Window.partitionBy(*by or [F.lit(0)]).orderBy("start")
    place = F.round(F.unix_micros(F.col("start").cast("timestamp")) / (step * 1_000_000)).cast("long")
    runs = over.withColumn("run", place - F.row_number().over(own))
    return runs.groupBy(*by or [], "run").agg(F.min("start").alias("from"), F.max("start").alias("to"), F.count("*").alias("windows")).where(F.col("windows") >= times).drop("run")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files as a stream; event time is a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
