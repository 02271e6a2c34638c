"""Request telemetry: daily running counts in batch and as a stream, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.scratch import small


def running_daily(events: DataFrame, seconds: int = 60) -> DataFrame:
    """day, event_id, requests_today: the count starts anew each day and includes the row itself.

    In two levels, so that a day is no single task: counts of spans of `seconds`, then numbers inside a span.
    """
    span = F.floor(F.unix_timestamp("ts") / seconds)
    rows = events.withColumn("day", F.to_date("ts")).withColumn("span", span)
    counts = rows.groupBy("day", "span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a day has 86,400 / seconds spans
    inside = F.row_number().over(Window.partitionBy("day", "span").orderBy("ts", "event_id"))
    starts = counts.select("day", "span", before.alias("before"))
    return rows.withColumn("nth", inside).join(small(starts), ["day", "span"]).withColumn("requests_today", F.col("before") + F.col("nth")).drop("span", "nth", "before")


def daily_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The streaming form: tumbling windows of a day with a watermark for late events."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def new_keys(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Resume as a stream: keys seen within the watermark are dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float, fee: float = 0.0) -> Column:
    return F.round(tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out + fee, 8)


def log_line(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("line"))
