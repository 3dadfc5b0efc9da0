"""Window aggregations that run on a batch or a stream alike; streams add the watermark first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.columns import moment
from barflow.operators.bars import _NAMES


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def closed_bars(ticks: DataFrame, seconds: int, delay: str = "1 minute") -> DataFrame:
    """Tumbling bars; in append mode each is emitted once, when the watermark passes its end."""
    w = F.window("ts", f"{seconds} seconds")
    at = moment("ts", "event_id")
    return watermarked(ticks, "ts", delay).groupBy("symbol", w).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")).select("symbol", F.lit(_NAMES[seconds]).alias("timeframe"), F.col("window.start").alias("bar_ts"),
                                                                             "open", "high", "low", "close", "volume", "n")


def _change(d: DataFrame) -> DataFrame:
    return d.select("symbol", "at", "open", "high", "low", "close", "volume", (F.try_divide(F.col("close") - F.col("open"), "open") * 100).alias("change_pct"))


def stats_24h(ticks: DataFrame, minutes: int = 1440, delay: str = "1 minute") -> DataFrame:
    """Open, high, low, close and change per symbol over the last 24 hours, at the end of every minute that has a tick.

    Ticks become one-minute rows first; a batch frames those by time, in pieces of ``minutes`` that also get the
    piece before. A stream has no frames and slides a window over the closed one-minute rows instead.
    """
    at = moment("ts", "event_id")
    m = watermarked(ticks, "ts", delay).groupBy("symbol", F.window("ts", "1 minute")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    if ticks.isStreaming:
        d = m.groupBy("symbol", F.window(F.window_time("window"), f"{minutes} minutes", "1 minute").alias("span")).agg(
            F.min_by("open", "window.start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "window.start").alias("close"), F.sum("volume").alias("volume"))
        return _change(d.withColumn("at", F.col("span.end")))
    m = m.withColumn("at", F.col("window.end")).withColumn("minute", F.floor(F.unix_seconds(F.col("window.start").cast("timestamp")) / 60))
    part = F.floor(F.col("minute") / minutes)
    d = m.withColumn("part", F.explode(F.array(part, part + 1)))
    w = Window.partitionBy("symbol", "part").orderBy("minute").rangeBetween(1 - minutes, 0)
    d = d.withColumns({"open": F.first("open").over(w), "high": F.max("high").over(w), "low": F.min("low").over(w), "volume": F.sum("volume").over(w)})
    return _change(d.filter(F.col("part") == part))


def error_rate(errors: DataFrame, ts: str = "timestamp", delay: str = "1 minute") -> DataFrame:
    """Errors of the last five minutes per minute; a batch counts by minute before it slides."""
    if errors.isStreaming:
        d = watermarked(errors, ts, delay).groupBy(F.window(ts, "5 minutes", "1 minute")).agg(F.count(F.lit(1)).alias("errors"))
    else:
        m = errors.groupBy(F.window(ts, "1 minute").alias("m")).agg(F.count(F.lit(1)).alias("n"))
        d = m.groupBy(F.window("m.start", "5 minutes", "1 minute")).agg(F.sum("n").alias("errors"))
    return d.select(F.col("window.end").alias("at"), "errors", (F.col("errors") / 5.0).alias("per_minute"))


def throughput(messages: DataFrame, ts: str = "ts", seconds: int = 10, delay: str = "1 minute") -> DataFrame:
    """Messages of a window over the span between its first and last message."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = watermarked(messages, ts, delay).groupBy(F.window(ts, f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("messages"), (F.max(us) - F.min(us)).alias("_span"))
    return d.select(F.col("window.start").alias("at"), "messages", F.coalesce(F.try_divide("messages", F.col("_span") / 1e6), F.lit(0.0)).alias("per_second"))
