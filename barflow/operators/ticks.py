"""Batch forms of the tick rules; the streaming package holds their stateful twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions import futures as X
from barflow.functions.columns import col, micros, moment
from barflow.operators import folds
from barflow.operators.series import TICK_CHUNK, framed, index_series

ORDER = ("ts", "event_id")


def throttle(ticks: DataFrame, min_gap_us: int, change: float, force_us: int, keys=("symbol",)) -> DataFrame:
    """Ticks worth showing: first always; none within the gap of the last received one; then a change or a long silence."""
    idx = index_series(ticks, keys, ORDER, balanced=True)

    def build(d, r):
        us = micros("ts")
        d = d.withColumns({"_du": us - r.lag(us), "_dp": F.abs(F.try_divide(F.col("price") - r.lag("price"), r.lag("price")))})
        emit = F.col("_du").isNull() | ((F.col("_du") >= min_gap_us) & (F.coalesce(F.col("_dp") >= change, F.lit(False)) | (F.col("_du") >= force_us)))
        return d.withColumn("emit", emit)

    return framed(idx, build, before=1, keys=keys).filter("emit").drop("_du", "_dp", "emit", "bar_idx")


def fluctuations(ticks: DataFrame, threshold_pct: float, keys=("symbol",)) -> DataFrame:
    """Events where the price departs from the moving baseline by the threshold."""
    d = folds.moving_baseline(index_series(ticks, keys, ORDER, balanced=True), list(keys), "price", threshold_pct / 100.0, chunk=TICK_CHUNK)
    change = F.abs(F.try_divide(F.col("price") - F.col("baseline"), "baseline")) * 100
    return d.withColumn("change_pct", change).filter(F.abs(F.try_divide(F.col("price") - F.col("baseline"), "baseline")) >= threshold_pct / 100.0).drop("bar_idx")


def debounce(signals: DataFrame, seconds: int, keys=("symbol", "side"), order=ORDER) -> DataFrame:
    return folds.greedy_spacing(signals, list(keys), seconds * 1_000_000, order).filter("accepted").drop("accepted")


def deduplicate(events: DataFrame, seconds: int, key: Column, order=ORDER) -> DataFrame:
    """First event of a key; later ones pass once the time to live of the last passed one is over."""
    d = folds.greedy_spacing(events.withColumn("_key", key), ["_key"], seconds * 1_000_000, order)
    return d.filter("accepted").drop("accepted", "_key")


def event_key(*ids: str) -> Column:
    """The first id that is there; an empty one counts as none. NULL where an event has no id at all."""
    return F.coalesce(*[F.when(F.col(i) != "", F.col(i)) for i in ids])


def deduplicate_events(events: DataFrame, ids=("event_id", "correlation_id"), seconds: int = 300, order=("ts",)) -> DataFrame:
    """Suppress repeats of an event's key while its time to live runs; an event without any id always passes."""
    keyed = events.withColumn("_key", event_key(*ids))
    rest = keyed.filter(F.col("_key").isNull()).drop("_key")
    return deduplicate(keyed.filter(F.col("_key").isNotNull()).drop("_key"), seconds, event_key(*ids), order).unionByName(rest)


def hourly_cap(signals: DataFrame, n: int, keys=("symbol",), order=ORDER, breakout: str | None = None, floor: float = 0.0) -> DataFrame:
    """At most n accepted per rolling hour; a BUY needs the breakout score where one is known."""
    if breakout and floor > 0:
        weak = F.col("side").isin("BUY", "STRONG_BUY") & (F.col(breakout) < floor)
        signals = signals.filter(~F.coalesce(weak, F.lit(False)))
    return folds.rolling_cap(signals, list(keys), n, 3_600_000_000, order).filter("accepted").drop("accepted")


def latest(ticks: DataFrame, keys=("symbol",), order=ORDER) -> DataFrame:
    rest = [c for c in ticks.columns if c not in keys]
    return ticks.groupBy(*keys).agg(*[F.max_by(c, moment(*order)).alias(c) for c in rest])


def split_stale(signals: DataFrame, seconds: float, event: str, received: str) -> tuple[DataFrame, DataFrame]:
    """Rows young enough to act on, and the rejected ones with their age."""
    d = signals.withColumn("age_seconds", (micros(received) - micros(event)) / F.lit(1e6))
    return d.filter(F.col("age_seconds") <= seconds), d.filter(F.col("age_seconds") > seconds)


def mark_positions(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """Open positions at the newest price of their symbol: ticks reduce to one row per symbol first."""
    price = latest(ticks).select("symbol", F.col("ts").alias("marked_at"), "price")
    d = positions.filter(F.col("status") == "OPEN").join(price, "symbol")
    return d.withColumn("unrealized", X.gross_pnl("entry_price", "price", "quantity", "side"))
