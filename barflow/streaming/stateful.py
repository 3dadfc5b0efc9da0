"""Stateful stream rules. State per key is a few numbers; each micro-batch is sorted by event time.

A row older than what its key has already seen comes too late: the rule has decided past it, so it is dropped
and changes nothing. With ``idle`` the state of a key goes once the watermark has passed its last row by that
long; the frame must then carry a watermark on ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from barflow.operators import folds
from barflow.operators.ticks import event_key


def _stateful(df: DataFrame, keys: list[str], ts: str, state_schema: str, decide: Callable, extra: str = "", idle: str | None = None) -> DataFrame:
    """Run decide(rows, times, state) -> (flags, state, values) over the new rows of each key in time order.

    The first number of the state is the time last seen. ``extra`` declares columns that ``values`` fills. Rows
    of a key within a batch are held together, as the state interface hands them over;
    ``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger`` bounds it.
    """
    out_schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + (f", {extra}" if extra else "")
    names = [p.split()[0] for p in extra.split(",")] if extra else []
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        current = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        us = rows[ts].to_numpy("datetime64[us]").astype(np.int64)
        if current is not None:
            rows, us = rows[us >= current[0]], us[us >= current[0]]
        if not len(rows):
            return
        flags, (*rest,), values = decide(rows, us, None if current is None else current[1:])
        state.update((int(us[-1]), *rest))
        if idle:
            state.setTimeoutTimestamp(max(int(us[-1]) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(**dict(zip(names, values)))[flags]

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, out_schema, f"seen_us bigint, {state_schema}", "append", timeout)


def throttle(ticks: DataFrame, min_gap_us: int, change: float, force_us: int, keys=("symbol",), idle: str | None = None) -> DataFrame:
    def decide(rows, us, state):
        price = rows["price"].to_numpy(float)
        before_us = np.r_[us[0] if state is None else state[0], us[:-1]]
        before = np.r_[np.nan if state is None else state[1], price[:-1]]
        with np.errstate(divide="ignore", invalid="ignore"):
            moved = (before != 0) & (np.abs((price - before) / before) >= change)
        gap = us - before_us
        flags = (gap >= min_gap_us) & (moved | (gap >= force_us))
        if state is None:
            flags[0] = True
        return flags, (int(us[-1]), float(price[-1])), ()

    return _stateful(ticks, list(keys), "ts", "last_us bigint, last_price double", decide, idle=idle)


def fluctuations(ticks: DataFrame, threshold_pct: float, keys=("symbol",), idle: str | None = None) -> DataFrame:
    def decide(rows, us, state):
        price = rows["price"].to_numpy(float)
        used, base = folds.followed(price, None if state is None else state[0], threshold_pct / 100.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            flags = (used != 0) & (np.abs((price - used) / used) >= threshold_pct / 100.0)
        return flags, (base,), (used,)

    return _stateful(ticks, list(keys), "ts", "baseline double", decide, "baseline double", idle)


def debounce(signals: DataFrame, seconds: int, keys=("symbol", "side"), idle: str | None = None) -> DataFrame:
    def decide(rows, us, state):
        flags, last = folds.spaced(us, None if state is None else state[0], seconds * 1_000_000)
        return flags, (last,), ()

    return _stateful(signals, list(keys), "ts", "last_us bigint", decide, idle=idle)


def deduplicate_spaced(events: DataFrame, seconds: int, keys=("event_id",), idle: str | None = None) -> DataFrame:
    """The batch rule: a key passes again once the time to live of its last passed event is over."""
    return debounce(events, seconds, keys, idle)


def deduplicate_events(events: DataFrame, ids=("event_id", "correlation_id"), seconds: int = 300, expires: bool = True) -> DataFrame:
    """The batch rule on the first id of an event that is there. With ``expires`` a key's state goes when its time to
    live has passed by the watermark, which ``ts`` must carry; an event without an id passes and has no state."""
    keyed = events.withColumn("_key", event_key(*ids))
    rest = keyed.filter(F.col("_key").isNull())
    passed = debounce(keyed.filter(F.col("_key").isNotNull()), seconds, ("_key",), f"{seconds} seconds" if expires else None)
    return passed.unionByName(rest).drop("_key")


def hourly_cap(signals: DataFrame, n: int, keys=("symbol",), breakout: str | None = None, floor: float = 0.0, idle: str | None = None) -> DataFrame:
    """At most n accepted per rolling hour; a BUY needs the breakout score where one is known."""
    if breakout and floor > 0:
        weak = F.col("side").isin("BUY", "STRONG_BUY") & (F.col(breakout) < floor)
        signals = signals.filter(~F.coalesce(weak, F.lit(False)))

    def decide(rows, us, state):
        flags, taken = folds.capped(us, list(state[0]) if state else [], n, 3_600_000_000)
        return flags, (taken,), ()

    return _stateful(signals, list(keys), "ts", "taken array<bigint>", decide, idle=idle)


def deduplicate(events: DataFrame, key: str = "event_id", ts: str = "ts", ttl: str = "5 minutes") -> DataFrame:
    """Drop repeats of a key inside the time to live; Spark's own operator, state expires by watermark."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
