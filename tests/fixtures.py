"""Small series built in code: random walks, constant and single-row series, ties and gaps."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)


def walk(n: int, symbol: str, seed: int = 42, step_minutes: int = 5) -> pd.DataFrame:
    g = np.random.default_rng(seed)
    close = 50_000 * (1 + 0.002 * np.cumsum(g.standard_normal(n)))
    wide = np.abs(0.005 * g.standard_normal(n))
    return pd.DataFrame({
        "symbol": symbol, "timeframe": "5m", "bar_ts": [START + dt.timedelta(minutes=step_minutes * i) for i in range(n)],
        "open": np.r_[close[0], close[:-1]], "high": close * (1 + wide), "low": close * (1 - wide), "close": close,
        "volume": g.integers(100, 1000, n).astype(float)})


def series(n: int = 300) -> pd.DataFrame:
    """Two walks, a constant series, and a series of one row."""
    flat = walk(60, "FLAT").assign(open=10.0, high=10.0, low=10.0, close=10.0, volume=0.0)
    return pd.concat([walk(n, "A"), walk(n // 2, "B", 7), flat, walk(1, "ONE")], ignore_index=True)


SCHEMA = ("symbol string, timeframe string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")


def frame(spark, pdf: pd.DataFrame, schema: str = SCHEMA):
    return spark.createDataFrame(pdf, schema)
