"""Feature names, aliases and lookup of one named feature."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names used by older models and the canonical name each stands for.
FEATURE_ALIASES = {
    "macd_hist": "macd_histogram",
    "bb_pct": "bb_position",
    "vol_ratio": "volume_ratio",
    "volatility": "volatility_20",
}


def resolve(name: str) -> str:
    """Canonical name of a feature; a ``_15m`` suffix is dropped. Unknown names are an error."""
    from barflow.operators.indicators import CANONICAL, CLOSE_EMAS

    known = {*CANONICAL, *[e.name for e in CLOSE_EMAS], "plus_di", "minus_di", "di_diff"}
    base = name[:-4] if name.endswith("_15m") and name[:-4] else name
    out = FEATURE_ALIASES.get(base, base)
    if out not in known:
        raise ValueError(f"unknown feature {name!r}")
    return out


def feature(bars: DataFrame, name: str, minutes: int) -> DataFrame:
    """One named feature of every bar; unused features are pruned from the plan."""
    from barflow.operators.indicators import canonical

    return canonical(bars, minutes).select("symbol", "timeframe", "bar_ts", resolve(name))
