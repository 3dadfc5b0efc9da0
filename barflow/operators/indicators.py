"""Technical indicators as window expressions.

Frame-only indicators are functions of a ``Roll`` that return columns by name; they run inside
``framed`` after ``base`` has added the previous values and true ranges. Recursive ones (EMA, Wilder)
are columns added by ``scan`` beforehand. NULL is kept everywhere; filling is the last step of a set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.functions.columns import EPS, clip, col, div, flag
from barflow.functions.names import b
from barflow.operators.series import (KEYS, Linear, Roll, cascade, ema, ema_adjusted, framed, index_series, running,
                                      scan, streak, total, wilder)

def base(d: DataFrame, r: Roll) -> DataFrame:
    """Previous values, change, return, and the three true ranges in use.

    ``_tr`` is NULL on the first row, ``_tr0`` starts with the bar range, ``_trl`` compares lows with
    the previous low instead of the previous close.
    """
    d = d.withColumns({"_pc": r.lag("close"), "_ph": r.lag("high"), "_pl": r.lag("low")})
    pc, ph, pl = F.col("_pc"), F.col("_ph"), F.col("_pl")
    up, down = b.H - ph, pl - b.L
    tr0 = F.greatest(b.H - b.L, F.abs(b.H - pc), F.abs(b.L - pc))
    return d.withColumns({
        "_d": b.C - pc, "_ret": div(b.C, pc) - 1, "_tr0": tr0, "_tr": F.when(pc.isNotNull(), tr0),
        "_trl0": F.greatest(b.H - b.L, F.abs(b.H - pc), F.abs(pl - b.L)),
        "_trl": F.when(pc.isNotNull(), F.greatest(b.H - b.L, F.abs(b.H - pc), F.abs(pl - b.L))),
        "_gain": F.greatest(F.coalesce(b.C - pc, F.lit(0.0)), F.lit(0.0)),
        "_loss": F.greatest(F.coalesce(pc - b.C, F.lit(0.0)), F.lit(0.0)),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })


def with_base(bars: DataFrame, keys=KEYS) -> DataFrame:
    return framed(bars, base, before=1, keys=keys)


# price and momentum -----------------------------------------------------------------------------


def sma(r: Roll, periods=(10, 20, 50, 100, 200)):
    return {f"sma_{n}": r.mean(b.C, n, 1) for n in periods}


def sma_ratio(r: Roll, periods=(20, 50, 200)):
    return {f"close_sma_{n}_ratio": div(b.C, r.mean(b.C, n, 1)) for n in periods}


def price_ratios():
    top, bottom = F.greatest(b.C, b.O), F.least(b.C, b.O)
    return {"high_low_spread": div(b.H - b.L, b.L), "close_open_ratio": div(b.C, b.O), "body_size": div(F.abs(b.C - b.O), b.O),
            "upper_shadow": div(b.H - top, top), "lower_shadow": div(bottom - b.L, bottom)}


def rsi_sma(r: Roll, periods=(14, 7)):
    """Plain-average RSI; no losses in the window gives NULL."""
    return {f"rsi_{n}": 100 - div(100.0, 1 + div(r.mean("_gain", n, 1), r.mean("_loss", n, 1))) for n in periods}


def rsi_recursive(gain: str, loss: str) -> Column:
    return 100 - 100 / (1 + F.col(gain) / (F.col(loss) + EPS))


def stochastic(r: Roll, n=14, m=1):
    hh, ll = r.max(b.H, n, m), r.min(b.L, n, m)
    return {"stochastic_k_14": 100 * div(b.C - ll, hh - ll), "williams_r_14": -100 * div(hh - b.C, hh - ll)}


def cci(r: Roll, n=20):
    window, mean = r.values(b.TP, n), r.mean(b.TP, n, 1)
    mad = F.aggregate(window, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / F.size(window)
    return {"cci_20": div(b.TP - mean, 0.015 * mad)}


def returns(r: Roll, bars_1h: int, bars_24h: int):
    def change(k):
        return div(b.C - r.lag(b.C, k), r.lag(b.C, k)) * 100
    return {"roc_10": change(10), "roc_20": change(20), "momentum_10": b.C - r.lag(b.C, 10), "momentum_20": b.C - r.lag(b.C, 20),
            "returns_1h": (div(b.C, r.lag(b.C, bars_1h)) - 1) * 100, "returns_24h": (div(b.C, r.lag(b.C, bars_24h)) - 1) * 100}


def pct(r: Roll, k: int) -> Column:
    return div(b.C, r.lag(b.C, k)) - 1


# trend ------------------------------------------------------------------------------------------


def directional(r: Roll, tr="_tr", n=14):
    atr = r.mean(tr, n, 1)
    return {"plus_di": div(100 * r.mean("_pdm", n, 1), atr), "minus_di": div(100 * r.mean("_mdm", n, 1), atr)}


def adx_sma(d: DataFrame, r: Roll, tr="_tr", n=14) -> DataFrame:
    """Directional index with plain averages; needs a reach of 2n."""
    d = d.withColumns(directional(r, tr, n))
    p, m = F.col("plus_di"), F.col("minus_di")
    d = d.withColumn("_dx", div(100 * F.abs(p - m), p + m))
    return d.withColumns({"adx_14": r.mean("_dx", n, 1), "di_diff": p - m})


def aroon(r: Roll, n=14):
    """Position counted from the oldest row of the window, first extreme wins."""
    hs, ls = r.values(b.H, n), r.values(b.L, n)
    full = F.size(hs) >= n
    up = (n - (F.array_position(hs, F.array_max(hs)) - 1)) / F.lit(n) * 100
    down = (n - (F.array_position(ls, F.array_min(ls)) - 1)) / F.lit(n) * 100
    return {"aroon_up": F.when(full, up), "aroon_down": F.when(full, down), "aroon_oscillator": F.when(full, up - down)}


def trend_strength(r: Roll):
    return {"trend_strength": div(r.mean(b.C, 5, 1) - r.mean(b.C, 20, 1), r.mean(b.C, 20, 1)) * 100}


# volatility -------------------------------------------------------------------------------------


def bollinger(r: Roll, n=20, m=1):
    mid, sd = r.mean(b.C, n, m), r.std(b.C, n, m)
    up, low = mid + 2 * sd, mid - 2 * sd
    return {"bb_upper": up, "bb_lower": low, "bb_width": div(up - low, b.C) * 100, "bb_position": div(b.C - low, up - low)}


def atr_sma(r: Roll, tr="_tr"):
    return {"atr_14": r.mean(tr, 14, 1), "atr_20": r.mean(tr, 20, 1)}


def volatility(r: Roll):
    return {f"volatility_{n}": F.coalesce(r.std("_ret", n, 1), F.lit(0.0)) * 100 for n in (10, 20)}


def skew_kurt(r: Roll, x="_ret", n=20):
    """Sample skewness and excess kurtosis from Spark's population moments."""
    skew = r._agg(F.skewness, x, n, n) * F.lit(math.sqrt(n * (n - 1)) / (n - 2))
    kurt = (r._agg(F.kurtosis, x, n, n) * (n + 1) + 6) * F.lit((n - 1) / ((n - 2) * (n - 3)))
    return {"ret_skew_20": skew, "ret_kurt_20": clip(kurt, -5.0, 10.0)}


def choppiness(r: Roll, n=14):
    chop = 100 * F.log10(r.sum("_tr0", n) / (r.max(b.H, n) - r.min(b.L, n) + EPS)) / F.lit(math.log10(n))
    return {"chop": clip(chop, 1.0, 100.0), "chop_norm": (clip(chop, 1.0, 100.0) - 38.2) / 61.8}


def efficiency_ratio(r: Roll, n=20):
    path = r.sum(F.abs(F.col("_d")), n)
    return {"kauf_er_20": clip(F.abs(b.C - r.lag(b.C, n)) / (path + EPS), 0.0, 1.0)}


def hurst(d: DataFrame, r: Roll, n=60) -> DataFrame:
    """Variance ratio of 4-bar mean returns to 1-bar returns; needs a reach of n+4."""
    lr = F.when(F.col("_pc") > 0, F.log(div(b.C, "_pc")))
    d = d.withColumn("_lr", lr).withColumn("_lr4", r.mean("_lr", 4))
    v1 = F.pow(r.std("_lr", n, n // 2), F.lit(2))
    v4 = F.pow(r.std("_lr4", n, n // 2), F.lit(2))
    h = 0.5 + 0.5 * F.log((v4 + 1e-12) / (v1 + 1e-12)) / F.lit(math.log(4))
    return d.withColumn("hurst_60", F.coalesce(clip(h, 0.0, 1.0), F.lit(0.5)))


def rsi_divergence(r: Roll, rsi="rsi_14", n=20):
    s = F.col(rsi)
    bear = flag((b.C >= r.max(b.C, n) * 0.995) & (s <= r.max(rsi, n) * 0.985))
    bull = flag((b.C <= r.min(b.C, n) * 1.005) & (s >= r.min(rsi, n) * 1.015))
    return {"rsi_div_20": bull - bear}


def macd_divergence(r: Roll, hist="macd_hist", n=20):
    h = F.col(hist)
    bear = flag((b.C > r.max(b.C, n, n, 1)) & (h < r.max(hist, n, n, 1) * 0.85))
    bull = flag((b.C < r.min(b.C, n, n, 1)) & (h > r.min(hist, n, n, 1) * 0.85))
    return {"macd_div_20": bull - bear}


def percent_rank(r: Roll, x, n: int) -> Column:
    """Average rank of the current value in its window over n; NULL until n values exist."""
    x = col(x)
    w = r.values(x, n)
    below = F.size(F.filter(w, lambda v: v < x))
    same = F.size(F.filter(w, lambda v: v == x))
    return F.when((F.size(w) >= n) & x.isNotNull(), (below + (same + 1) / 2) / n)


def autocorrelation(r: Roll, x="_ret", n=20, m=10):
    cov = r.mean(F.col("_rr1"), n, m) - r.mean(x, n, m) * r.mean("_r1", n, m)
    var = F.greatest(F.pow(r.std(x, n, m), F.lit(2)), F.lit(1e-12))
    return {"ret_autocorr_20": F.coalesce(clip(cov / var, -1.0, 1.0), F.lit(0.0))}


def lagged_product(d: DataFrame, r: Roll, x="_ret") -> DataFrame:
    return d.withColumn("_r1", r.lag(x)).withColumn("_rr1", col(x) * F.col("_r1"))


def session_vwap(d: DataFrame, keys=KEYS) -> DataFrame:
    """Running VWAP and running deviation of the close inside each UTC day (one day per task)."""
    w = (Window.partitionBy(*keys, F.to_date("bar_ts")).orderBy("bar_ts")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("session_vwap", F.sum(b.TP * b.V).over(w) / (F.sum(b.V).over(w) + EPS))
    d = d.withColumn("session_vwap_std", F.stddev_samp(b.C).over(w))
    vw = F.col("session_vwap")
    return d.withColumns({"session_vwap_dev": (b.C - vw) / (vw + EPS),
                          "vwap_band_pos": (b.C - vw) / (F.col("session_vwap_std") + EPS)})


# volume -----------------------------------------------------------------------------------------


def flows(d: DataFrame) -> DataFrame:
    """Per-bar flows whose running sums are OBV, volume-price trend and accumulation/distribution."""
    mfm = div((b.C - b.L) - (b.H - b.C), b.H - b.L)
    ad = F.coalesce(mfm * b.V, F.lit(0.0))
    return d.withColumns({"_obv": F.coalesce(F.signum("_d") * b.V, F.lit(0.0)),
                          "_vpt": F.coalesce(b.V * F.col("_ret"), F.lit(0.0)),
                          "_ad": ad, "_ad1": F.when(F.col("bar_idx") > 0, ad).otherwise(0.0)})


FLOW_TOTALS = [total("obv", "_obv"), total("volume_price_trend", "_vpt"), total("accumulation_distribution", "_ad")]
# Decayed sums of the flow after the first bar: EMA_s(running sum) = running sum - q * decayed sum.
CHAIKIN = [Linear("_f3", "_ad1", 0.5), Linear("_f10", "_ad1", 1 - 2 / 11)]


def chaikin() -> Column:
    return F.col("_f10") * (1 - 2 / 11) - F.col("_f3") * 0.5


def volume_sma(r: Roll):
    return {"volume_sma_20": r.mean(b.V, 20, 1), "volume_ratio": div(b.V, r.mean(b.V, 20, 1))}


def vol_zscore(r: Roll, n=20):
    return div(b.V - r.mean(b.V, n), r.std(b.V, n))


# support and resistance ranges --------------------------------------------------------------------


def range_distance(r: Roll):
    c = b.C + EPS
    out = {}
    for n in (20, 100):
        out[f"dist_high{n}"] = (r.max(b.H, n, n, 1) - b.C) / c
        out[f"dist_low{n}"] = (b.C - r.min(b.L, n, n, 1)) / c
    up, down = (r.max(b.H, 200, 200, 1) - b.C) / c, (b.C - r.min(b.L, 200, 200, 1)) / c
    out["sr_compression"] = up / (up + down + EPS)
    return out


def sr_range(r: Roll, n=20):
    hi, lo = r.max(b.H, n), r.min(b.L, n)
    pos = (b.C - lo) / (hi - lo + EPS)
    return {"sr_range_position": pos, "sr_near_high": flag((hi - b.C) / (b.C + EPS) < 0.005),
            "sr_near_low": flag((b.C - lo) / (b.C + EPS) < 0.005), "sr_breakout_up": flag(b.C > r.max(b.H, n, n, 1)),
            "sr_breakout_dn": flag(b.C < r.min(b.L, n, n, 1)),
            "sr_upper_band": flag(div(b.C - lo, hi - lo) > 0.95), "sr_lower_band": flag(div(b.C - lo, hi - lo) < 0.05)}


def sr_window(r: Roll, n=50):
    hi, lo = r.max(b.H, n, 1), r.min(b.L, n, 1)
    return {"sr_near_high": flag((hi > 0) & (div(hi - b.C, hi) <= 0.002)),
            "sr_near_low": flag((lo > 0) & (div(b.C - lo, lo) <= 0.002)),
            "sr_breakout_up": flag(b.C > hi), "sr_breakout_dn": flag(b.C < lo)}


def regime_state(d: DataFrame, r: Roll) -> DataFrame:
    """0 ranging, 1 trending, 2 volatile; strict 14-row averages, reach 213."""
    up = F.greatest(b.H - F.col("_ph"), F.lit(0.0))
    down = F.greatest(F.col("_pl") - b.L, F.lit(0.0))
    d = d.withColumns({"_ratr": r.mean("_trl0", 14), "_rup": F.when(F.col("_ph").isNotNull(), up),
                       "_rdn": F.when(F.col("_pl").isNotNull(), down)})
    d = d.withColumns({"_rp": div(100 * r.mean("_rup", 14), "_ratr"), "_rm": div(100 * r.mean("_rdn", 14), "_ratr")})
    d = d.withColumn("_rdx", div(100 * F.abs(F.col("_rp") - F.col("_rm")), F.col("_rp") + F.col("_rm")))
    d = d.withColumns({"_radx": r.mean("_rdx", 14), "_rpct": div("_ratr", b.C)})
    d = d.withColumn("_rrank", percent_rank(r, "_rpct", 200))
    state = F.when(F.col("_rrank") > 0.85, 2).when(F.col("_radx") < 25, 0).otherwise(1)
    d = d.withColumn("regime_state", state)
    s = F.col("regime_state")
    return d.withColumns({"regime_is_ranging": flag(s == 0), "regime_is_trending": flag(s == 1),
                          "regime_is_volatile": flag(s == 2)})


# the canonical set ------------------------------------------------------------------------------

# The canonical feature names in their required order.
CANONICAL = [
    "sma_10", "sma_20", "sma_50", "sma_100", "sma_200",
    "ema_12", "ema_26", "ema_50", "close_sma_20_ratio", "close_sma_50_ratio",
    "close_sma_200_ratio", "high_low_spread", "close_open_ratio", "body_size", "upper_shadow",
    "lower_shadow", "rsi_14", "rsi_7", "stochastic_k_14", "stochastic_d_14",
    "williams_r_14", "cci_20", "roc_10", "roc_20", "momentum_10",
    "momentum_20", "macd", "macd_signal", "macd_histogram", "adx_14",
    "aroon_up", "aroon_down", "aroon_oscillator", "trend_strength", "bb_upper",
    "bb_lower", "bb_width", "bb_position", "atr_14", "atr_20",
    "volatility_10", "volatility_20", "volume_sma_20", "volume_ratio", "obv",
    "volume_price_trend", "accumulation_distribution", "chaikin_oscillator", "returns_1h", "returns_24h",
]
REACH = 200


def macd_columns(fast="ema_12", slow="ema_26", nine="ema_9"):
    line = F.col(fast) - F.col(slow)
    signal = cascade(fast, nine, 12, 9) - cascade(slow, nine, 26, 9)
    return {"macd": line, "macd_signal": signal, "macd_histogram": line - signal}


CLOSE_EMAS = [ema(f"ema_{s}", "close", s) for s in (9, 12, 21, 26, 50, 100, 200)]


def canonical(bars: DataFrame, minutes: int, fill: str = "zero", keys=KEYS, extra=None, last: int | None = None) -> DataFrame:
    """The 50 canonical features of every bar: one index, one scan, one framed pass.

    ``extra(df, r)`` adds further frame columns in the same pass (reach up to 213). With ``last`` only the last rows of
    each series come back: all rows feed the recurrences, but just those that the frames reach enter the frames.
    """
    idx = index_series(bars, keys)
    reach = max(REACH, 1440 // minutes) + 16
    if last is not None:
        # One row per series.
        ends = idx.groupBy(*keys).agg(F.max("bar_idx").alias("_end"))
        idx = idx.join(ends, list(keys)).withColumn("_since", F.greatest(F.lit(0), F.col("_end") - (last + reach - 1)))

    def steps(d, r):
        return flows(base(d, r))

    d = framed(idx, steps, before=1, keys=keys)
    d = scan(d, [*CLOSE_EMAS, *FLOW_TOTALS, *CHAIKIN], keys, since=None if last is None else "_since")
    if last is not None:
        d = d.filter(F.col("bar_idx") >= F.col("_since"))

    def frames(d, r):
        d = d.withColumns({**sma(r), **sma_ratio(r), **price_ratios(), **rsi_sma(r), **stochastic(r), **cci(r),
                           **returns(r, max(1, 60 // minutes), max(1, 1440 // minutes)), **aroon(r),
                           **trend_strength(r), **bollinger(r), **atr_sma(r), **volatility(r), **volume_sma(r)})
        d = d.withColumn("stochastic_d_14", r.mean("stochastic_k_14", 3, 1))
        d = adx_sma(d, r)
        return extra(d, r) if extra else d

    d = framed(d, frames, before=reach, keys=keys)
    if last is not None:
        d = d.filter(F.col("bar_idx") > F.col("_end") - last).drop("_end", "_since")
    d = d.withColumns({**macd_columns(), "chaikin_oscillator": chaikin()})
    return fill_invalid(d, CANONICAL) if fill == "zero" else d


def fill_invalid(d: DataFrame, names) -> DataFrame:
    """NULL, NaN and infinities to 0."""
    bad = "`{0}` IS NULL OR isnan(`{0}`) OR abs(`{0}`) = double('Infinity')"
    return d.withColumns({n: F.expr(f"CASE WHEN {bad.format(n)} THEN 0D ELSE `{n}` END") for n in names})
