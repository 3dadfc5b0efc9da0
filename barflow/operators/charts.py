"""Chart patterns from pivots, regressions and trailing ranges.

A pivot is strictly beyond up to five neighbours on both sides and is never the first or last bar. In
``batch`` mode a pivot is used from the next bar on (it has then seen future bars); in ``confirmed``
mode only from five bars later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import div, flag
from barflow.functions.names import b
from barflow.operators.series import KEYS, Roll, framed

ORDER = 5
BEFORE, AFTER = 82, ORDER


def prepare(d: DataFrame, r: Roll) -> DataFrame:
    """ATR with its 1 % fallback and the pivot prices (NULL elsewhere)."""
    d = d.withColumn("_cpc", r.lag(b.C))
    tr = F.greatest(b.H - b.L, F.abs(b.H - F.col("_cpc")), F.abs(b.L - F.col("_cpc")))
    d = d.withColumn("_ctr", tr).withColumn("_atr", F.coalesce(r.mean("_ctr", 14), b.C * 0.01))
    top = (b.H > r.over(F.max(b.H), -ORDER, -1)) & (b.H > r.over(F.max(b.H), 1, ORDER))
    low = (b.L < r.over(F.min(b.L), -ORDER, -1)) & (b.L < r.over(F.min(b.L), 1, ORDER))
    return d.withColumns({"_ph_": F.when(top, b.H), "_pl_": F.when(low, b.L)})


def _recent(r: Roll, price: str, lookback: int, mode: str) -> Column:
    seen = -1 if mode == "batch" else -ORDER
    point = F.when(F.col(price).isNotNull(), F.struct(b.I.alias("i"), F.col(price).alias("p")))
    return r.over(F.collect_list(point), -lookback, seen)


def pivots(indexed: DataFrame, keys=KEYS) -> DataFrame:
    def build(d, r):
        return prepare(d, r).withColumns({"pivot_high": F.col("_ph_"), "pivot_low": F.col("_pl_")})

    return framed(indexed, build, 20, AFTER, keys)


def _levels(d: DataFrame, r: Roll, lookback: int, mode: str) -> DataFrame:
    d = d.withColumns({"_hs": _recent(r, "_ph_", lookback, mode), "_ls": _recent(r, "_pl_", lookback, mode)})
    live = b.I >= lookback
    res = F.array_min(F.filter(F.transform("_hs", lambda x: x["p"]), lambda p: p > b.C))
    sup = F.array_max(F.filter(F.transform("_ls", lambda x: x["p"]), lambda p: p < b.C))
    d = d.withColumns({"_res": F.when(live, res), "_sup": F.when(live, sup)})
    res, sup = F.col("_res"), F.col("_sup")
    rd, sd = div(res - b.C, b.C) * 100, div(b.C - sup, b.C) * 100

    def strength(points, level):
        near = F.size(F.filter(points, lambda x: F.abs(x["p"] - level) < b.ATR * 0.5))
        return F.when(level.isNotNull(), near).otherwise(0)

    total = F.coalesce(sd, F.lit(0.0)) + F.coalesce(rd, F.lit(0.0))
    return d.withColumns({
        "sr_support_dist_pct": F.coalesce(sd, F.lit(0.0)), "sr_resistance_dist_pct": F.coalesce(rd, F.lit(0.0)),
        "sr_at_support": flag(F.abs(b.C - sup) < b.ATR), "sr_at_resistance": flag(F.abs(res - b.C) < b.ATR),
        "sr_support_strength": strength("_ls", sup), "sr_resistance_strength": strength("_hs", res),
        "sr_range_position": F.when(total > 0, div(F.coalesce(rd, F.lit(0.0)), total)).otherwise(0.5)})


def support_resistance(indexed: DataFrame, mode: str = "batch", keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: _levels(prepare(d, r), r, 60, mode), BEFORE, AFTER, keys)


def _lines(d: DataFrame, r: Roll, lookback: int, mode: str, down_corr: str) -> DataFrame:
    seen = -1 if mode == "batch" else -ORDER

    def fit(price, p):
        y, x = F.col(price), b.I.cast("double")
        on = r.w.rowsBetween(-lookback, seen)
        enough = (F.count(y).over(on) >= 3) & (b.I >= lookback)
        xs = F.when(y.isNotNull(), x)
        # Not F.corr, which divides by zero where all pivots of a frame have one price: such a line has no correlation.
        agree = div(F.regr_sxy(y, xs).over(on), F.sqrt(F.regr_sxx(y, xs).over(on) * F.regr_syy(y, xs).over(on)))
        return {f"_{p}s": F.when(enough, F.regr_slope(y, xs).over(on)), f"_{p}b": F.when(enough, F.regr_intercept(y, xs).over(on)),
                f"_{p}r": F.when(enough, agree)}

    d = d.withColumns({**fit("_pl_", "u"), **fit("_ph_", "d"), "_c1": r.lag(b.C)})
    us, ub, ur, ds, db, dr = (F.col(c) for c in ("_us", "_ub", "_ur", "_ds", "_db", "_dr"))
    up = F.coalesce((us > 0) & (ur > 0.7), F.lit(False))
    agree = dr > 0.7 if down_corr == "parity" else dr < -0.7
    down = F.coalesce((ds < 0) & agree, F.lit(False))
    line, prior = us * b.I + ub, us * (b.I - 1) + ub
    dline, dprior = ds * b.I + db, ds * (b.I - 1) + db
    dist = div(b.C - line, b.ATR)
    return d.withColumns({
        "tl_uptrend_detected": flag(up), "tl_downtrend_detected": flag(down),
        "tl_trend_slope": F.when(up, div(us, b.C * 0.0001)).otherwise(0.0),
        "tl_dist_to_trendline": F.when(up, F.greatest(dist, F.lit(0.0))).otherwise(0.0),
        "tl_near_trendline": flag(up & (F.abs(dist) < 1)),
        "tl_breakout_up": flag(down & (b.C > dline) & (F.col("_c1") <= dprior)),
        "tl_breakout_down": flag(up & (b.C < line) & (F.col("_c1") >= prior))})


def trendlines(indexed: DataFrame, mode: str = "batch", down_corr: str = "parity", keys=KEYS) -> DataFrame:
    """``down_corr='parity'`` asks r > 0.7 of a falling line, which never holds; 'negative' asks r < -0.7."""
    return framed(indexed, lambda d, r: _lines(prepare(d, r), r, 50, mode, down_corr), BEFORE, AFTER, keys)


def _flags(d: DataFrame, r: Roll, pole=10, rest=20) -> DataFrame:
    end, start, last = r.lag(b.C, rest), r.lag(b.C, pole + rest), r.lag(b.C, 1)
    move = end - start
    size = div(F.abs(move), b.ATR * pole)
    span = r.over(F.max(b.C), -rest, -1) - r.over(F.min(b.C), -rest, -1)
    tight = (size > 0.5) & (span < F.abs(move) * 0.5)
    bull, bear = tight & (move > 0) & (last - end < 0), tight & (move <= 0) & (last - end > 0)
    return d.withColumns({"chp_bull_flag": flag(bull), "chp_bear_flag": flag(bear),
                          "chp_bull_flag_strength": F.when(bull, size).otherwise(0.0),
                          "chp_bear_flag_strength": F.when(bear, size).otherwise(0.0)})


def flags(indexed: DataFrame, keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: _flags(prepare(d, r), r), 46, AFTER, keys)


def _triangles(d: DataFrame, r: Roll, n=40) -> DataFrame:
    on, x = r.w.rowsBetween(-n, -1), b.I.cast("double")
    live = b.I >= n
    d = d.withColumns({"_sh": F.when(live, F.regr_slope(b.H, x).over(on)), "_sl": F.when(live, F.regr_slope(b.L, x).over(on)),
                       "_rg": r.lag(b.H) - r.lag(b.L)})
    sh, sl = F.col("_sh"), F.col("_sl")
    asc = F.coalesce((F.abs(sh) < 0.1 * b.ATR) & (sl > 0), F.lit(False))
    desc = ~asc & F.coalesce((sh < 0) & (F.abs(sl) < 0.1 * b.ATR), F.lit(False))
    sym = ~asc & ~desc & F.coalesce((sh < 0) & (sl > 0), F.lit(False))
    apex = F.when(sym & (F.abs(sh - sl) > 1e-10), div("_rg", F.abs(sh - sl)) / n).otherwise(0.0)
    return d.withColumns({"chp_asc_triangle": flag(asc), "chp_desc_triangle": flag(desc), "chp_sym_triangle": flag(sym),
                          "chp_triangle_apex_dist": apex})


def triangles(indexed: DataFrame, keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: _triangles(prepare(d, r), r), 56, AFTER, keys)


def _reversals(d: DataFrame, r: Roll, lookback: int, mode: str) -> DataFrame:
    d = d.withColumns({"_hs": _recent(r, "_ph_", lookback, mode), "_ls": _recent(r, "_pl_", lookback, mode)})
    live = b.I >= lookback

    def last(points, k):
        return F.when(F.size(points) >= k, F.try_element_at(F.col(points), F.lit(-k)))

    def double(points):
        older, newer = last(points, 2), last(points, 1)
        gap = newer["i"] - older["i"]
        near = F.abs(older["p"] - newer["p"]) < b.ATR * 0.5
        return live & near & gap.between(5, lookback // 2), older["p"], newer["p"]

    top, t1, t2 = double("_hs")
    bottom, b1, b2 = double("_ls")
    h, l = [last("_hs", k)["p"] for k in (3, 2, 1)], [last("_ls", k)["p"] for k in (3, 2, 1)]
    return d.withColumns({
        "chp_double_top": flag(top), "chp_double_bottom": flag(bottom),
        "chp_double_top_dist": F.when(top, div(b.C - F.least(t1, t2), b.ATR)).otherwise(0.0),
        "chp_double_bottom_dist": F.when(bottom, div(F.greatest(b1, b2) - b.C, b.ATR)).otherwise(0.0),
        "chp_hs_detected": flag(live & (h[1] > h[0]) & (h[1] > h[2]) & (F.abs(h[0] - h[2]) < b.ATR)),
        "chp_ihs_detected": flag(live & (l[1] < l[0]) & (l[1] < l[2]) & (F.abs(l[0] - l[2]) < b.ATR))})


def reversals(indexed: DataFrame, mode: str = "batch", keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: _reversals(prepare(d, r), r, 60, mode), BEFORE, AFTER, keys)


def _breakouts(d: DataFrame, r: Roll, n=20) -> DataFrame:
    live = b.I >= n
    high = flag(live & (b.C >= r.over(F.max(b.C), -n, -1) - b.ATR * 0.3))
    low = flag(live & (b.C <= r.over(F.min(b.C), -n, -1) + b.ATR * 0.3))
    vol = flag(live & (b.V > r.over(F.avg(b.V), -n, -1) * 1.5))
    return d.withColumns({"bo_at_high": high, "bo_at_low": low, "bo_volume_confirmation": vol,
                          "bo_breakout_score": high * 0.5 + vol * 0.5})


def breakouts(indexed: DataFrame, keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: _breakouts(prepare(d, r), r), 36, AFTER, keys)


def chart_patterns(indexed: DataFrame, mode: str = "batch", down_corr: str = "parity", keys=KEYS) -> DataFrame:
    """All 32 outputs in one framed pass."""

    def build(d, r):
        d = _levels(prepare(d, r), r, 60, mode)
        d = _breakouts(_triangles(_flags(_lines(d, r, 50, mode, down_corr), r), r), r)
        return _reversals(d, r, 60, mode)

    return framed(indexed, build, BEFORE, AFTER, keys)
