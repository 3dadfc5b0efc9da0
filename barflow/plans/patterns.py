"""Registered candlestick, chart and perpetual-futures queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.columns import rounded
from barflow.operators import candles as K
from barflow.operators import charts as H
from barflow.operators import perpetual as P
from barflow.operators import series as S
from barflow.plans import bars as PB
from barflow.plans import domain as D
from barflow.plans.indicators import agg, avg, b01, fr, lag, rec, sm, std
from barflow.plans.registry import cte, query


def emit(name, spark_fn, sql, src):
    """Per-bar outputs rounded to 6 places on both sides; sql maps output to expression."""
    cols = list(sql)

    @query(name, f"SELECT symbol, bar_ts, {', '.join(f'round({e}, 6) AS {c}' for c, e in sql.items())} FROM {src}", (src,))
    def run(spark, sf):
        return rounded(spark_fn(spark, sf).select("symbol", "bar_ts", *[F.col(c).cast("double") for c in cols]))

    return run


# candlesticks -----------------------------------------------------------------------------------

cte("k1", """SELECT *, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS down, high - low AS rng,
  abs(close - open) / greatest(high - low, 1e-10) AS br, (high - greatest(open, close)) / greatest(high - low, 1e-10) AS ur,
  (least(open, close) - low) / greatest(high - low, 1e-10) AS lr, close >= open AS bull, abs(d) AS move FROM x""", ("x",))
cte("k2", f"""SELECT *, {avg('move', 14)} AS mv, {avg('move', 13, 1, 1)} AS mvp,
  {', '.join(f'{lag(c, n)} AS {p}{c}' for p, n in (('b_', 1), ('a_', 2)) for c in ('open', 'high', 'low', 'close', 'br', 'body', 'bull'))} FROM k1""", ("k1",))
HAM = "down >= 2 * body AND ur < .20 AND br > .05"
INV = "up >= 2 * body AND lr < .20 AND br > .05"
MV = "(CASE WHEN mv > 0 THEN mv ELSE close * .01 END)"
MVP = "(CASE WHEN mvp > 0 THEN mvp ELSE close * .01 END) * .1"
RULES = {
    "doji": "br < .10 AND rng > 0", "long_legged_doji": "br < .10 AND ur > .30 AND lr > .30", "dragonfly_doji": "br < .10 AND ur < .05 AND lr > .60",
    "gravestone_doji": "br < .10 AND lr < .05 AND ur > .60", "hammer": f"{HAM} AND rng > {MV} * .5", "inv_hammer": INV, "hanging_man": HAM,
    "shooting_star": f"{INV} AND NOT bull", "bull_marubozu": "bull AND br > .95", "bear_marubozu": "NOT bull AND br > .95",
    "spinning_top": "br > .10 AND br < .40 AND ur > .20 AND lr > .20",
    "bull_engulfing": "NOT b_bull AND bull AND open <= b_close AND close >= b_open", "bear_engulfing": "b_bull AND NOT bull AND open >= b_close AND close <= b_open",
    "bull_harami": "NOT b_bull AND bull AND body < b_body * .5 AND open > b_close AND close < b_open",
    "bear_harami": "b_bull AND NOT bull AND body < b_body * .5 AND open < b_close AND close > b_open",
    "piercing": "NOT b_bull AND bull AND open < b_close AND close > (b_open + b_close) / 2", "dark_cloud": "b_bull AND NOT bull AND open > b_close AND close < (b_open + b_close) / 2",
    "tweezer_top": f"NOT bull AND abs(high - b_high) < {MVP}", "tweezer_bottom": f"bull AND abs(low - b_low) < {MVP}",
    "bull_kicker": "NOT b_bull AND bull AND open > b_open AND br > .5", "bear_kicker": "b_bull AND NOT bull AND open < b_open AND br > .5",
    "morning_star": "NOT a_bull AND a_br > .4 AND b_br < .3 AND bull AND close > (a_open + a_close) / 2",
    "evening_star": "a_bull AND a_br > .4 AND b_br < .3 AND NOT bull AND close < (a_open + a_close) / 2",
    "three_white_soldiers": "a_bull AND b_bull AND bull AND close > b_close AND b_close > a_close AND a_br > .5 AND b_br > .5 AND br > .5",
    "three_black_crows": "NOT a_bull AND NOT b_bull AND NOT bull AND close < b_close AND b_close < a_close AND a_br > .5 AND b_br > .5 AND br > .5",
    "three_inside_up": "NOT a_bull AND b_bull AND bull AND b_body < a_body AND close > b_close",
    "three_inside_down": "a_bull AND NOT b_bull AND NOT bull AND b_body < a_body AND close < b_close",
    "abandoned_baby_bull": "NOT a_bull AND b_br < .10 AND bull AND b_low < a_low AND low > b_high",
    "abandoned_baby_bear": "a_bull AND b_br < .10 AND NOT bull AND b_high > a_high AND high < b_low"}
RUN = "OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"
cte("k3", f"""SELECT symbol, bar_ts, i, {', '.join(f'{b01(c)} AS cdl_{n}' for n, c in RULES.items())}, br AS cdl_body_ratio, ur AS cdl_upper_wick_ratio,
  lr AS cdl_lower_wick_ratio, i - coalesce(max(CASE WHEN NOT bull THEN i END) {RUN}, -1) AS cdl_consecutive_bull,
  i - coalesce(max(CASE WHEN bull THEN i END) {RUN}, -1) AS cdl_consecutive_bear FROM k2""", ("k2",))


def wsum(w):
    return f"({' + '.join(f'{n} * {v}::DOUBLE' for n, v in w.items())}) / {sum(w.values())!r}::DOUBLE"


cte("k4", f"""SELECT *, cdl_bull_score - cdl_bear_score AS cdl_net_score, cdl_bull_score - cdl_bear_score AS cdl_reversal_signal,
  least(cdl_doji * .6 + cdl_long_legged_doji * .8 + cdl_spinning_top * .4, 1) AS cdl_indecision_score FROM
  (SELECT *, {wsum(K.BULL_WEIGHTS)} AS cdl_bull_score, {wsum(K.BEAR_WEIGHTS)} AS cdl_bear_score FROM k3)""", ("k3",))


def candles(spark, sf):
    return K.candlestick_patterns(D.indexed(spark, sf))


GEO = ["cdl_body_ratio", "cdl_upper_wick_ratio", "cdl_lower_wick_ratio", "cdl_consecutive_bull", "cdl_consecutive_bear"]
for _name, _cols in (("cdl_single", K.SINGLE), ("cdl_double", K.DOUBLE), ("cdl_triple", K.TRIPLE), ("cdl_scores", K.SCORES)):
    emit(_name, candles, {f"cdl_{c}": f"cdl_{c}" for c in _cols}, "k4")
emit("candlestick_patterns", candles, {c: c for c in [*[f"cdl_{n}" for n in (*RULES, *K.SCORES)], *GEO]}, "k4")
emit("candle_geometry", lambda s, f: K.geometry(D.bars(s, f)).select("symbol", "bar_ts", F.col("_body").alias("body"), F.col("_up").alias("upper_wick"),
     F.col("_down").alias("lower_wick"), F.col("_br").alias("body_ratio"), F.col("_ur").alias("upper_ratio"), F.col("_lr").alias("lower_ratio"), F.col("_bull").alias("bullish")),
     {"body": "body", "upper_wick": "up", "lower_wick": "down", "body_ratio": "br", "upper_ratio": "ur", "lower_ratio": "lr", "bullish": "bull::INT"}, "k1")

# charts -----------------------------------------------------------------------------------------


def btw(fn, x, lo, hi):
    a = f"{-lo} PRECEDING" if lo < 0 else f"{lo} FOLLOWING"
    b = f"{-hi} PRECEDING" if hi < 0 else f"{hi} FOLLOWING"
    return f"{fn}({x}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {a} AND {b})"


def pts(p, n):
    return f"list({{'i': i, 'p': {p}}}) FILTER (WHERE {p} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


cte("hp", f"""SELECT *, CASE WHEN high > {btw('max', 'high', -5, -1)} AND high > {btw('max', 'high', 1, 5)} THEN high END AS ph_,
  CASE WHEN low < {btw('min', 'low', -5, -1)} AND low < {btw('min', 'low', 1, 5)} THEN low END AS pl_,
  coalesce({avg('tr0', 14)}, close * .01) AS atr FROM x""", ("x",))
cte("hl", f"SELECT *, coalesce({pts('ph_', 60)}, []) AS hs, coalesce({pts('pl_', 60)}, []) AS ls FROM hp", ("hp",))
cte("hl2", """SELECT *, CASE WHEN i >= 60 THEN list_min(list_filter(list_transform(hs, lambda v: v.p), lambda p: p > close)) END AS res,
  CASE WHEN i >= 60 THEN list_max(list_filter(list_transform(ls, lambda v: v.p), lambda p: p < close)) END AS sup FROM hl""", ("hl",))
cte("hl3", "SELECT *, coalesce((close - sup) / close * 100, 0) AS sd, coalesce((res - close) / close * 100, 0) AS rd FROM hl2", ("hl2",))
cte("h_sr", """SELECT symbol, bar_ts, sd AS sr_support_dist_pct, rd AS sr_resistance_dist_pct, CASE WHEN abs(close - sup) < atr THEN 1 ELSE 0 END AS sr_at_support,
  CASE WHEN abs(res - close) < atr THEN 1 ELSE 0 END AS sr_at_resistance,
  CASE WHEN sup IS NULL THEN 0 ELSE len(list_filter(ls, lambda v: abs(v.p - sup) < atr * .5)) END AS sr_support_strength,
  CASE WHEN res IS NULL THEN 0 ELSE len(list_filter(hs, lambda v: abs(v.p - res) < atr * .5)) END AS sr_resistance_strength,
  CASE WHEN sd + rd > 0 THEN rd / (sd + rd) ELSE .5 END AS sr_range_position FROM hl3""", ("hl3",))
SR = ["sr_support_dist_pct", "sr_resistance_dist_pct", "sr_at_support", "sr_at_resistance", "sr_support_strength", "sr_resistance_strength", "sr_range_position"]
emit("pivots", lambda s, f: H.pivots(D.indexed(s, f)), {"pivot_high": "ph_", "pivot_low": "pl_"}, "hp")
emit("support_resistance", lambda s, f: H.support_resistance(D.indexed(s, f)), {c: c for c in SR}, "h_sr")


def reg(fn, y, x, n):
    return f"{fn}({y}, {x}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def fit(p, y):
    xs = f"CASE WHEN {y} IS NOT NULL THEN i::DOUBLE END"
    ok = f"i >= 50 AND count({y}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) >= 3"
    return ", ".join(f"CASE WHEN {ok} THEN {reg(fn, y, xs, 50)} END AS {p}{s}" for s, fn in (("s", "regr_slope"), ("b", "regr_intercept"), ("r", "corr")))


cte("ht", f"SELECT *, {fit('u', 'pl_')}, {fit('d', 'ph_')} FROM hp", ("hp",))
cte("ht2", "SELECT *, coalesce(us > 0 AND ur > .7, false) AS upt, coalesce(ds < 0 AND dr < -.7, false) AS dnt, us * i + ub AS ln, us * (i - 1) + ub AS lp, ds * i + db AS dl, ds * (i - 1) + db AS dp FROM ht", ("ht",))
TL = {"tl_uptrend_detected": b01("upt"), "tl_downtrend_detected": "0", "tl_trend_slope": "CASE WHEN upt THEN us / (close * .0001) ELSE 0 END",
      "tl_dist_to_trendline": "CASE WHEN upt THEN greatest((close - ln) / atr, 0) ELSE 0 END", "tl_near_trendline": b01("upt AND abs((close - ln) / atr) < 1"),
      "tl_breakout_up": "0", "tl_breakout_down": b01("upt AND close < ln AND pc >= lp")}
cte("h_tl", f"SELECT symbol, bar_ts, {', '.join(f'{e} AS {c}' for c, e in TL.items())}, {b01('dnt')} AS down_fixed, {b01('dnt AND close > dl AND pc <= dp')} AS up_fixed FROM ht2", ("ht2",))
emit("trendlines", lambda s, f: H.trendlines(D.indexed(s, f)), {c: c for c in TL}, "h_tl")
emit("trendlines_corrected", lambda s, f: H.trendlines(D.indexed(s, f), down_corr="negative"),
     {"tl_downtrend_detected": "down_fixed", "tl_breakout_up": "up_fixed", "tl_uptrend_detected": "tl_uptrend_detected"}, "h_tl")
cte("hf", f"""SELECT *, {lag('close', 20)} AS c20, {lag('close', 30)} AS c30, {btw('max', 'close', -20, -1)} - {btw('min', 'close', -20, -1)} AS sp FROM hp""", ("hp",))
cte("hf2", "SELECT *, abs(c20 - c30) / (atr * 10) AS sz, coalesce(abs(c20 - c30) / (atr * 10) > .5 AND sp < abs(c20 - c30) * .5, false) AS tight FROM hf", ("hf",))
FL = {"chp_bull_flag": b01("tight AND c20 > c30 AND pc < c20"), "chp_bear_flag": b01("tight AND c20 <= c30 AND pc > c20"),
      "chp_bull_flag_strength": "CASE WHEN tight AND c20 > c30 AND pc < c20 THEN sz ELSE 0 END", "chp_bear_flag_strength": "CASE WHEN tight AND c20 <= c30 AND pc > c20 THEN sz ELSE 0 END"}
cte("h_fl", f"SELECT symbol, bar_ts, {', '.join(f'{e} AS {c}' for c, e in FL.items())} FROM hf2", ("hf2",))
emit("flags", lambda s, f: H.flags(D.indexed(s, f)), {c: c for c in FL}, "h_fl")
cte("hg", f"SELECT *, CASE WHEN i >= 40 THEN {reg('regr_slope', 'high', 'i::DOUBLE', 40)} END AS sh, CASE WHEN i >= 40 THEN {reg('regr_slope', 'low', 'i::DOUBLE', 40)} END AS sl FROM hp", ("hp",))
cte("hg2", """SELECT *, CASE WHEN abs(sh) < .1 * atr AND sl > 0 THEN 1 WHEN sh < 0 AND abs(sl) < .1 * atr THEN 2 WHEN sh < 0 AND sl > 0 THEN 3 ELSE 0 END AS k FROM hg""", ("hg",))
TR = {"chp_asc_triangle": b01("k = 1"), "chp_desc_triangle": b01("k = 2"), "chp_sym_triangle": b01("k = 3"),
      "chp_triangle_apex_dist": "CASE WHEN k = 3 AND abs(sh - sl) > 1e-10 THEN (ph - pl) / abs(sh - sl) / 40 ELSE 0 END"}
cte("h_tr", f"SELECT symbol, bar_ts, {', '.join(f'{e} AS {c}' for c, e in TR.items())} FROM hg2", ("hg2",))
emit("triangles", lambda s, f: H.triangles(D.indexed(s, f)), {c: c for c in TR}, "h_tr")
cte("hr", "SELECT *, hs[-1] AS h1, hs[-2] AS h2, hs[-3] AS h3, ls[-1] AS l1, ls[-2] AS l2, ls[-3] AS l3 FROM hl", ("hl",))
DT = "i >= 60 AND len(hs) >= 2 AND abs(h1.p - h2.p) < atr * .5 AND h1.i - h2.i BETWEEN 5 AND 30"
DB = "i >= 60 AND len(ls) >= 2 AND abs(l1.p - l2.p) < atr * .5 AND l1.i - l2.i BETWEEN 5 AND 30"
RV = {"chp_double_top": b01(DT), "chp_double_bottom": b01(DB), "chp_double_top_dist": f"CASE WHEN {DT} THEN (close - least(h1.p, h2.p)) / atr ELSE 0 END",
      "chp_double_bottom_dist": f"CASE WHEN {DB} THEN (greatest(l1.p, l2.p) - close) / atr ELSE 0 END",
      "chp_hs_detected": b01("i >= 60 AND len(hs) >= 3 AND h2.p > h3.p AND h2.p > h1.p AND abs(h3.p - h1.p) < atr"),
      "chp_ihs_detected": b01("i >= 60 AND len(ls) >= 3 AND l2.p < l3.p AND l2.p < l1.p AND abs(l3.p - l1.p) < atr")}
cte("h_rv", f"SELECT symbol, bar_ts, {', '.join(f'{e} AS {c}' for c, e in RV.items())} FROM hr", ("hr",))
DOUBLES, HS = list(RV)[:4], list(RV)[4:]
emit("double_patterns", lambda s, f: H.reversals(D.indexed(s, f)), {c: c for c in DOUBLES}, "h_rv")
emit("head_shoulders", lambda s, f: H.reversals(D.indexed(s, f)), {c: c for c in HS}, "h_rv")
VF = "avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
AH, VC = b01(f"i >= 20 AND close >= {btw('max', 'close', -20, -1)} - atr * .3"), b01(f"i >= 20 AND volume > {VF} * 1.5")
BO = {"bo_at_high": AH, "bo_at_low": b01(f"i >= 20 AND close <= {btw('min', 'close', -20, -1)} + atr * .3"), "bo_volume_confirmation": VC, "bo_breakout_score": f"{AH} * .5 + {VC} * .5"}
cte("h_bo", f"SELECT symbol, bar_ts, {', '.join(f'{e} AS {c}' for c, e in BO.items())} FROM hp", ("hp",))
emit("breakouts", lambda s, f: H.breakouts(D.indexed(s, f)), {c: c for c in BO}, "h_bo")
cte("h_all", "SELECT * FROM h_sr JOIN h_tl USING (symbol, bar_ts) JOIN h_fl USING (symbol, bar_ts) JOIN h_tr USING (symbol, bar_ts) JOIN h_rv USING (symbol, bar_ts) JOIN h_bo USING (symbol, bar_ts)",
    ("h_sr", "h_tl", "h_fl", "h_tr", "h_rv", "h_bo"))
ALL = [*SR, *TL, *FL, *TR, *RV, *BO]
emit("chart_patterns", lambda s, f: H.chart_patterns(D.indexed(s, f)), {c: c for c in ALL}, "h_all")

# perpetual futures --------------------------------------------------------------------------------

cte("p1", "SELECT *, mark_price - close AS basis, (mark_price - close) / nullif(close, 0) AS basis_pct, coalesce(funding_rate, 0) AS fr, coalesce(open_interest, 0) AS oi FROM perp_filled", ("perp_filled",))


def z(x, n):
    return f"({x} - ({avg(x, n)})) / nullif(({std(x, n)}), 0)"


cte("p2", f"SELECT *, {z('basis_pct', 48)} AS bz, {z('fr', 168)} AS fz, {z('oi', 336)} AS oz, coalesce(oi / nullif({lag('oi')}, 0) - 1, 0) AS oc FROM p1", ("p1",))
FUND = {"funding_rate": "fr", "funding_cumsum_3": sm("fr", 3), "funding_zscore": "fz", "funding_spike": b01("abs(fz) > 2"), "funding_sign": "sign(fr)::DOUBLE"}
BASIS = {"basis": "basis", "basis_pct": "basis_pct", "basis_zscore": "bz", "basis_direction": "sign(basis)::DOUBLE"}
OI = {"oi": "oi", "oi_change_pct": "oc", "oi_change_5": f"coalesce(oi / nullif({lag('oi', 5)}, 0) - 1, 0)",
      "oi_price_confirm": f"CASE WHEN sign(coalesce(close - {lag('close')}, 0)) = sign(coalesce(oi - {lag('oi')}, 0)) THEN 1 ELSE -1 END", "oi_zscore": "oz"}
SQ = {"long_squeeze_risk": b01("fr > 0 AND abs(fz) > 2 AND oc < -.01"), "short_squeeze_risk": b01("fr < 0 AND abs(fz) > 2 AND oc < -.01")}


def perp(spark, sf):
    return P.perpetual_features(PB.perp_matrix(spark, sf))


emit("basis_features", perp, BASIS, "p2")
emit("funding_features", perp, FUND, "p2")
emit("oi_features", perp, OI, "p2")
emit("squeeze_risk", perp, SQ, "p2")
emit("perpetual_features", perp, {**BASIS, **FUND, **OI, **SQ}, "p2")

cte("fs", "SELECT 'ALL' AS symbol, bar_ts, funding_rate, row_number() OVER (ORDER BY bar_ts) - 1 AS i FROM funding_s", ("funding_s",))
rec("fe", "fs", [("n", "funding_rate", 1 - 2 / 9, 1.0), ("w", "1.0", 1 - 2 / 9, 1.0)])
cte("fsf", f"""SELECT bar_ts, funding_rate, n / w AS funding_ema8, {sm('funding_rate', 3)} AS funding_cum3,
  CASE WHEN count(funding_rate) {fr(50)} >= 10 THEN least(greatest((funding_rate - ({avg('funding_rate', 50, 10)})) / (({std('funding_rate', 50, 10)}) + 1e-9), -4), 4) END AS funding_zscore
  FROM fs JOIN fe USING (symbol, i)""", ("fs", "fe"))
FA = ["funding_rate", "funding_ema8", "funding_cum3", "funding_zscore"]
FA_DIGITS = {"funding_zscore": 9}


@query("funding_asof", f"SELECT b.symbol, b.bar_ts, {', '.join(f'round({c}, {FA_DIGITS.get(c, 14)}) AS {c}' for c in FA)} FROM bars b ASOF LEFT JOIN fsf ON b.bar_ts >= fsf.bar_ts", ("bars", "fsf"))
def funding_asof(spark, sf):
    f = D.funding(spark, sf).withColumns({"symbol": F.lit("ALL"), "timeframe": F.lit("1h")})
    f = P.funding_series(S.index_series(f)).drop("symbol", "timeframe")
    b = D.bars(spark, sf)
    return rounded(S.asof_join(b.select("symbol", "bar_ts"), [(PB._per_symbol(b, f), "bar_ts", {c: c for c in FA})]), 14, FA_DIGITS)


@query("funding_history", """SELECT bar_ts, round(funding_rate, 9) AS funding_rate FROM funding_s WHERE bar_ts >= (SELECT max(bar_ts) FROM funding_s) - INTERVAL '48 hours'""", ("funding_s",))
def funding_history(spark, sf):
    f = D.funding(spark, sf)
    since = f.agg((F.max("bar_ts") - F.expr("INTERVAL 48 HOURS")).alias("t")).scalar()
    return rounded(f.filter(F.col("bar_ts") >= since).orderBy("bar_ts"), 9)
