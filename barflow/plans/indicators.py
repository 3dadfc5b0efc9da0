"""Registered indicator queries over 30-minute bars of the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.columns import EPS, clip, div, flag, half_even, rounded
from barflow.functions.names import b
from barflow.operators import bars as B
from barflow.operators import indicators as I
from barflow.operators import quality as Q
from barflow.operators import regimes as R
from barflow.operators import series as S
from barflow.plans import domain as D
from barflow.plans.registry import CTES, cte, query
from barflow.session import stage

# SQL building blocks --------------------------------------------------------------------------

cte("x", """SELECT *, close - pc AS d, close / nullif(pc, 0) - 1 AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr0,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  greatest(high - low, abs(high - pc), abs(pl - low)) AS trl0,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(pl - low)) END AS trl,
  greatest(coalesce(close - pc, 0), 0) AS gain, greatest(coalesce(pc - close, 0), 0) AS loss,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm, (high + low + close) / 3 AS tp
  FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM b
        WINDOW w AS (PARTITION BY symbol ORDER BY i))""", ("b",))


def fr(n, shift=0):
    end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"


def agg(fn, x, n, m=None, shift=0):
    m = n if m is None else m
    e = f"{fn}({x}) {fr(n, shift)}"
    return e if m <= 1 else f"CASE WHEN count({x}) {fr(n, shift)} >= {m} THEN {e} END"


def avg(x, n, m=None, shift=0):
    return agg("avg", x, n, m, shift)


def mx(x, n, m=None, shift=0):
    return agg("max", x, n, m, shift)


def mn(x, n, m=None, shift=0):
    return agg("min", x, n, m, shift)


def std(x, n, m=None):
    return agg("stddev_samp", x, n, m)


def sm(x, n, m=None):
    return agg("sum", x, n, m)


def lag(x, k=1):
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY i)"


def rec(name, src, items, seed=0, uses=None):
    """Recursive CTE: y = q*y + g*x, y[seed] = x (or g0*x). items: (out, expr, q, g[, first])."""
    first = ", ".join(f"({it[1]})::DOUBLE{'' if len(it) < 5 else f' * {it[4]}::DOUBLE'} AS {it[0]}" for it in items)
    nxt = ", ".join(f"{it[2]!r}::DOUBLE * r.{it[0]} + {it[3]!r}::DOUBLE * ({it[1]})" for it in items)
    cte(name, f"""(SELECT symbol, i, {first} FROM {src} WHERE i = {seed} UNION ALL
      SELECT s.symbol, s.i, {nxt} FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.i = r.i + 1)""", uses or (src,))


def span(out, x, s):
    return (out, x, 1 - 2 / (s + 1), 2 / (s + 1))


def wil(out, x, p):
    return (out, x, 1 - 1 / p, 1 / p)


rec("ec", "x", [span(f"ema_{s}", "close", s) for s in (3, 5, 9, 12, 21, 26, 50, 100, 200)])
cte("xe", "SELECT * FROM x JOIN ec USING (symbol, i)", ("x", "ec"))
cte("mc0", "SELECT *, ema_12 - ema_26 AS macd FROM xe", ("xe",))
rec("mc1", "mc0", [span("macd_signal", "macd", 9)])
cte("mc", "SELECT *, macd - macd_signal AS macd_histogram FROM mc0 JOIN mc1 USING (symbol, i)", ("mc0", "mc1"))
rec("wr", "x", [wil("g14", "gain", 14), wil("l14", "loss", 14), wil("g7", "gain", 7), wil("l7", "loss", 7),
                span("atr_e", "tr0", 14), wil("atr_w", "tr0", 14), span("p_e", "pdm", 14), span("m_e", "mdm", 14),
                wil("p_w", "pdm", 14), wil("m_w", "mdm", 14), span("vol_ema20", "volume", 20)])
cte("xw", """SELECT *, 100 - 100 / (1 + g14 / (l14 + 1e-9)) AS rsi_14, 100 - 100 / (1 + g7 / (l7 + 1e-9)) AS rsi_7
  FROM xe JOIN wr USING (symbol, i)""", ("xe", "wr"))


# Sums running over a whole series carry rounding noise of their size: fewer places are compared.
LOOSE = {"volume_price_trend": 4, "accumulation_distribution": 5, "chaikin_oscillator": 5, "macd": 6, "macd_signal": 6,
         "macd_histogram": 6, "ema_12": 7, "ema_26": 7, "ema_50": 7}


def feature(name, spark_fn, sql, src="x", digits=6):
    """Register a per-bar query; ``sql`` maps each output column to its SQL expression over ``src``."""
    items = ", ".join(f"round({e}, {LOOSE.get(c, digits)}) AS {c}" if not c.startswith("!") else f"{e} AS {c[1:]}" for c, e in sql.items())
    cols = [c.lstrip("!") for c in sql]

    @query(name, f"SELECT symbol, bar_ts, {items} FROM {src}", (src,))
    def run(spark, sf):
        return rounded(spark_fn(spark, sf).select("symbol", "bar_ts", *cols), digits, LOOSE)

    return run


def frames(name, reach, build, sql, src="x", digits=6):
    """A query whose Spark side is one framed pass over indexed bars; build(d, r) -> frame or columns."""

    def spark_fn(spark, sf):
        def steps(d, r):
            d = I.base(d, r)
            out = build(d, r)
            return d.withColumns(out) if isinstance(out, dict) else out
        return S.framed(D.indexed(spark, sf), steps, before=reach)

    return feature(name, spark_fn, sql, src, digits)


def scanned(spark, sf, specs):
    return S.scan(I.with_base(D.indexed(spark, sf)), specs)


WILDER = [S.wilder("g14", "_gain", 14), S.wilder("l14", "_loss", 14), S.wilder("g7", "_gain", 7), S.wilder("l7", "_loss", 7)]


def with_rsi(spark, sf, more=()):
    d = scanned(spark, sf, [*WILDER, *more])
    return d.withColumns({"rsi_14": I.rsi_recursive("g14", "l14"), "rsi_7": I.rsi_recursive("g7", "l7")})


def then(d, reach, build):
    def steps(x, r):
        out = build(x, r)
        return x.withColumns(out) if isinstance(out, dict) else out
    return S.framed(d, steps, before=reach)


# price, momentum --------------------------------------------------------------------------------

SMA = {f"sma_{n}": avg("close", n, 1) for n in (10, 20, 50, 100, 200)}
SMAR = {f"close_sma_{n}_ratio": f"close / nullif({avg('close', n, 1)}, 0)" for n in (20, 50, 200)}
PRICE = {"high_low_spread": "(high - low) / nullif(low, 0)", "close_open_ratio": "close / nullif(open, 0)",
         "body_size": "abs(close - open) / nullif(open, 0)",
         "upper_shadow": "(high - greatest(close, open)) / nullif(greatest(close, open), 0)",
         "lower_shadow": "(least(close, open) - low) / nullif(least(close, open), 0)"}
RSI = {f"rsi_{n}": f"100 - 100 / (1 + {avg('gain', n, 1)} / nullif({avg('loss', n, 1)}, 0))" for n in (14, 7)}
HL14 = f"nullif({mx('high', 14, 1)} - {mn('low', 14, 1)}, 0)"
STOCH = {"stochastic_k_14": f"100 * (close - {mn('low', 14, 1)}) / {HL14}", "williams_r_14": f"-100 * ({mx('high', 14, 1)} - close) / {HL14}"}
cte("xs", f"SELECT *, {STOCH['stochastic_k_14']} AS sk, list(tp) {fr(20)} AS tps, list(high) {fr(14)} AS hs, list(low) {fr(14)} AS ls FROM x", ("x",))
MAD = "list_avg(list_transform(tps, lambda v: abs(v - list_avg(tps))))"
CCI = f"(tp - list_avg(tps)) / nullif(0.015::DOUBLE * {MAD}, 0)"
RET = {}
for k in (10, 20):
    RET[f"roc_{k}"] = f"(close - {lag('close', k)}) / nullif({lag('close', k)}, 0) * 100"
    RET[f"momentum_{k}"] = f"close - {lag('close', k)}"
RET["returns_1h"] = f"(close / nullif({lag('close', 2)}, 0) - 1) * 100"
RET["returns_24h"] = f"(close / nullif({lag('close', 48)}, 0) - 1) * 100"

frames("sma", 200, lambda d, r: I.sma(r), SMA, digits=9)
frames("sma_ratio", 200, lambda d, r: I.sma_ratio(r), SMAR)
frames("price_ratios", 1, lambda d, r: I.price_ratios(), PRICE)
frames("rsi_sma", 15, lambda d, r: I.rsi_sma(r), RSI)
frames("stochastic", 17, lambda d, r: d.withColumns(I.stochastic(r)).withColumn("stochastic_d_14", r.mean("stochastic_k_14", 3, 1)),
       {"stochastic_k_14": "sk", "stochastic_d_14": avg("sk", 3, 1)}, "xs")
frames("williams_r", 14, lambda d, r: I.stochastic(r), {"williams_r_14": STOCH["williams_r_14"]})
frames("cci", 20, lambda d, r: I.cci(r), {"cci_20": CCI}, "xs")
frames("returns", 49, lambda d, r: {**I.returns(r, 2, 48), "ret_1": F.col("_ret"), "ret_6": I.pct(r, 6), "ret_24": I.pct(r, 24)},
       {**RET, "ret_1": "ret", "ret_6": f"close / nullif({lag('close', 6)}, 0) - 1", "ret_24": f"close / nullif({lag('close', 24)}, 0) - 1"})


def mom(d, r):
    d = d.withColumn("_r3", I.pct(r, 3))
    return d.withColumns({"mom_accel": F.col("_r3") - r.lag("_r3", 3), "mom_accel_short": F.col("_r3") - F.col("_ret")})


cte("xr3", f"SELECT *, close / nullif({lag('close', 3)}, 0) - 1 AS r3 FROM x", ("x",))
frames("mom_accel", 7, mom, {"mom_accel": f"r3 - {lag('r3', 3)}", "mom_accel_short": "r3 - ret"}, "xr3")

feature("ema", lambda s, f: S.scan(D.indexed(s, f), I.CLOSE_EMAS), {f"ema_{s}": f"ema_{s}" for s in (9, 12, 21, 26, 50, 100, 200)}, "xe")
PAIRS = ((9, 21), (21, 50), (50, 200))
feature("ema_cross", lambda s, f: S.scan(D.indexed(s, f), I.CLOSE_EMAS).withColumns({
    **{f"ema_cross_{a}_{b}": F.col(f"ema_{a}") - F.col(f"ema_{b}") for a, b in PAIRS},
    **{f"ema_sign_{a}_{b}": F.signum(F.col(f"ema_{a}") - F.col(f"ema_{b}")) for a, b in PAIRS},
    **{f"ema_{a}_{b}_cross": (F.col(f"ema_{a}") - F.col(f"ema_{b}")) / (F.col(f"ema_{b}") + EPS) for a, b in PAIRS}}),
    {**{f"ema_cross_{a}_{b}": f"ema_{a} - ema_{b}" for a, b in PAIRS},
     **{f"ema_sign_{a}_{b}": f"sign(ema_{a} - ema_{b})::DOUBLE" for a, b in PAIRS},
     **{f"ema_{a}_{b}_cross": f"(ema_{a} - ema_{b}) / (ema_{b} + 1e-9)" for a, b in PAIRS}}, "xe")
feature("price_vs_ema", lambda s, f: S.scan(D.indexed(s, f), I.CLOSE_EMAS).withColumns({
    "price_vs_ema200": div(b.C - F.col("ema_200"), "ema_200"),
    **{f"price_ema{n}": (b.C - F.col(f"ema_{n}")) / (F.col(f"ema_{n}") + EPS) for n in (21, 100)}}),
    {"price_vs_ema200": "(close - ema_200) / nullif(ema_200, 0)",
     **{f"price_ema{n}": f"(close - ema_{n}) / (ema_{n} + 1e-9)" for n in (21, 100)}}, "xe")
feature("rsi_wilder", with_rsi, {"rsi_14": "rsi_14", "rsi_7": "rsi_7"}, "xw")
feature("rsi_momentum", lambda s, f: then(with_rsi(s, f), 5, lambda d, r: {"rsi_mom": r.diff("rsi_14", 5)}),
        {"rsi_mom": f"rsi_14 - {lag('rsi_14', 5)}"}, "xw")


def macd_frame(spark, sf):
    d = scanned(spark, sf, [*I.CLOSE_EMAS, S.ema("atr_e", "_tr0", 14)]).withColumns(I.macd_columns())
    d = d.withColumn("macd_hist_n", F.col("macd_histogram") / (F.col("atr_e") + EPS))
    return then(d, 21, lambda x, r: {"macd_hist_slope": r.diff("macd_histogram"), **I.macd_divergence(r, "macd_histogram")})


cte("mcw", "SELECT * FROM mc JOIN (SELECT symbol, i, atr_e FROM wr) USING (symbol, i)", ("mc", "wr"))
feature("macd", macd_frame, {"macd": "macd", "macd_signal": "macd_signal", "macd_histogram": "macd_histogram",
                             "macd_hist_n": "macd_histogram / (atr_e + 1e-9)", "macd_hist_slope": f"macd_histogram - {lag('macd_histogram')}"}, "mcw")
MH = "macd_histogram"
feature("macd_divergence", macd_frame, {"!macd_div_20": f"""CASE WHEN close < {mn('close', 20, 20, 1)} AND {MH} > ({mn(MH, 20, 20, 1)}) * .85::DOUBLE
  THEN 1 ELSE 0 END - CASE WHEN close > {mx('close', 20, 20, 1)} AND {MH} < ({mx(MH, 20, 20, 1)}) * .85::DOUBLE THEN 1 ELSE 0 END"""}, "mcw")

# trend ------------------------------------------------------------------------------------------

cte("xdi", f"""SELECT *, 100 * {avg('pdm', 14, 1)} / nullif({avg('tr', 14, 1)}, 0) AS plus_di,
  100 * {avg('mdm', 14, 1)} / nullif({avg('tr', 14, 1)}, 0) AS minus_di,
  100 * {avg('pdm', 14, 1)} / nullif({avg('trl', 14, 1)}, 0) AS plus_dil,
  100 * {avg('mdm', 14, 1)} / nullif({avg('trl', 14, 1)}, 0) AS minus_dil FROM xs""", ("xs",))
cte("xdx", """SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx,
  100 * abs(plus_dil - minus_dil) / nullif(plus_dil + minus_dil, 0) AS dxl FROM xdi""", ("xdi",))
frames("adx_sma", 30, lambda d, r: I.adx_sma(d, r), {"plus_di": "plus_di", "minus_di": "minus_di", "di_diff": "plus_di - minus_di",
                                                     "adx_14": avg("dx", 14, 1)}, "xdx")
AROON = {"aroon_up": "CASE WHEN len(hs) >= 14 THEN (14 - (list_position(hs, list_max(hs)) - 1)) / 14::DOUBLE * 100 END",
         "aroon_down": "CASE WHEN len(ls) >= 14 THEN (14 - (list_position(ls, list_min(ls)) - 1)) / 14::DOUBLE * 100 END"}
AROON["aroon_oscillator"] = f"{AROON['aroon_up']} - {AROON['aroon_down']}"
frames("aroon", 14, lambda d, r: I.aroon(r), AROON, "xs")
TREND = f"({avg('close', 5, 1)} - {avg('close', 20, 1)}) / nullif({avg('close', 20, 1)}, 0) * 100"
frames("trend_strength", 20, lambda d, r: I.trend_strength(r), {"trend_strength": TREND})


def adx_ema(spark, sf):
    """ADX with EMA(14) and with Wilder smoothing: one scan for ranges and movements, one for DX."""
    specs = [f(n, x, 14) for f, s in ((S.ema, "e"), (S.wilder, "w")) for n, x in
             ((f"atr_{s}", "_tr0"), (f"p_{s}", "_pdm"), (f"m_{s}", "_mdm"))]
    d = scanned(spark, sf, specs)
    for s in "ew":
        d = d.withColumns({f"plus_{s}": 100 * F.col(f"p_{s}") / (F.col(f"atr_{s}") + EPS),
                           f"minus_{s}": 100 * F.col(f"m_{s}") / (F.col(f"atr_{s}") + EPS)})
        d = d.withColumn(f"dx_{s}", 100 * F.abs(F.col(f"plus_{s}") - F.col(f"minus_{s}"))
                         / (F.col(f"plus_{s}") + F.col(f"minus_{s}") + EPS))
    return S.scan(stage(d), [S.ema("adx_ema", "dx_e", 14), S.wilder("adx_wilder", "dx_w", 14)])


cte("dxe0", """SELECT *, 100 * p_e / (atr_e + 1e-9) AS plus_e, 100 * m_e / (atr_e + 1e-9) AS minus_e, 100 * p_w / (atr_w + 1e-9) AS plus_w,
  100 * m_w / (atr_w + 1e-9) AS minus_w FROM xw""", ("xw",))
cte("dxe1", """SELECT *, 100 * abs(plus_e - minus_e) / (plus_e + minus_e + 1e-9) AS dx_e,
  100 * abs(plus_w - minus_w) / (plus_w + minus_w + 1e-9) AS dx_w FROM dxe0""", ("dxe0",))
rec("dxe2", "dxe1", [span("adx_ema", "dx_e", 14), wil("adx_wilder", "dx_w", 14)])
cte("dxe", "SELECT * FROM dxe1 JOIN dxe2 USING (symbol, i)", ("dxe1", "dxe2"))
feature("adx_ema", adx_ema, {"adx_ema": "adx_ema", "adx_wilder": "adx_wilder", "plus_e": "plus_e", "minus_e": "minus_e", "plus_w": "plus_w"}, "dxe")

# volatility -------------------------------------------------------------------------------------

M20, S20 = avg("close", 20, 1), std("close", 20, 1)
BB = {"bb_upper": f"{M20} + 2 * {S20}", "bb_lower": f"{M20} - 2 * {S20}"}
BB["bb_width"] = f"(4 * {S20}) / nullif(close, 0) * 100"
BB["bb_position"] = f"(close - ({M20} - 2 * {S20})) / nullif(4 * {S20}, 0)"
M20f, S20f = f"({avg('close', 20)})", f"({std('close', 20)})"


def bb(d, r):
    d = d.withColumns(I.bollinger(r))
    mid, sd = r.mean(b.C, 20), r.std(b.C, 20)
    d = d.withColumns({"bb_width_mid": 4 * sd / (mid + EPS), "bb_pos": (b.C - (mid - 2 * sd)) / (4 * sd + EPS)})
    return d.withColumn("bb_squeeze", (F.col("bb_width_mid") - r.mean("bb_width_mid", 50)) / (r.std("bb_width_mid", 50) + EPS))


cte("xbb", f"SELECT *, 4 * {S20f} / ({M20f} + 1e-9) AS bbw FROM x", ("x",))
frames("bollinger", 70, bb, {**BB, "bb_width_mid": "bbw", "bb_pos": f"(close - ({M20f} - 2 * {S20f})) / (4 * {S20f} + 1e-9)",
                             "bb_squeeze": f"(bbw - ({avg('bbw', 50)})) / (({std('bbw', 50)}) + 1e-9)"}, "xbb")
frames("volatility", 21, lambda d, r: {**I.volatility(r), "volatility": r.std("_ret", 20)},
       {**{f"volatility_{n}": f"coalesce({std('ret', n, 1)}, 0) * 100" for n in (10, 20)}, "volatility": std("ret", 20)})
ATR = {"atr_14": avg("tr", 14, 1), "atr_20": avg("tr", 20, 1)}


def atr_all(spark, sf):
    d = scanned(spark, sf, [S.ema("atr_e", "_tr0", 14), S.wilder("atr_w", "_tr0", 14)])
    d = then(d, 51, lambda x, r: {**I.atr_sma(r), "_long": r.mean("atr_w", 50, 10)})
    return d.withColumns({"atr_pct": F.col("atr_e") / (b.C + EPS), "atr_ratio": F.col("atr_w") / (F.col("_long") + EPS),
                          "atr_pct_100": div("atr_14", "close") * 100})


feature("atr", atr_all, {**ATR, "atr_e": "atr_e", "atr_w": "atr_w"}, "xw")
feature("atr_pct", atr_all, {"atr_pct": "atr_e / (close + 1e-9)", "atr_ratio": f"atr_w / (({avg('atr_w', 50, 10)}) + 1e-9)",
                             "atr_pct_100": f"{avg('tr', 14, 1)} / nullif(close, 0) * 100"}, "xw")


def vol_regime(d, r):
    d = d.withColumns({f"_v{n}": r.std("_ret", n) for n in (5, 20, 60)})
    return d.withColumns({"vol_ratio_st_lt": F.col("_v5") / (F.col("_v20") + EPS), "vol_ratio_mt_lt": F.col("_v20") / (F.col("_v60") + EPS),
                          "vol_regime": F.col("_v20") / (r.quantile("_v20", 0.5, 50) + EPS),
                          "vol_of_vol": r.std("_v20", 20) / (r.mean("_v20", 50) + EPS)})


cte("xv", f"SELECT *, {std('ret', 5)} AS v5, {std('ret', 20)} AS v20, {std('ret', 60)} AS v60 FROM x", ("x",))
MED = f"CASE WHEN count(v20) {fr(50)} >= 50 THEN quantile_cont(v20, 0.5) {fr(50)} END"
frames("vol_regime", 72, vol_regime, {"vol_ratio_st_lt": "v5 / (v20 + 1e-9)", "vol_ratio_mt_lt": "v20 / (v60 + 1e-9)",
                                      "vol_regime": f"v20 / (({MED}) + 1e-9)",
                                      "vol_of_vol": f"({std('v20', 20)}) / (({avg('v20', 50)}) + 1e-9)"}, "xv")
frames("skew_kurt", 21, lambda d, r: I.skew_kurt(r), {"ret_skew_20": agg("skewness", "ret", 20),
                                                      "ret_kurt_20": f"CASE WHEN {agg('kurtosis', 'ret', 20)} IS NOT NULL THEN least(greatest({agg('kurtosis', 'ret', 20)}, -5), 10) END"})
CH = f"100 * log10(({sm('tr0', 14)}) / (({mx('high', 14)}) - ({mn('low', 14)}) + 1e-9)) / log10(14)"
CHC = f"CASE WHEN {CH} IS NOT NULL THEN least(greatest({CH}, 1), 100) END"
frames("choppiness", 15, lambda d, r: I.choppiness(r), {"chop": CHC, "chop_norm": f"(({CHC}) - 38.2::DOUBLE) / 61.8::DOUBLE"})
ER = f"abs(close - {lag('close', 20)}) / (({sm('abs(d)', 20)}) + 1e-9)"
frames("efficiency_ratio", 21, lambda d, r: I.efficiency_ratio(r), {"kauf_er_20": f"CASE WHEN {ER} IS NOT NULL THEN least(greatest({ER}, 0), 1) END"})
cte("xl", "SELECT *, CASE WHEN pc > 0 THEN ln(close / pc) END AS lr FROM x", ("x",))
cte("xh4", f"SELECT *, {avg('lr', 4)} AS lr4 FROM xl", ("xl",))
HU = f"0.5 + 0.5 * ln((pow({std('lr4', 60, 30)}, 2) + 1e-12) / (pow({std('lr', 60, 30)}, 2) + 1e-12)) / ln(4)"
cte("xh", f"SELECT *, {HU} AS hu FROM xh4", ("xh4",))
frames("hurst", 66, I.hurst, {"hurst_60": "CASE WHEN hu IS NULL THEN 0.5 ELSE least(greatest(hu, 0), 1) END"}, "xh")
feature("rsi_divergence", lambda s, f: then(with_rsi(s, f), 20, lambda d, r: I.rsi_divergence(r)),
        {"!rsi_div_20": f"""CASE WHEN close <= ({mn('close', 20)}) * 1.005::DOUBLE AND rsi_14 >= ({mn('rsi_14', 20)}) * 1.015::DOUBLE THEN 1 ELSE 0 END
  - CASE WHEN close >= ({mx('close', 20)}) * .995::DOUBLE AND rsi_14 <= ({mx('rsi_14', 20)}) * .985::DOUBLE THEN 1 ELSE 0 END"""}, "xw")
SW = "OVER (PARTITION BY symbol, CAST(bar_ts AS DATE) ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)"
cte("xsv", f"SELECT *, sum(tp * volume) {SW} / (sum(volume) {SW} + 1e-9) AS vw, stddev_samp(close) {SW} AS vs FROM x", ("x",))
feature("session_vwap", lambda s, f: I.session_vwap(D.bars(s, f)),
        {"session_vwap": "vw", "session_vwap_std": "vs", "session_vwap_dev": "(close - vw) / (vw + 1e-9)", "vwap_band_pos": "(close - vw) / (vs + 1e-9)"}, "xsv", 5)
frames("vwap_dev", 20, lambda d, r: {"vwap_dev": (b.C - r.sum(b.TP * b.V, 20) / (r.sum(b.V, 20) + EPS)) / (b.C + EPS)},
       {"vwap_dev": f"(close - ({sm('tp * volume', 20)}) / (({sm('volume', 20)}) + 1e-9)) / (close + 1e-9)"})

# volume -----------------------------------------------------------------------------------------

VOL = {"volume_sma_20": avg("volume", 20, 1), "volume_ratio": f"volume / nullif({avg('volume', 20, 1)}, 0)"}


def volume_stats(spark, sf):
    d = S.scan(D.indexed(spark, sf), [S.ema("vol_ema20", "volume", 20)])
    d = then(d, 51, lambda x, r: {**I.volume_sma(r), "vol_zscore": I.vol_zscore(r), "vol_zscore_50": I.vol_zscore(r, 50)})
    return d.withColumn("vol_ratio", b.V / (F.col("vol_ema20") + EPS))


feature("volume_stats", volume_stats, {**VOL, "vol_zscore": f"(volume - ({avg('volume', 20)})) / nullif({std('volume', 20)}, 0)",
                                       "vol_zscore_50": f"(volume - ({avg('volume', 50)})) / nullif({std('volume', 50)}, 0)",
                                       "vol_ratio": "volume / (vol_ema20 + 1e-9)"}, "xw")
RUN = "OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"
cte("xf", f"""SELECT *, sum(coalesce(sign(d) * volume, 0)) {RUN} AS obv, sum(coalesce(volume * ret, 0)) {RUN} AS vpt,
  coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0) AS adf FROM x""", ("x",))
cte("xad", f"SELECT *, sum(adf) {RUN} AS ad FROM xf", ("xf",))
rec("xck", "xad", [span("ad3", "ad", 3), span("ad10", "ad", 10)])
cte("xflow", "SELECT * FROM xad JOIN xck USING (symbol, i)", ("xad", "xck"))


def flow(spark, sf):
    d = S.framed(D.indexed(spark, sf), lambda x, r: I.flows(I.base(x, r)), before=1)
    return S.scan(d, [*I.FLOW_TOTALS, *I.CHAIKIN]).withColumn("chaikin_oscillator", I.chaikin())


feature("obv", flow, {"obv": "obv"}, "xflow")
feature("obv_z", lambda s, f: then(flow(s, f), 100, lambda d, r: {"obv_ret": clip(
    (F.col("obv") - r.mean("obv", 100, 20)) / F.greatest(r.std("obv", 100, 20), F.lit(1e-9)), -4.0, 4.0)}),
    {"obv_ret": f"""CASE WHEN count(obv) {fr(100)} >= 20 THEN least(greatest((obv - ({avg('obv', 100, 20)}))
      / greatest(({std('obv', 100, 20)}), 1e-9), -4), 4) END"""}, "xflow")
feature("vpt", flow, {"volume_price_trend": "vpt"}, "xflow", 4)
feature("accum_dist", flow, {"accumulation_distribution": "ad", "chaikin_oscillator": "ad3 - ad10"}, "xflow", 5)
CLV = "((close - low) - (high - close)) / (high - low + 1e-9)"
frames("cmf", 20, lambda d, r: {"cmf_20": r.sum(((b.C - b.L) - (b.H - b.C)) / (b.H - b.L + EPS) * b.V, 20) / (r.sum(b.V, 20) + EPS)},
       {"cmf_20": f"({sm(CLV + ' * volume', 20)}) / (({sm('volume', 20)}) + 1e-9)"})


def micro(spark, sf):
    d = then(I.with_base(D.indexed(spark, sf)), 20, lambda x, r: {
        "vp_div": F.signum("_ret") * F.signum(r.diff(b.V)), "obi_proxy": F.signum(b.C - b.O) * b.V / (r.mean(b.V, 20) + EPS),
        "gap_open": (b.O - F.col("_pc")) / (F.col("_pc") + EPS)})
    return S.scan(d, [S.ema("obi_smooth", "obi_proxy", 5, seed=19)])


cte("xob", f"SELECT *, sign(close - open) * volume / (({avg('volume', 20)}) + 1e-9) AS obi FROM x", ("x",))
rec("xob1", "xob", [span("obi_smooth", "obi", 5)], seed=19)
cte("xob2", "SELECT * FROM xob LEFT JOIN xob1 USING (symbol, i)", ("xob", "xob1"))
feature("microstructure", micro, {"vp_div": f"(sign(ret) * sign(volume - {lag('volume')}))::DOUBLE", "obi_proxy": "obi", "obi_smooth": "obi_smooth",
                                  "gap_open": "(open - pc) / (pc + 1e-9)"}, "xob2")

# ranges -----------------------------------------------------------------------------------------

RD = {}
for n in (20, 100):
    RD[f"dist_high{n}"] = f"(({mx('high', n, n, 1)}) - close) / (close + 1e-9)"
    RD[f"dist_low{n}"] = f"(close - ({mn('low', n, n, 1)})) / (close + 1e-9)"
UP, DN = f"(({mx('high', 200, 200, 1)}) - close) / (close + 1e-9)", f"(close - ({mn('low', 200, 200, 1)})) / (close + 1e-9)"
RD["sr_compression"] = f"{UP} / ({UP} + {DN} + 1e-9)"
frames("range_distance", 201, lambda d, r: I.range_distance(r), RD)
H20, L20 = f"({mx('high', 20)})", f"({mn('low', 20)})"


def b01(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


frames("sr_range", 21, lambda d, r: I.sr_range(r), {
    "sr_range_position": f"(close - {L20}) / ({H20} - {L20} + 1e-9)", "!sr_near_high": b01(f"({H20} - close) / (close + 1e-9) < .005"),
    "!sr_near_low": b01(f"(close - {L20}) / (close + 1e-9) < .005"), "!sr_breakout_up": b01(f"close > ({mx('high', 20, 20, 1)})"),
    "!sr_breakout_dn": b01(f"close < ({mn('low', 20, 20, 1)})"),
    "!sr_upper_band": b01(f"(close - {L20}) / nullif({H20} - {L20}, 0) > .95"), "!sr_lower_band": b01(f"(close - {L20}) / nullif({H20} - {L20}, 0) < .05")})
H50, L50 = mx("high", 50, 1), mn("low", 50, 1)
frames("sr_window50", 50, lambda d, r: I.sr_window(r), {
    "!sr_near_high": b01(f"{H50} > 0 AND ({H50} - close) / {H50} <= .002"), "!sr_near_low": b01(f"{L50} > 0 AND (close - {L50}) / {L50} <= .002"),
    "!sr_breakout_up": b01(f"close > {H50}"), "!sr_breakout_dn": b01(f"close < {L50}")})


def prank(lst, x, n):
    return f"""CASE WHEN len({lst}) >= {n} THEN (len(list_filter({lst}, lambda v: v < {x})) + (len(list_filter({lst}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / {n} END"""


cte("xpr", f"SELECT *, list(close) {fr(50)} AS c50, list(close) {fr(100)} AS c100, list(close) {fr(200)} AS c200 FROM x", ("x",))
frames("pct_rank", 200, lambda d, r: {f"pct_rank_{n}": I.percent_rank(r, "close", n) for n in (50, 100, 200)},
       {f"pct_rank_{n}": prank(f"c{n}", "close", n) for n in (50, 100, 200)}, "xpr")
cte("xac", f"SELECT *, {lag('ret')} AS r1, ret * {lag('ret')} AS rr1 FROM x", ("x",))
AC = f"(({avg('rr1', 20, 10)}) - ({avg('ret', 20, 10)}) * ({avg('r1', 20, 10)})) / greatest(pow(({std('ret', 20, 10)}), 2), 1e-12)"
cte("xac2", f"SELECT *, {AC} AS ac FROM xac", ("xac",))
frames("autocorr", 22, lambda d, r: (lambda e: e.withColumns(I.autocorrelation(r)))(I.lagged_product(d, r)),
       {"ret_autocorr_20": "CASE WHEN ac IS NULL THEN 0 ELSE least(greatest(ac, -1), 1) END"}, "xac2")
frames("rolling_sharpe", 49, lambda d, r: {"rolling_sharpe_48": r.mean("_ret", 48) / (r.std("_ret", 48) + EPS) * F.lit((252 * 24 * 12) ** 0.5)},
       {"rolling_sharpe_48": f"({avg('ret', 48)}) / (({std('ret', 48)}) + 1e-9) * sqrt(252 * 24 * 12)"})
frames("consec3", 3, lambda d, r: {"consec_bull": flag(r.sum(flag(b.C > b.O), 3) == 3), "consec_bear": flag(r.sum(flag(b.C > b.O), 3) == 0)},
       {f"!consec_{k}": b01(f"({sm('CASE WHEN close > open THEN 1 ELSE 0 END', 3)}) = {v}") for k, v in (("bull", 3), ("bear", 0))})


def trend_persistence(spark, sf):
    d = then(I.with_base(D.indexed(spark, sf)).withColumn("_dir", F.signum(F.coalesce("_ret", F.lit(0.0)))), 1,
             lambda x, r: {"_same": (F.col("_dir") == r.lag("_dir")) & (F.col("_dir") != 0)})
    return S.streak(d, F.col("_same"), "trend_persistence")


cte("xst", f"SELECT *, sign(coalesce(ret, 0)) AS dir FROM x", ("x",))
cte("xst2", f"SELECT *, coalesce(dir = {lag('dir')} AND dir <> 0, false) AS same FROM xst", ("xst",))
feature("streak", trend_persistence, {"!trend_persistence": f"i - coalesce(max(CASE WHEN NOT same THEN i END) {RUN}, -1)"}, "xst2")

# regimes ----------------------------------------------------------------------------------------

cte("xrg1", f"""SELECT *, {avg('trl0', 14)} AS ratr, CASE WHEN ph IS NOT NULL THEN greatest(high - ph, 0) END AS rup,
  CASE WHEN pl IS NOT NULL THEN greatest(pl - low, 0) END AS rdn FROM x""", ("x",))
cte("xrg2", f"SELECT *, 100 * ({avg('rup', 14)}) / nullif(ratr, 0) AS rp, 100 * ({avg('rdn', 14)}) / nullif(ratr, 0) AS rm FROM xrg1", ("xrg1",))
cte("xrg3", f"SELECT *, 100 * abs(rp - rm) / nullif(rp + rm, 0) AS rdx, ratr / nullif(close, 0) AS rpct FROM xrg2", ("xrg2",))
cte("xrg4", f"SELECT *, {avg('rdx', 14)} AS radx, list(rpct) FILTER (rpct IS NOT NULL) {fr(200)} AS rl FROM xrg3", ("xrg3",))
cte("xrg", f"SELECT *, CASE WHEN {prank('rl', 'rpct', 200)} > .85 THEN 2 WHEN radx < 25 THEN 0 ELSE 1 END AS st FROM xrg4", ("xrg4",))
frames("regime_state", 230, I.regime_state, {"!regime_state": "st", "!regime_is_ranging": b01("st = 0"), "!regime_is_trending": b01("st = 1"),
                                             "!regime_is_volatile": b01("st = 2")}, "xrg")


def regime_inputs(spark, sf):
    d = adx_ema(spark, sf)
    return then(d, 138, lambda x, r: vol_regime(I.hurst(x, r), r))


SMOOTH = {"hurst_smooth": "hurst_60", "adx_smooth": "adx_ema", "vol_regime_smooth": "vol_regime", "vol_of_vol_smooth": "vol_of_vol"}


def smoothed(spark, sf):
    """Normalised EMA(12) of the regime inputs; volatility ones start at row 69, the first full window."""
    d = stage(regime_inputs(spark, sf))
    d = S.ema_adjusted(d, {"hurst_smooth": ("hurst_60", 12), "adx_smooth": ("adx_ema", 12)})
    return S.ema_adjusted(d, {"vol_regime_smooth": ("vol_regime", 12), "vol_of_vol_smooth": ("vol_of_vol", 12)}, seed=69)


cte("rgi0", f"SELECT symbol, i, v20 / (({MED}) + 1e-9) AS vol_regime, ({std('v20', 20)}) / (({avg('v20', 50)}) + 1e-9) AS vol_of_vol FROM xv", ("xv",))
cte("rgi", """SELECT dxe.*, CASE WHEN hu IS NULL THEN 0.5 ELSE least(greatest(hu, 0), 1) END AS hurst_60, vol_regime, vol_of_vol
  FROM dxe JOIN rgi0 USING (symbol, i) JOIN (SELECT symbol, i, hu FROM xh) USING (symbol, i)""", ("dxe", "rgi0", "xh"))
Q12 = 1 - 2 / 13
rec("rgs1", "rgi", [("hn", "hurst_60", Q12, 1.0), ("an", "adx_ema", Q12, 1.0), ("n1", "1.0", Q12, 1.0)])
rec("rgs2", "rgi", [("vn", "vol_regime", Q12, 1.0), ("ovn", "vol_of_vol", Q12, 1.0), ("n2", "1.0", Q12, 1.0)], seed=69)
cte("rgs", """SELECT rgi.*, hn / n1 AS hurst_smooth, an / n1 AS adx_smooth, vn / n2 AS vol_regime_smooth, ovn / n2 AS vol_of_vol_smooth
  FROM rgi JOIN rgs1 USING (symbol, i) LEFT JOIN rgs2 USING (symbol, i)""", ("rgi", "rgs1", "rgs2"))
feature("ema_adjusted", smoothed, {k: k for k in SMOOTH}, "rgs")
cte("rgl", """SELECT *, CASE WHEN coalesce(vol_regime_smooth > 3, false) OR coalesce(vol_of_vol_smooth > 2, false) THEN 'crisis'
  WHEN hurst_smooth > .55 AND adx_smooth > 22 THEN 'trending' WHEN hurst_smooth < .47 AND adx_smooth < 18 THEN 'ranging'
  ELSE 'neutral' END AS regime_label FROM rgs""", ("rgs",))


def labels(spark, sf):
    d = smoothed(spark, sf)
    return d.withColumn("regime_label", R.regime_label(*[F.col(k) for k in SMOOTH]))


feature("regime_label", labels, {"!regime_label": "regime_label"}, "rgl")
cte("rgf", """(SELECT symbol, i, bar_ts, regime_label AS regime_smooth, 0 AS streak FROM rgl WHERE i = 0 UNION ALL
  SELECT s.symbol, s.i, s.bar_ts, CASE WHEN s.regime_label = r.regime_smooth OR r.streak >= 6 THEN s.regime_label ELSE r.regime_smooth END,
  CASE WHEN s.regime_label = r.regime_smooth THEN r.streak + 1 WHEN r.streak >= 6 THEN 1 ELSE r.streak END
  FROM rgf r JOIN rgl s ON s.symbol = r.symbol AND s.i = r.i + 1)""", ("rgl",))
feature("regime_smooth", lambda s, f: R.smooth_labels(stage(labels(s, f)), "regime_label", "regime_smooth"), {"!regime_smooth": "regime_smooth"}, "rgf")


@query("crisis_guard", """SELECT symbol, max(bar_ts) AS bar_ts, arg_max(vol_regime > 3 OR vol_of_vol > 2, i) AS crisis FROM rgi GROUP BY 1""", ("rgi",))
def crisis_guard(spark, sf):
    d = S.framed(D.indexed(spark, sf), lambda x, r: vol_regime(I.base(x, r), r), before=72)
    return R.crisis_guard(d).drop("timeframe")


# interactions, higher timeframes, whole sets ------------------------------------------------------


def interactions(spark, sf):
    d = adx_ema(spark, sf)
    d = S.scan(d, WILDER).withColumn("rsi_14", I.rsi_recursive("g14", "l14"))
    d = then(d, 70, lambda x, r: mom(I.hurst(x, r), r).withColumns(I.efficiency_ratio(r)))
    norm = clip(F.col("adx_ema") / 25.0, 0.0, 2.0)
    z = clip((F.col("rsi_14") - 50) / 50, -0.999, 0.999)
    return d.withColumns({"trend_mom": F.col("mom_accel") * norm, "rsi_trend": F.col("rsi_14") * norm,
                          "trend_conf": (F.col("hurst_60") - 0.5) * F.col("kauf_er_20"),
                          "log_ret_1": F.when(F.col("_pc") > 0, F.log(div(b.C, "_pc")))})


cte("xin", f"""SELECT dxe.*, least(greatest(adx_ema / 25, 0), 2) AS an, r3, CASE WHEN hu IS NULL THEN .5 ELSE least(greatest(hu, 0), 1) END AS hurst_60
  FROM dxe JOIN (SELECT symbol, i, r3 FROM xr3) USING (symbol, i) JOIN (SELECT symbol, i, hu FROM xh) USING (symbol, i)""", ("dxe", "xr3", "xh"))
feature("interactions", interactions, {"trend_mom": f"(r3 - {lag('r3', 3)}) * an", "rsi_trend": "rsi_14 * an",
                                       "trend_conf": f"(hurst_60 - .5) * CASE WHEN {ER} IS NOT NULL THEN least(greatest({ER}, 0), 1) END",
                                       "log_ret_1": "CASE WHEN pc > 0 THEN ln(close / pc) END"}, "xin")


def features_15m(spark, sf):
    d = with_rsi(spark, sf, [*I.CLOSE_EMAS, S.ema("atr_e", "_tr0", 14)])
    d = S.ema_adjusted(d, {"_va": ("volume", 20)})
    e = F.col
    clv = ((b.C - b.L) - (b.H - b.C)) / (b.H - b.L + EPS)

    def build(x, r):
        mid, sd = r.mean(b.C, 20), r.std(b.C, 20)
        return {"h_ret_1": e("_ret"), "h_ret_3": I.pct(r, 3), "h_cmf_20": r.sum(clv * b.V, 20) / (r.sum(b.V, 20) + EPS),
                "h_bb_pos": (b.C - (mid - 2 * sd)) / (4 * sd + EPS), "h_pct_rank_50": I.percent_rank(r, "close", 50)}

    d = then(d, 50, build)
    return d.withColumns({**{f"h_ema_{n}": e(f"ema_{n}") for n in (21, 50, 200)}, "h_trend": (e("ema_21") - e("ema_50")) / (e("ema_50") + EPS),
                          "h_trend_200": (e("ema_50") - e("ema_200")) / (e("ema_200") + EPS), "h_rsi_14": e("rsi_14"), "h_rsi_7": e("rsi_7"),
                          "h_atr_pct": e("atr_e") / (b.C + EPS), "h_vol_ratio": b.V / (e("_va") + EPS), "h_bull_bar": flag(b.C > b.O)})


QV = 1 - 2 / 21
rec("va", "x", [("vn", "volume", QV, 1.0), ("wn", "1.0", QV, 1.0)])
cte("xh15", f"SELECT xw.*, vn / wn AS va, list(close) {fr(50)} AS c50 FROM xw JOIN va USING (symbol, i)", ("xw", "va"))
feature("features_15m", features_15m, {
    "h_ret_1": "ret", "h_ret_3": f"close / nullif({lag('close', 3)}, 0) - 1", **{f"h_ema_{n}": f"ema_{n}" for n in (21, 50, 200)},
    "h_trend": "(ema_21 - ema_50) / (ema_50 + 1e-9)", "h_trend_200": "(ema_50 - ema_200) / (ema_200 + 1e-9)", "h_rsi_14": "rsi_14", "h_rsi_7": "rsi_7",
    "h_atr_pct": "atr_e / (close + 1e-9)", "h_vol_ratio": "volume / (va + 1e-9)", "!h_bull_bar": b01("close > open"),
    "h_cmf_20": f"({sm(CLV + ' * volume', 20)}) / (({sm('volume', 20)}) + 1e-9)", "h_bb_pos": f"(close - ({M20f} - 2 * {S20f})) / (4 * {S20f} + 1e-9)",
    "h_pct_rank_50": prank("c50", "close", 50)}, "xh15")


def features_1h(spark, sf):
    d = S.scan(adx_ema(spark, sf), [*WILDER, *I.CLOSE_EMAS])
    e = F.col

    def build(x, r):
        x = x.withColumns({"_v20": r.std("_ret", 20), "_v50": r.std("_ret", 50)})
        return x.withColumn("h1_vol_regime", e("_v20") / (r.quantile("_v50", 0.5, 100, 20) + EPS))

    d = then(d, 152, build)
    return d.withColumns({"h1_ema_21": e("ema_21"), "h1_ema_50": e("ema_50"), "h1_trend": (e("ema_21") - e("ema_50")) / (e("ema_50") + EPS),
                          "h1_rsi_14": I.rsi_recursive("g14", "l14"), "h1_atr_pct": e("atr_e") / (b.C + EPS), "h1_adx": e("adx_ema")})


cte("xv50", f"SELECT symbol, i, {std('ret', 50)} AS v50, {std('ret', 20)} AS v20 FROM x", ("x",))
cte("xv50m", f"SELECT *, CASE WHEN count(v50) {fr(100)} >= 20 THEN quantile_cont(v50, .5) {fr(100)} END AS md FROM xv50", ("xv50",))
cte("x1h", "SELECT * FROM dxe JOIN xv50m USING (symbol, i)", ("dxe", "xv50m"))
feature("features_1h", features_1h, {"h1_ema_21": "ema_21", "h1_ema_50": "ema_50", "h1_trend": "(ema_21 - ema_50) / (ema_50 + 1e-9)", "h1_rsi_14": "rsi_14",
                                     "h1_atr_pct": "atr_e / (close + 1e-9)", "h1_adx": "adx_ema", "h1_vol_regime": "v20 / (md + 1e-9)"}, "x1h")


def prior_gate(d, r):
    edge = F.abs(F.col("_ret"))
    ref = r._agg(lambda c: F.percentile(c, 0.7), edge, 256, 1, 1)
    seen = F.count(edge).over(r._frame(256, 1))
    return {"samples": seen, "threshold": F.when(seen >= 32, ref), "passed": flag((seen < 32) | (edge >= ref))}


def qc(x, p, n, shift=0):
    return f"quantile_cont({x}, {p}) {fr(n, shift)}"


cte("xab", "SELECT *, abs(ret) AS ar FROM x", ("x",))
frames("prior_percentile_gate", 258, prior_gate, {"!samples": f"count(ar) {fr(256, 1)}", "threshold": f"CASE WHEN count(ar) {fr(256, 1)} >= 32 THEN {qc('ar', .7, 256, 1)} END",
                                                  "!passed": b01(f"count(ar) {fr(256, 1)} < 32 OR ar >= {qc('ar', .7, 256, 1)}")}, "xab")


def edge_threshold(spark, sf):
    """Percentile of |edge| over the last 200 (a floor under 20 rows), and the rolling form with a global fallback."""
    from barflow.operators.ranking import quantiles
    d = then(I.with_base(D.indexed(spark, sf)).withColumn("_ar", F.abs("_ret")), 201, lambda x, r: {
        "_n": F.count("_ar").over(r._frame(200)), "_q": r.quantile("_ar", 0.8, 200, 1), "_b": r.quantile("_ar", 0.8, 200, 20)})
    whole = quantiles(d, "_ar", {"q": 0.8}, []).select("q").scalar()
    return d.withColumns({"live": F.when(F.col("_n") >= 20, F.col("_q")).otherwise(0.05), "backtest": F.coalesce("_b", whole)})


feature("rolling_quantile", edge_threshold, {"live": f"CASE WHEN count(ar) {fr(200)} >= 20 THEN {qc('ar', .8, 200)} ELSE .05 END",
                                             "backtest": f"coalesce(CASE WHEN count(ar) {fr(200)} >= 20 THEN {qc('ar', .8, 200)} END, (SELECT quantile_cont(ar, .8) FROM xab))"}, "xab")


def canon(spark, sf):
    return I.canonical(stage(D.bars(spark, sf)), 30)


CANON_SQL = {**SMA, **{f"ema_{s}": f"ema_{s}" for s in (12, 26, 50)}, **SMAR, **PRICE, **RSI, "stochastic_k_14": "sk", "stochastic_d_14": avg("sk", 3, 1),
             "williams_r_14": STOCH["williams_r_14"], "cci_20": CCI, **RET, "macd": "macd", "macd_signal": "macd_signal", "macd_histogram": "macd_histogram",
             "adx_14": avg("dx", 14, 1), **AROON, "trend_strength": TREND, **BB, **ATR,
             **{f"volatility_{n}": f"coalesce({std('ret', n, 1)}, 0) * 100" for n in (10, 20)}, **VOL, "obv": "obv", "volume_price_trend": "vpt",
             "accumulation_distribution": "ad", "chaikin_oscillator": "ad3 - ad10"}
CANON_SQL = {k: f"coalesce({v}, 0)" for k, v in CANON_SQL.items()}
cte("xall", """SELECT * FROM xdx JOIN (SELECT symbol, i, macd, macd_signal, macd_histogram, ema_9, ema_12, ema_21, ema_26, ema_50, ema_100, ema_200 FROM mc)
  USING (symbol, i) JOIN (SELECT symbol, i, obv, vpt, ad, ad3, ad10 FROM xflow) USING (symbol, i)""", ("xdx", "mc", "xflow"))
feature("canonical50", canon, CANON_SQL, "xall", 9)
LATEST = ", ".join(f"round({e}, {LOOSE.get(c, 9)}) AS {c}" for c, e in CANON_SQL.items())


@query("latest_features", f"""SELECT * EXCLUDE (i) FROM (SELECT symbol, bar_ts, i, {LATEST} FROM xall)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1 AND i >= 29""", ("xall",))
def latest_features(spark, sf):
    d = I.canonical(stage(D.bars(spark, sf)), 30, last=1).filter("bar_idx >= 29")
    return rounded(d.select("symbol", "bar_ts", *I.CANONICAL), 9, LOOSE)


ALIAS = {"macd_hist": "macd_histogram", "bb_pct": "bb_position", "vol_ratio": "volume_ratio", "volatility": "volatility_20"}


@query("feature_alias", "SELECT symbol, bar_ts, " + ", ".join(
    f"round({CANON_SQL[v]}, {LOOSE.get(v, 9)}) AS {k}" for k, v in ALIAS.items()) + f", round({CANON_SQL['rsi_14']}, 9) AS rsi_14_15m FROM xall", ("xall",))
def feature_alias(spark, sf):
    from barflow.functions.registry import resolve
    d = canon(spark, sf)
    return rounded(d.select("symbol", "bar_ts", *[F.col(resolve(k)).alias(k) for k in (*ALIAS, "rsi_14_15m")]), 9, {"macd_hist": 6})


@query("feature_contract", "SELECT unnest(range(0, " + str(len(I.CANONICAL)) + "))::INT AS position, unnest([" + ", ".join(f"'{n}'" for n in I.CANONICAL) + "]) AS feature, true AS present, unnest(["
       + ", ".join(f"count(*) FILTER ({n} IS NULL)" for n in I.CANONICAL) + "]) AS nulls, unnest([" + ", ".join(f"count(*) FILTER (NOT isfinite({n}))" for n in I.CANONICAL)
       + "]) AS not_finite FROM (SELECT " + ", ".join(f"{CANON_SQL[n]} AS {n}" for n in I.CANONICAL) + " FROM xall)", ("xall",))
def feature_contract(spark, sf):
    """Each feature of the contract beside the frame that is to hold it: is it there, how many values are missing."""
    d = canon(spark, sf)
    there = set(d.columns)
    cell = [(k, n, F.col(n) if n in there else F.lit(None).cast("double")) for k, n in enumerate(I.CANONICAL)]
    sums = [F.struct(F.lit(k).alias("position"), F.lit(n).alias("feature"), F.lit(n in there).alias("present"), F.count_if(c.isNull()).alias("nulls"),
                     F.count_if(F.isnan(c.cast("double")) | (F.abs(c) == float("inf"))).alias("not_finite")) for k, n, c in cell]
    return d.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def trend_15m(d, r):
    """EMA restarted inside the window: 9 closes against 21 closes."""
    def restarted(n):
        k = 2.0 / (n + 1)
        w = r.values(b.C, n)
        return F.aggregate(F.slice(w, 2, n), w[0], lambda a, x: k * x + (1 - k) * a)
    full = F.count(b.C).over(r._frame(21)) >= 21
    diff = restarted(9) - restarted(21)
    return {"trend_15m": F.when(full, F.when(diff > 0, 1).when(diff < 0, -1).otherwise(0))}


def red(n):
    k = 2 / (n + 1)
    return f"list_reduce(list(close) {fr(n)}, lambda a, x: {k!r}::DOUBLE * x + {1 - k!r}::DOUBLE * a)"


cte("xtr", f"SELECT symbol, bar_ts, i, {red(9)} - {red(21)} AS df FROM x", ("x",))
frames("trend_15m", 21, trend_15m, {"!trend_15m": "CASE WHEN i >= 20 THEN sign(df)::INT END"}, "xtr")


def v15(spark, sf):
    """The 20-name model set of every bar, with levels from the chart patterns."""
    from barflow.operators import charts
    d = scanned(spark, sf, I.CLOSE_EMAS).withColumns(I.macd_columns())
    e = F.col

    def build(x, r):
        x = x.withColumns({**I.rsi_sma(r), "atr_14": r.mean("_trl", 14, 1), "hl_range": b.H - b.L,
                           "roc_20": div(b.C - r.lag(b.C, 20), r.lag(b.C, 20)), "volatility": r.std("_ret", 20),
                           "volatility_10": r.std("_ret", 10, 1), "bb_width": div(4 * r.std(b.C, 20, 1), b.C)})
        x = I.adx_sma(x, r, "_trl")
        return x

    d = then(d, 30, build)
    d = charts.support_resistance(d)
    d = d.withColumns({"ema_cross_21_50": F.signum(e("ema_21") - e("ema_50")), "ema_cross_50_200": F.signum(e("ema_50") - e("ema_200")),
                       "ema_cross_9_21": F.signum(e("ema_9") - e("ema_21")), "price_vs_ema200": div(b.C, "ema_200") - 1,
                       "macd_hist": e("macd_histogram"), "atr_pct": div("atr_14", "close"),
                       "sr_near_high": flag(e("sr_at_resistance") > 0.5), "sr_near_low": flag(e("sr_at_support") > 0.5)})
    return I.fill_invalid(d, ["roc_20", "volatility", "volatility_10", "bb_width", "price_vs_ema200"])


V15 = {"adx_14": avg("dxl", 14, 1), "atr_14": avg("trl", 14, 1), "bb_width": f"coalesce(4 * {S20} / nullif(close, 0), 0)", "di_diff": "plus_dil - minus_dil",
       "ema_9": "ema_9", "ema_cross_21_50": "sign(ema_21 - ema_50)::DOUBLE", "ema_cross_50_200": "sign(ema_50 - ema_200)::DOUBLE", "hl_range": "high - low",
       "macd": "macd", "macd_hist": "macd_histogram", "minus_di": "minus_dil", "plus_di": "plus_dil", "price_vs_ema200": "coalesce(close / nullif(ema_200, 0) - 1, 0)",
       "roc_20": f"coalesce((close - {lag('close', 20)}) / nullif({lag('close', 20)}, 0), 0)", **RSI, "volatility": f"coalesce({std('ret', 20)}, 0)",
       "volatility_10": f"coalesce({std('ret', 10, 1)}, 0)", "ema_cross_9_21": "sign(ema_9 - ema_21)::DOUBLE", "atr_pct": f"{avg('trl', 14, 1)} / nullif(close, 0)"}
V15_TAIL = ["adx_14", "di_diff", "ema_cross_50_200", "macd_hist", "rsi_14"]
cte("v15f", "SELECT symbol, bar_ts, " + ", ".join(f"{e} AS {c}" for c, e in V15.items()) + " FROM xall", ("xall",))
cte("v15s", "SELECT symbol, bar_ts, sr_at_resistance AS sr_near_high, sr_at_support AS sr_near_low FROM h_sr", ("h_sr",))


@query("v15_features", "SELECT symbol, bar_ts, " + ", ".join(f"round({c}, 5) AS {c}" for c in V15) + ", sr_near_high, sr_near_low FROM v15f JOIN v15s USING (symbol, bar_ts)",
       ("v15f", "v15s"))
def v15_features(spark, sf):
    return rounded(v15(spark, sf).select("symbol", "bar_ts", *V15, "sr_near_high", "sr_near_low"), 5)


V15_ALL = [*V15, "sr_near_high", "sr_near_low"]


@query("feature_union", f"""SELECT feature, string_agg(grp, ',' ORDER BY grp) AS groups, sum(n)::BIGINT AS n_values, row_number() OVER (ORDER BY feature) - 1 AS position FROM (
  SELECT unnest([{", ".join(f"'{n}'" for n in I.CANONICAL)}]) AS feature, 'canonical' AS grp, unnest([{", ".join(f"count({n})" for n in I.CANONICAL)}]) AS n
  FROM (SELECT {", ".join(f"{CANON_SQL[n]} AS {n}" for n in I.CANONICAL)} FROM xall) UNION ALL
  SELECT unnest([{", ".join(f"'{n}'" for n in V15_ALL)}]), 'model', unnest([{", ".join(f"count({n})" for n in V15_ALL)}]) FROM v15f JOIN v15s USING (symbol, bar_ts)) GROUP BY feature""",
       ("xall", "v15f", "v15s"))
def feature_union(spark, sf):
    """The names that the canonical set and the model set hold together, with the values behind each."""
    model = v15(spark, sf).select("symbol", "bar_ts", *V15_ALL)
    ids = ("symbol", "timeframe", "bar_ts")
    return Q.feature_union({"canonical": canon(spark, sf).select(*ids, *I.CANONICAL), "model": model}, ids)


def v15_core(d, keys=S.KEYS):
    """Columns that the model set takes from a higher timeframe; ``d`` is indexed."""
    d = S.framed(d, I.base, before=1, keys=keys)
    d = S.scan(d, I.CLOSE_EMAS, keys).withColumns(I.macd_columns())
    d = S.framed(d, lambda x, r: I.adx_sma(x.withColumns(I.rsi_sma(r, (14,))), r, "_trl"), before=30, keys=keys)
    return d.withColumns({"ema_cross_50_200": F.signum(F.col("ema_50") - F.col("ema_200")), "macd_hist": F.col("macd_histogram")})


def v15_htf(spark, sf):
    """Model columns of the bars with five higher-timeframe columns, given once 14 higher bars exist; and the broken trend line."""
    from barflow.operators import charts
    bars = D.bars(spark, sf)
    high = v15_core(S.index_series(B.resample(bars, 14400), ("symbol",)), ("symbol",)).filter(b.I >= 13)
    d = S.asof_join(bars, [(high, "bar_ts", {c: f"{c}_15m" for c in V15_TAIL})])
    return charts.trendlines(S.index_series(stage(d))).withColumn("sr_breakout_dn", F.col("tl_breakout_down"))


cte("b4", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i FROM r4", ("r4",))
cte("x4", CTES["x"][1].replace("FROM b\n", "FROM b4\n"), ("b4",))
rec("ec4", "x4", [span(f"ema_{n}", "close", n) for n in (12, 26, 50, 200)])
cte("mc40", f"""SELECT *, ema_12 - ema_26 AS macd, 100 * {avg('pdm', 14, 1)} / nullif({avg('trl', 14, 1)}, 0) AS pdi, 100 * {avg('mdm', 14, 1)} / nullif({avg('trl', 14, 1)}, 0) AS mdi, {RSI['rsi_14']} AS rsi_14
  FROM x4 JOIN ec4 USING (symbol, i)""", ("x4", "ec4"))
rec("mc41", "mc40", [span("sig", "macd", 9)])
cte("mc42", "SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM mc40 JOIN mc41 USING (symbol, i)", ("mc40", "mc41"))
cte("v4", f"SELECT * FROM (SELECT symbol, bar_ts, i, {avg('dx', 14, 1)} AS adx_14, pdi - mdi AS di_diff, sign(ema_50 - ema_200)::DOUBLE AS ema_cross_50_200, macd - sig AS macd_hist, rsi_14 FROM mc42) WHERE i >= 13", ("mc42",))


@query("v15_features_htf", "SELECT b.symbol, b.bar_ts, " + ", ".join(f"round(v4.{c}, 6) AS {c}_15m" for c in V15_TAIL) + """, t.tl_breakout_down AS sr_breakout_dn FROM bars b JOIN h_tl t USING (symbol, bar_ts)
  ASOF LEFT JOIN v4 ON b.symbol = v4.symbol AND b.bar_ts >= v4.bar_ts""", ("bars", "h_tl", "v4"))
def v15_features_htf(spark, sf):
    return rounded(v15_htf(spark, sf).select("symbol", "bar_ts", *[f"{c}_15m" for c in V15_TAIL], "sr_breakout_dn"))


def mtf_context(spark, sf):
    """Context of two coarser frames resampled from the bars, brought back by as-of."""
    bars = D.bars(spark, sf)
    sides = []
    for seconds, p in ((3600, "mtf_3m"), (14400, "mtf_15m")):
        r = S.index_series(B.resample(bars, seconds), ("symbol",))
        r = S.framed(r, I.base, before=1, keys=("symbol",))
        r = S.scan(r, [S.ema("_e12", "close", 12)], ("symbol",))
        r = S.framed(r, lambda x, w: x.withColumns(I.rsi_sma(w, (14,))), before=14, keys=("symbol",))
        sides.append((r.select("symbol", "bar_ts", "rsi_14", "_e12"), "bar_ts", {"rsi_14": f"{p}_rsi_14", "_e12": f"{p}_ema_12"}))
    d = S.asof_join(S.index_series(bars), sides)
    d = then(d, 3, lambda x, r: {"mtf_1m_vol_ratio": div(b.V, r.mean(b.V, 3, 1))})
    return I.fill_invalid(d, MTF)


MTF = ["mtf_3m_rsi_14", "mtf_3m_ema_12", "mtf_15m_rsi_14", "mtf_15m_ema_12", "mtf_1m_vol_ratio"]
for _p, _iv in (("m3", "1 hour"), ("m15", "4 hours")):
    cte(f"{_p}a", f"""SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d, greatest(coalesce(close - lag(close) OVER w, 0), 0) AS gain,
      greatest(coalesce(lag(close) OVER w - close, 0), 0) AS loss FROM (SELECT symbol,
      time_bucket(INTERVAL '{_iv}', bar_ts - INTERVAL '1 microsecond') + INTERVAL '{_iv}' AS bar_ts, arg_max(close, bar_ts) AS close
      FROM bars GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""", ("bars",))
    rec(f"{_p}e", f"{_p}a", [span("e12", "close", 12)])
    cte(_p, f"SELECT symbol, bar_ts, {RSI['rsi_14']} AS rsi, e12 FROM {_p}a JOIN {_p}e USING (symbol, i)", (f"{_p}a", f"{_p}e"))


@query("mtf_context", f"""SELECT b.symbol, b.bar_ts, round(coalesce(m3.rsi, 0), 6) AS mtf_3m_rsi_14, round(coalesce(m3.e12, 0), 6) AS mtf_3m_ema_12,
  round(coalesce(m15.rsi, 0), 6) AS mtf_15m_rsi_14, round(coalesce(m15.e12, 0), 6) AS mtf_15m_ema_12,
  round(coalesce(b.vr, 0), 6) AS mtf_1m_vol_ratio FROM (SELECT *, volume / nullif({avg('volume', 3, 1)}, 0) AS vr FROM b) b
  ASOF LEFT JOIN m3 ON b.symbol = m3.symbol AND b.bar_ts >= m3.bar_ts ASOF LEFT JOIN m15 ON b.symbol = m15.symbol AND b.bar_ts >= m15.bar_ts""", ("b", "m3", "m15"))
def mtf_context_q(spark, sf):
    return rounded(mtf_context(spark, sf).select("symbol", "bar_ts", *MTF))


# per-bar expressions ------------------------------------------------------------------------------

feature("cyclical_time", lambda s, f: D.bars(s, f).withColumns(R.cyclical_time("bar_ts")),
        {"hour_sin": "sin(2 * pi() * (hour(bar_ts) + minute(bar_ts) / 60.0::DOUBLE) / 24)", "hour_cos": "cos(2 * pi() * (hour(bar_ts) + minute(bar_ts) / 60.0::DOUBLE) / 24)",
         "dow_sin": "sin(2 * pi() * (isodow(bar_ts) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(bar_ts) - 1) / 7)"}, "bars")
feature("round_proximity", lambda s, f: D.bars(s, f).withColumns({
    f"round_{n}_prox": F.abs(b.C * 100 - half_even(b.C * 100 / n) * n) / (b.C * 100 + EPS) for n in (1000, 500)}),
    {f"round_{n}_prox": f"abs(close * 100 - round_even(close * 100 / {n}, 0) * {n}) / (close * 100 + 1e-9)" for n in (1000, 500)}, "bars")


def atr_scaled(spark, sf):
    d = scanned(spark, sf, [S.ema("atr_e", "_tr0", 14)])
    a = F.col("atr_e") + EPS
    up, dn = (b.H - F.greatest(b.O, b.C)) / a, (F.least(b.O, b.C) - b.L) / a
    return d.withColumns({"body": F.abs(b.C - b.O) / a, "body_dir": (b.C - b.O) / a, "wick_up": up, "wick_dn": dn, "wick_asym": up - dn, "bull_bar": flag(b.C > b.O)})


A = "(atr_e + 1e-9)"
feature("candle_atr_scaled", atr_scaled, {"body": f"abs(close - open) / {A}", "body_dir": f"(close - open) / {A}", "wick_up": f"(high - greatest(open, close)) / {A}",
                                          "wick_dn": f"(least(open, close) - low) / {A}",
                                          "wick_asym": f"(high - greatest(open, close)) / {A} - (least(open, close) - low) / {A}", "!bull_bar": b01("close > open")}, "xw")


def candle_ratios(spark, sf):
    rng, eps = b.H - b.L, b.H - b.L + EPS
    top, bot = F.greatest(b.O, b.C), F.least(b.O, b.C)
    return D.bars(spark, sf).withColumns({
        "signed_body": div(b.C - b.O, rng), "signed_upper": div(b.H - top, rng), "signed_lower": div(bot - b.L, rng), "cdl_body_direction": F.signum(b.C - b.O),
        "cdl_body_ratio": F.abs(b.C - b.O) / eps, "cdl_upper_wick": (b.H - top) / eps, "cdl_lower_wick": (bot - b.L) / eps})


feature("candle_ratios", candle_ratios, {
    "signed_body": "(close - open) / nullif(high - low, 0)", "signed_upper": "(high - greatest(open, close)) / nullif(high - low, 0)",
    "signed_lower": "(least(open, close) - low) / nullif(high - low, 0)", "cdl_body_direction": "sign(close - open)::DOUBLE",
    "cdl_body_ratio": "abs(close - open) / (high - low + 1e-9)", "cdl_upper_wick": "(high - greatest(open, close)) / (high - low + 1e-9)",
    "cdl_lower_wick": "(least(open, close) - low) / (high - low + 1e-9)"}, "bars")


def legacy(spark, sf):
    from barflow.operators.legacy import legacy_features
    return legacy_features(D.indexed(spark, sf))


def cnt(n, then_, else_):
    return f"CASE WHEN i >= {n - 1} THEN {then_} ELSE {else_} END"


def lmean(n):
    return avg("close", n, 1)


SDP = agg("stddev_pop", "close", 20, 1)
LG = {"rsi_14": f"CASE WHEN i = 0 OR coalesce({agg('avg', 'CASE WHEN i > 0 THEN loss END', 14, 1)}, 0) = 0 THEN 100 ELSE 100 - 100 / (1 + {agg('avg', 'CASE WHEN i > 0 THEN gain END', 14, 1)} / {agg('avg', 'CASE WHEN i > 0 THEN loss END', 14, 1)}) END",
      "bb_upper": cnt(20, f"{lmean(20)} + 2 * {SDP}", "close"), "bb_lower": cnt(20, f"{lmean(20)} - 2 * {SDP}", "close"),
      "volatility": cnt(20, f"coalesce({agg('stddev_pop', 'ret', 19, 1)}, 0) * 100", "0"),
      "stochastic_k_14": cnt(14, f"coalesce({STOCH['stochastic_k_14']}, 50)", "50"), "williams_r_14": cnt(14, f"coalesce({STOCH['williams_r_14']}, -50)", "-50"),
      "cci_20": cnt(20, f"coalesce({CCI}, 0)", "0"), "aroon_up": f"coalesce({AROON['aroon_up']}, 50)", "aroon_down": f"coalesce({AROON['aroon_down']}, 50)",
      "atr_14": cnt(15, avg("tr", 14, 1), "0"), "macd": cnt(26, "macd", "0"), "macd_signal": cnt(26, "macd_signal", "0"),
      "adx_14": cnt(15, f"coalesce(100 * abs({avg('pdm', 14, 1)} - {avg('mdm', 14, 1)}) / nullif({avg('pdm', 14, 1)} + {avg('mdm', 14, 1)}, 0), 0)", "0"),
      "obv": "obv + first_value(volume) OVER (PARTITION BY symbol ORDER BY i)",
      "chaikin_oscillator": cnt(10, f"({avg('ad', 3, 1, 7)}) - ({avg('ad', 10, 1)})", "0"),
      "log_returns": "coalesce(CASE WHEN pc > 0 THEN ln(close / pc) * 100 END, 0)", "volume_change_pct": f"coalesce((volume - {lag('volume')}) / nullif({lag('volume')}, 0) * 100, 0)",
      "high_low_ratio": "CASE WHEN low > 0 THEN high / low ELSE 1 END", "returns_1": "coalesce(CASE WHEN pc > 0 THEN (close - pc) / pc * 100 END, 0)"}
feature("legacy_features", legacy, LG, "xall", 9)
