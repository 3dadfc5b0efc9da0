"""Rules that turn scores and features into signals; all are column expressions over tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import clip, col, div, pick, reasons

CONTEXT_SCHEMA = ("struct<entry_signal:double,entry_confidence:double,entry_proba:struct<sell:double,hold:double,buy:double>,"
                  "format:string,timeframe:string>")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the two-timeframe rule. Fixed values are the defaults in use."""

    trend_edge: float = 0.05
    entry_edge: float = 0.08
    trend_signal: float = 0.10
    entry_signal: float = 0.15
    min_confidence: float = 0.6
    probability_floor: float = 0.0
    min_gap: float = 0.0
    strong_edge: float = 0.15
    strong_confidence: float = 0.72
    filter_band: float = 0.05
    trend_order: tuple = ("15m",)
    entry_order: tuple = ("5m",)
    filter_tf: str = "3m"
    frames: tuple = field(default=("15m", "3m", "5m"))


def model_timeframe(name: Column) -> Column:
    """Timeframe suffix of a model name, NULL without one."""
    tf = F.lower(F.regexp_extract(name, r"(?i)_\s*(\d+[mhdw])\s*$", 1))
    return F.when(tf != "", tf)


def extract(df: DataFrame, context: str = "context") -> DataFrame:
    """Signal, confidence and probabilities from a JSON context, falling back to the row's own fields."""
    d = df.withColumn("_c", F.from_json(context, CONTEXT_SCHEMA))
    p = F.col("_c.entry_proba")
    whole = p["sell"].isNotNull() & p["hold"].isNotNull() & p["buy"].isNotNull()
    return d.withColumns({
        "signal": F.coalesce("_c.entry_signal", "prediction", F.lit(0.0)),
        "conf": clip(F.coalesce("_c.entry_confidence", "confidence", F.lit(0.0)), 0.0, 1.0),
        "buy": F.when(whole, p["buy"]), "sell": F.when(whole, p["sell"]), "hold": F.when(whole, p["hold"])}).drop("_c")


def by_timeframe(df: DataFrame, keys, order: str, frames) -> DataFrame:
    """One struct column per timeframe, the latest prediction of each; aggregates map-side."""
    fields = ("signal", "conf", "buy", "sell")
    at = {t: F.when(F.col("tf") == t, F.col(order)) for t in frames}
    flat = df.groupBy(*keys).agg(*[F.max_by(f, at[t]).alias(f"_{t}_{f}") for t in frames for f in fields], *[F.max(at[t]).alias(f"_{t}") for t in frames])
    return flat.select(*keys, *[F.when(F.col(f"_{t}").isNotNull(), F.struct(*[F.col(f"_{t}_{f}").alias(f) for f in fields])).alias(f"tf_{t}") for t in frames])


def _first(frames_col, order, fallback) -> Column:
    return F.coalesce(*[F.col(f"tf_{t}") for t in (*order, *fallback) if f"tf_{t}" in frames_col])


def two_timeframe(wide: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Signal, reason and confidence per row of ``by_timeframe``; rows without any timeframe are dropped."""
    have = wide.columns
    names = sorted(rules.frames)
    d = wide.withColumns({"_t": _first(have, rules.trend_order, reversed(names)), "_e": _first(have, rules.entry_order, names),
                          "_f": F.col(f"tf_{rules.filter_tf}")}).filter(F.col("_t").isNotNull())
    t, e, f = F.col("_t"), F.col("_e"), F.col("_f")
    proba = t["buy"].isNotNull() & e["buy"].isNotNull()
    gap, tdiff, conf, sig = e["buy"] - e["sell"], t["buy"] - t["sell"], e["conf"], e["signal"]
    trend = F.when(proba, F.when(tdiff >= rules.trend_edge, 1).when(-tdiff >= rules.trend_edge, -1).otherwise(0)).otherwise(
        F.when(t["signal"] > rules.trend_signal, 1).when(t["signal"] < -rules.trend_signal, -1).otherwise(0))
    d = d.withColumn("_tr", trend)
    tr = F.col("_tr")
    edge, low = tr * gap, F.greatest(e["buy"], e["sell"]) < rules.probability_floor
    veto = (tr * sig > rules.entry_signal) & (tr * f["signal"] < -rules.filter_band)
    holds = [
        (proba & (rules.min_gap > 0) & (F.abs(gap) < rules.min_gap), "gap_below_minimum", F.greatest(F.lit(0.0), conf * 0.25)),
        (proba & (tr == 0), "trend_edge_small", F.greatest(F.lit(0.0), conf * 0.3)),
        (~proba & (tr == 0), "trend_neutral", F.greatest(F.lit(0.0), conf * 0.3)),
        (F.coalesce(veto, F.lit(False)), "filter_conflict", conf * 0.4),
        (tr * sig <= 0, "not_aligned", F.lit(0.0)),
        (proba & (conf < rules.min_confidence), "low_confidence", F.lit(0.0)),
        (proba & (edge < rules.entry_edge), "entry_edge_small", F.lit(0.0)),
        (proba & (rules.probability_floor > 0) & low, "probability_floor", F.lit(0.0)),
        (~proba & ((tr * sig <= rules.entry_signal) | (conf < rules.min_confidence)), "entry_not_confirming", F.lit(0.0)),
    ]
    strong = F.when(proba, (edge >= rules.strong_edge) & (conf >= rules.strong_confidence)).otherwise((tr * sig > 0.45) & (conf >= 0.72))
    side = F.when(tr > 0, "BUY").otherwise("SELL")
    reason = pick(*[(c, F.lit(n)) for c, n, _ in holds], default=F.lit("aligned"))
    return d.withColumns({
        "reason": reason, "decision_confidence": pick(*[(c, v) for c, _, v in holds], default=conf),
        "decision": F.when(reason != "aligned", "HOLD").when(strong, F.concat(F.lit("STRONG_"), side)).otherwise(side)}).drop("_tr", "_t", "_e", "_f")


def short_timeframe(buy: Column, sell: Column, conf: Column, dead=0.05, edge=0.08, strong_long=0.55, strong_short=0.58) -> dict[str, Column]:
    raw = buy - sell
    signal = (F.when(F.abs(raw) < dead, "HOLD").when(raw > edge, F.when(buy >= strong_long, "STRONG_BUY").otherwise("BUY"))
              .when(raw < -edge, F.when(sell >= strong_short, "STRONG_SELL").otherwise("SELL")).otherwise("HOLD"))
    out = F.when(F.abs(raw) < dead, conf * 0.2).when(F.abs(raw) > edge, conf).otherwise(conf * 0.25)
    return {"decision": signal, "decision_confidence": out}


def context_multiplier(signal: Column, buy: Column, sell: Column, edge=0.02, boost=1.15, cut=0.75) -> Column:
    d = F.when(signal.isin("BUY", "STRONG_BUY"), 1.0).when(signal.isin("SELL", "STRONG_SELL"), -1.0)
    agree = d * (buy - sell)
    m = F.when(agree >= edge, boost).when(agree <= -edge, cut).otherwise(1.0)
    return F.when(d.isNull() | buy.isNull() | sell.isNull(), 1.0).otherwise(clip(m, 0.25, 1.5))


def edge_entry(edge, threshold, atr_pct, adx, floor=0.15, atr_floor=0.0005, adx_max=25.0, leg_cost=0.001, ratio=2.0) -> Column:
    """BUY / SELL / HOLD of a signed edge; a missing ATR or ADX passes its filter."""
    e = col(edge)
    ok = F.coalesce(col(atr_pct) >= atr_floor, F.lit(True)) & F.coalesce(col(adx) <= adx_max, F.lit(True)) & (F.abs(e) >= leg_cost * ratio)
    return (F.when(~ok, "HOLD").when((e >= col(threshold)) & (e >= floor), "BUY")
            .when((e <= -col(threshold)) & (e <= -floor), "SELL").otherwise("HOLD"))


def edge_gate(signal: Column, rule: Column) -> Column:
    """Keep a signal only if the edge rule agrees; HOLD stays HOLD."""
    agree = (signal.isin("BUY", "STRONG_BUY") & (rule == "BUY")) | (signal.isin("SELL", "STRONG_SELL") & (rule == "SELL"))
    return F.when(agree, signal).otherwise("HOLD")


def primary_prediction(df: DataFrame, keys) -> DataFrame:
    """Strongest |edge| per decision among the models of the edge format."""
    d = df.filter(F.col("format") == "v15_pipeline")
    best = F.max_by(F.struct("edge", "tf"), F.struct(F.abs("edge"), "rank")).alias("_b")
    return d.groupBy(*keys).agg(best).select(*keys, "_b.*")


def ensemble_edge(reg, p_buy, p_sell) -> Column:
    d, r = col(p_buy) - col(p_sell), col(reg)
    return F.when((r > 0) & (d > 0) | (r < 0) & (d < 0), F.abs(r) * d).otherwise(0.0)


# Class weights of the focal weighting.
CLASS_WEIGHTS = {0: 1.4, 1: 0.4, 2: 1.4}


def sample_weight(edge, label, min_edge: float, weights=CLASS_WEIGHTS, gamma: float = 1.5) -> Column:
    table = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
    size = clip(F.pow(F.abs(col(edge)) / (min_edge + 1e-12), F.lit(gamma)), 0.3, 6.0)
    return size * F.coalesce(table[col(label)], F.lit(1.0))


def round_trip_cost(atr_pct, fee: float, spread_bps: float, slip_bps: float, vol_coef: float) -> Column:
    return F.lit(fee + (2 * spread_bps + 2 * slip_bps) / 10_000.0) + 2 * vol_coef * col(atr_pct)


def rr_gate(sl_pct, tp_pct, minimum: float = 1.2) -> Column:
    s, t = col(sl_pct), col(tp_pct)
    return F.when((s <= 0) | (t <= 0), True).otherwise(div(t, s) >= minimum)


def score_normalize(kind: Column, buy, sell, raw, price, forecast, midpoint: float = 0.5) -> Column:
    m = max(0.01, min(0.99, midpoint))
    binary = F.when(col(raw) >= m, (col(raw) - m) / (1 - m)).otherwise((col(raw) - m) / m)
    return (F.when(kind == "three_class", col(buy) - col(sell)).when(kind == "binary", binary)
            .otherwise(F.tanh(div(col(forecast) - col(price), price) / 0.10)))


def discrete_signal(x) -> Column:
    return F.when(col(x) > 0.3, "BUY").when(col(x) < -0.3, "SELL").otherwise("HOLD")


def perp_regime(funding, spike, basis_pct, long_sq, short_sq, ob) -> dict[str, Column]:
    f, s, p = col(funding), col(spike), col(basis_pct)
    regime = pick(((f > 0.0003) & (s > 0), F.lit("overheated_long")), ((f < -0.0002) & (s > 0), F.lit("overheated_short")),
                  (p > 0.002, F.lit("contango_heavy")), (p < -0.002, F.lit("backwardation")), default=F.lit("neutral"))
    notes = reasons((F.greatest(col(long_sq), col(short_sq)) > 0, "squeeze"), (F.abs(col(ob)) > 0.2, "book_pressure"), (F.abs(f) > 0.0005, "funding_cost"))
    return {"perp_regime": regime, "squeeze_side": F.when(col(long_sq) > col(short_sq), "long").otherwise("short"), "notes": notes}


def market_flags(rsi, volatility, high: float = 5.0, low: float = 2.0) -> Column:
    r, v = col(rsi), col(volatility)
    return reasons((r > 70, "overbought"), (r < 30, "oversold"), (v > high, "high_volatility"), (v < low, "low_volatility"))


def hold_band(consensus, volatility, margin) -> Column:
    """Five-way signal; bands depend on volatility and narrow when class margins are wide."""
    v, m, c = col(volatility), F.coalesce(col(margin), F.lit(0.0)), col(consensus)
    strong = F.when(v > 5, 0.45).when(v < 1.5, 0.35).otherwise(0.40)
    mild = F.when(v > 5, 0.20).when(v < 1.5, 0.15).otherwise(0.18)
    strong = F.when(m >= 0.18, F.greatest(F.lit(0.30), strong - 0.03)).when(m >= 0.12, F.greatest(F.lit(0.32), strong - 0.02)).otherwise(strong)
    mild = F.when(m >= 0.18, F.greatest(F.lit(0.10), mild - 0.02)).when(m >= 0.12, F.greatest(F.lit(0.11), mild - 0.01)).otherwise(mild)
    return pick((c > strong, F.lit("STRONG_BUY")), (c > mild, F.lit("BUY")), (c < -strong, F.lit("STRONG_SELL")), (c < -mild, F.lit("SELL")), default=F.lit("HOLD"))


@dataclass(frozen=True)
class EntryLimits:
    """Limits of the stateless entry checks. Fixed values are the defaults in use."""

    max_age: float = 45.0
    min_confidence: float = 0.52
    min_volatility: float = 0.0
    min_atr_pct: float = 0.0
    min_reward: float = 1.2
    adx_floor: float = 20.0
    bb_cap: float = 0.92
    strength_cap: float = 0.7
    breakout_floor: float = 0.0


def reject_reason(lim: EntryLimits = EntryLimits()) -> Column:
    """First failing stateless check in order, NULL if all pass. Missing optional features pass."""
    c = F.col
    buy, sell = c("signal").isin("BUY", "STRONG_BUY"), c("signal").isin("SELL", "STRONG_SELL")
    held_long, held_short = c("open_side") == "long", c("open_side") == "short"
    checks = [
        (c("signal").isNull() | (c("signal") == "HOLD"), "hold"),
        (c("age_seconds") > lim.max_age, "stale"),
        (c("edge_signal") == "HOLD", "edge_gate"),
        (~(buy | sell), "unknown_signal"),
        ((held_long & sell) | (held_short & buy), "reversal_exit"),
        ((held_long & buy) | (held_short & sell), "position_open"),
        (c("confidence") < lim.min_confidence, "low_confidence"),
        (c("price").isNull() | (c("price") <= 0), "no_price"),
        (c("volatility").isNull(), "no_volatility"),
        (F.lit(lim.min_volatility > 0) & (c("volatility") < lim.min_volatility), "low_volatility"),
        (F.lit(lim.min_atr_pct > 0) & (div("atr", "price") < lim.min_atr_pct), "low_atr"),
        ((c("required") <= 0) | (c("cash") < c("required")), "margin"),
        (~c("risk_ok"), "risk"),
        (~rr_gate("sl_pct", "tp_pct", lim.min_reward), "reward"),
        ((buy & (c("trend_15m") < 0)) | (sell & (c("trend_15m") > 0)), "timeframe_conflict"),
        ((c("adx") < lim.adx_floor) & c("signal").isin("BUY", "SELL"), "ranging"),
        ((buy & (c("price") < c("ema_200"))) | (sell & (c("price") > c("ema_200"))), "against_ema200"),
        (buy & (c("bb_position") >= lim.bb_cap), "near_upper_band"),
        (buy & (c("at_resistance") > 0), "at_resistance"),
        (buy & (c("resistance_strength") >= lim.strength_cap), "resistance_strength"),
        (sell & (c("at_support") > 0), "at_support"),
        (sell & (c("support_strength") >= lim.strength_cap), "support_strength"),
        (buy & F.lit(lim.breakout_floor > 0) & (c("breakout_score") < lim.breakout_floor), "signal_filter"),
        (c("lots") < 1, "lots"),
    ]
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in checks])
