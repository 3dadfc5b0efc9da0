"""Contract arithmetic of perpetual futures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow.functions.columns import clip, col, div, half_even

# Size of one contract and the maintenance margin.
CONTRACT_VALUE = 0.001
MAINTENANCE = 0.0025


def normal_side(side: Column) -> Column:
    """BUY / SELL; NULL counts as BUY, unknown text gives NULL."""
    s = F.upper(F.trim(side))
    return (F.when(side.isNull(), "BUY").when(s.isin("BUY", "LONG"), "BUY").when(s.isin("SELL", "SHORT"), "SELL"))


def direction(side: Column) -> Column:
    return F.when(F.lower(side).isin("short", "sell"), -1.0).otherwise(1.0)


def notional(lots, price, cv=CONTRACT_VALUE) -> Column:
    return col(lots) * col(price) * cv


def gross_pnl(entry, exit_, lots, side, cv=CONTRACT_VALUE) -> Column:
    return direction(col(side)) * (col(exit_) - col(entry)) * col(lots) * cv


def leg_rate(taker: float, slip_bps: float) -> float:
    return taker + slip_bps / 10_000.0


def liquidation_price(entry, leverage, side, mm=MAINTENANCE) -> Column:
    e, gap = col(entry), div(F.lit(1.0), leverage) - mm
    return F.when(F.lower(col(side)) == "long", e * (1 - gap)).otherwise(e * (1 + gap))


def lots_for_margin(margin, price, leverage, cv=CONTRACT_VALUE, max_lots=100, min_lots=1) -> Column:
    value = col(price) * cv
    raw = F.floor(div(col(margin) * col(leverage), value))
    return F.when(value > 0, F.greatest(F.lit(min_lots), F.least(F.lit(max_lots), raw))).otherwise(0).cast("int")


def to_tick(price, tick: float = 0.5) -> Column:
    p = col(price)
    return p if tick <= 0 else half_even(half_even(p / tick) * tick, 2)


def fee_adjusted_pnl(entry, exit_, lots, side, fee, funding, cv=CONTRACT_VALUE) -> Column:
    n = notional(lots, entry, cv)
    return gross_pnl(entry, exit_, lots, side, cv) - 2 * fee * n - col(funding) * n


def margin_second_currency(lots, price, fx, leverage, cv=CONTRACT_VALUE) -> Column:
    ok = (col(lots) > 0) & (col(price) > 0) & (col(fx) > 0) & (col(leverage) > 0)
    return F.when(ok, div(notional(lots, price, cv), leverage) * col(fx)).otherwise(0.0)


def stop_target(entry, side, sl_pct, tp_pct, atr=None, sl_mult=1.0, tp_mult=1.5, tick: float | None = None):
    """Absolute stop and target: the wider of percent and ATR distance if an ATR is given, else percent."""
    e, s, sl, tp = col(entry), normal_side(col(side)), col(sl_pct), col(tp_pct)
    d = F.when(s == "BUY", 1.0).when(s == "SELL", -1.0)
    fixed = [F.when(p != 0, e * p) for p in (sl, tp)]
    if atr is None:
        sd, td = fixed
    else:
        a = col(atr)
        sd = F.when(a > 0, F.greatest(e * sl, a * sl_mult)).otherwise(fixed[0])
        td = F.when(a > 0, F.greatest(e * tp, a * tp_mult)).otherwise(fixed[1])
    stop, goal = F.when(e > 0, e - d * sd), F.when(e > 0, e + d * td)
    return (to_tick(stop, tick), to_tick(goal, tick)) if tick else (stop, goal)


def rebase(level, planned, fill, tick: float | None = None) -> Column:
    moved = F.when(col(planned) > 0, col(level) + (col(fill) - col(planned))).otherwise(col(level))
    return to_tick(moved, tick) if tick else moved


def kelly(strength, confidence, win_rate, avg_win, avg_loss, balance_share, cap: float = 0.1) -> Column:
    """Quarter Kelly scaled by signal and confidence, capped, and limited by the free balance."""
    w, l = col(win_rate), col(avg_loss)
    k = F.when(l > 0, div(w * col(avg_win) - (1 - w) * l, l)).otherwise(0.0)
    size = F.least(k * 0.25 * F.abs(col(strength)) * col(confidence), F.lit(cap))
    size = F.when(size > col(balance_share), col(balance_share)).otherwise(size)
    return F.greatest(F.lit(0.0), F.least(size, F.lit(cap)))


def futures_size(price, confidence, funding, volatility, cash, default_lev=5, min_lev=1, max_lev=20, cap=0.1, floor=0.01):
    """Leverage, margin, lots and liquidation prices from confidence, funding and volatility."""
    base = clip(col(confidence), 0.0, 1.0)
    pen = F.when(F.abs(col(funding)) > 0.0003, 0.5).otherwise(1.0)
    lev = F.greatest(F.lit(min_lev), F.least(F.lit(max_lev), half_even(default_lev * base * pen).cast("int")))
    mult = F.when(col(volatility) > 0.05, 0.5).when(col(volatility) > 0.03, 0.7).otherwise(1.0)
    share = F.greatest(F.lit(floor), F.least(cap * base * mult * pen, F.lit(cap)))
    margin = col(cash) * share
    lots = lots_for_margin(margin, price, lev)
    return {"leverage": lev, "margin": margin, "lots": lots, "notional": notional(lots, price),
            "liq_long": liquidation_price(price, lev, F.lit("long")), "liq_short": liquidation_price(price, lev, F.lit("short")), "size": share}


def imbalance(bid, ask) -> Column:
    return F.coalesce(div(col(bid) - col(ask), col(bid) + col(ask)), F.lit(0.0))
