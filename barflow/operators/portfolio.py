"""Trades, positions, equity and risk as aggregates and running scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.functions import futures as X
from barflow.functions.columns import clip, col, div, reasons
from barflow.operators.series import framed, range_bins, running, time_bins
from barflow.session import stage

MONTH = 30 * 86_400


def summary(positions: DataFrame, fx: float, leverage: int, initial: float, keys=()) -> DataFrame:
    """Open exposure and realised result in one pass, converted at one rate; free balance floored at 0."""
    is_open, is_closed = F.col("status") == "OPEN", F.col("status") == "CLOSED"
    pnl = X.gross_pnl("entry_price", F.coalesce("current_price", "entry_price"), "quantity", "side")
    margin = X.notional("quantity", "entry_price") / leverage
    zero = F.lit(0.0)
    a = positions.groupBy(*keys).agg(
        F.count_if(is_open).alias("open_positions"), F.coalesce(F.sum(F.when(is_open, pnl)), zero).alias("unrealized"),
        F.coalesce(F.sum(F.when(is_open, margin)), zero).alias("margin"), F.coalesce(F.sum(F.when(is_closed, F.col("realized_pnl"))), zero).alias("realized"))
    return a.withColumns({"available": F.greatest(zero, initial + (F.col("realized") - F.col("margin")) * fx),
                          "total_value": initial + (F.col("unrealized") + F.col("realized")) * fx})


def closed_trades(positions: DataFrame, fx: float) -> DataFrame:
    """Closed rows with converted pnl, exit price fallback and a duration that is never negative."""
    seconds = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / F.lit(1e6)
    return positions.filter(F.col("status") == "CLOSED").select(
        F.concat(F.lit("closed_"), "trade_id").alias("trade_id"), "symbol", "side", "quantity", "entry_price",
        F.coalesce("current_price", "entry_price").alias("exit_price"), F.col("realized_pnl").alias("pnl_usd"), (F.col("realized_pnl") * fx).alias("pnl"),
        F.col("opened_at").alias("entry_time"), F.coalesce("closed_at", "opened_at").alias("exit_time"),
        F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0.0)))).alias("duration_seconds"))


def page(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    """Newest rows first, one page (a top-k report)."""
    return df.orderBy(*[F.col(o).desc() for o in order]).offset(offset).limit(limit)


def pnl_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    win = F.count_if(F.col("pnl") > 0)
    return df.agg(n.alias("trades"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total"), win.alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"),
                  F.coalesce(div(win, n), F.lit(0.0)).alias("win_rate"))


def equity_curve(daily: DataFrame, initial: float, keys, ts: str = "ts", pnl: str = "pnl") -> DataFrame:
    """Running equity, its peak and drawdown per key, from pre-summed steps."""
    d = running(daily, {"_e": ("sum", pnl)}, keys, (ts,), time_bins(ts, MONTH)).withColumn("equity", F.col("_e") + initial).drop("_e")
    d = running(d, {"peak": ("max", "equity")}, keys, (ts,), time_bins(ts, MONTH))
    return d.withColumn("drawdown", div("equity", "peak") - 1)


def equity_metrics(curve: DataFrame, keys, ts: str = "ts", step_seconds: int = 3600, periods: float = 8760.0) -> DataFrame:
    """Sharpe and Sortino of an equity table resampled to a fixed step with forward fill.

    Steps without a point have return 0, so the moments come from the points and the number of steps;
    the grid is never built. ``curve`` is indexed (bar_idx) with at most one point per step.
    """
    width = step_seconds * 1_000_000
    d = framed(curve, lambda x, r: x.withColumn("_r", div("equity", r.lag("equity")) - 1), before=1, keys=keys)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    n = ((F.max(at) - F.min(at)) / F.lit(width))
    low = F.when(F.col("_r") < 0, F.col("_r"))
    a = d.groupBy(*keys).agg(n.alias("_n"), F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_q"), F.count(low).alias("_ln"), F.stddev_samp(low).alias("_ld"),
                             F.min("drawdown").alias("max_drawdown"), F.min_by("equity", ts).alias("_first"), F.max_by("equity", ts).alias("_last"))
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt((F.col("_q") - F.col("_n") * mean * mean) / (F.col("_n") - 1))
    k = math.sqrt(periods)
    return a.select(*keys, (mean / (sd + 1e-9) * k).alias("sharpe"), F.when(F.col("_ln") > 2, mean / (F.col("_ld") + 1e-9) * k).otherwise(0.0).alias("sortino"),
                    "max_drawdown", (div("_last", "_first") - 1).alias("total_return"))


def bar_metrics(curve: DataFrame, keys, periods: float = 252.0) -> DataFrame:
    """Sharpe over the points themselves, cumulative return and maximum drawdown."""
    d = framed(curve, lambda x, r: x.withColumn("_r", div("equity", r.lag("equity")) - 1), before=1, keys=keys)
    return d.groupBy(*keys).agg((F.avg("_r") / (F.stddev_samp("_r") + 1e-9) * math.sqrt(periods)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
                                (div(F.max_by("equity", "bar_idx"), F.min_by("equity", "bar_idx")) - 1).alias("cum_return"))


def trade_stats(df: DataFrame, keys, reason: str | None = None, names=()) -> DataFrame:
    p = F.col("pnl")
    win, n = F.count_if(p > 0), F.count(F.lit(1))
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(p <= 0, p)), F.lit(0.0)))
    aw, al = F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)), F.abs(F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)))
    wr = win / n
    exits = [F.count_if(F.col(reason) == x).alias(f"exit_{x}") for x in names]
    return df.groupBy(*keys).agg(n.alias("trades"), wr.alias("win_rate"), div(gain, loss).alias("profit_factor"), (wr * aw - (1 - wr) * al).alias("expectancy"), *exits)


def growth(df: DataFrame, ret: str, keys, order=("bar_idx",)) -> DataFrame:
    """Running product of 1 + return."""
    d = running(df, {"_g": ("sum", F.log1p(F.coalesce(F.col(ret), F.lit(0.0))))}, keys, order)
    return d.withColumn("growth", F.exp("_g")).drop("_g")


def impact(d: DataFrame) -> DataFrame:
    pnl = X.gross_pnl("entry_price", "current_price", "quantity", "side")
    share = div(F.abs(pnl), X.notional("quantity", "entry_price"))
    level = F.when(share > 0.10, 3).when(share > 0.05, 2).when(share > 0.02, 1).otherwise(0)
    stop = F.coalesce(((F.col("side") == "BUY") & (F.col("current_price") <= F.col("stop_loss"))) | ((F.col("side") == "SELL") & (F.col("current_price") >= F.col("stop_loss"))), F.lit(False))
    return d.withColumns({"pnl_change": pnl, "pnl_percent": share, "risk_ord": level, "stop_breached": stop}).withColumn("risk_level", risk_name(F.col("risk_ord")))


def risk_name(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), n + 1)


def impact_rollup(d: DataFrame, keys=()) -> DataFrame:
    return d.groupBy(*keys).agg(F.sum("pnl_change").alias("total_pnl"), risk_name(F.max("risk_ord")).alias("risk_level"), F.bool_or("stop_breached").alias("any_stop"), F.count(F.lit(1)).alias("positions"))


def return_on_margin(unrealized, margin) -> Column:
    m, u = col(margin), col(unrealized)
    return F.when((m > 0) & ~F.isnan(m) & (m != float("inf")), div(u, m))


def risk_score(positions: DataFrame, account: DataFrame, keys, max_drawdown=0.15, max_leverage=5.0, max_open=5) -> DataFrame:
    """Additive score from drawdown, leverage, open positions and concentration."""
    value = F.col("entry_price") * F.col("quantity")
    p = positions.groupBy(*keys).agg(F.sum(value).alias("exposure"), F.max(value).alias("_big"), F.sum("pnl").alias("_u"), F.count(F.lit(1)).alias("open_positions"))
    d = account.join(p, list(keys), "left").fillna(0, ["exposure", "_big", "_u", "open_positions"])
    total = F.col("cash") + F.col("exposure") + F.col("_u")
    d = d.withColumns({"leverage": F.when(F.col("cash") > 0, div("exposure", "cash")).otherwise(float("inf")),
                       "drawdown": F.when(F.greatest("peak", total) > 0, div(F.greatest("peak", total) - total, F.greatest("peak", total))).otherwise(0.0)})
    band = lambda x, lim, hi, lo, f: F.when(x > lim, hi).when(x > lim * f, lo).otherwise(0.0)
    open_ = F.col("open_positions")
    score = (band(F.col("drawdown"), max_drawdown, 0.4, 0.2, 0.7) + band(F.col("leverage"), max_leverage, 0.3, 0.15, 0.8)
             + F.when(open_ >= max_open, 0.2).when(open_ > max_open * 0.8, 0.1).otherwise(0.0) + F.when(div("_big", "exposure") > 0.5, 0.15).otherwise(0.0))
    return d.select(*keys, "exposure", "leverage", "drawdown", "open_positions", F.least(F.lit(1.0), score).alias("risk_score"), (open_ < max_open).alias("can_trade"))


def trade_sharpe(df: DataFrame, keys, free: float = 0.02) -> DataFrame:
    r = F.when(F.col("value") > 0, div("pnl", "value"))
    n, m, s = F.count(r), F.avg(r), F.stddev_samp(r)
    inf = float("inf")
    out = F.when(n < 2, F.when(n == 0, 0.0).otherwise(F.when(m > 0, inf).otherwise(-inf))).when(s == 0, F.when(m > 0, inf).otherwise(-inf)).otherwise(div(m - free, s))
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(out).alias("sharpe"))


def allocation(df: DataFrame, keys, risk_level: Column, slots: int) -> DataFrame:
    """Share by |prediction|, scaled by risk, cut to the largest ``slots`` and renormalised only when cut."""
    w = Window.partitionBy(*keys)
    n, strength = F.count(F.lit(1)).over(w), F.sum(F.abs("prediction")).over(w)
    d = df.withColumns({"_n": n, "_a": F.when(strength == 0, 1.0 / n).otherwise(div(F.abs("prediction"), strength)) * F.when(risk_level == "high", 0.6).when(risk_level == "critical", 0.3).otherwise(1.0)})
    d = d.withColumn("_rk", F.row_number().over(w.orderBy(F.desc("_a"), "symbol"))).filter(F.col("_rk") <= slots)
    kept = F.sum("_a").over(w)
    return d.withColumn("allocation", F.when((F.col("_n") > slots) & (kept > 0), div("_a", kept)).otherwise(F.col("_a"))).drop("_n", "_a", "_rk")


def daily_breach(df: DataFrame, keys, limit: float, value: float, open_positions: DataFrame, max_open: int) -> DataFrame:
    d = df.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("daily_pnl"))
    d = d.join(open_positions, list(keys), "left")
    found = reasons((F.col("daily_pnl") < -limit * value, "daily_loss_limit"), (F.coalesce("open_positions", F.lit(0)) >= max_open, "max_open_positions"))
    return d.select(*keys, "day", "daily_pnl", found.alias("breaches"))


def running_performance(df: DataFrame, keys, initial: float, order=("ts", "trade_id")) -> DataFrame:
    """Counters after every trade: count, pnl, win rate, value, worst single-step loss share so far."""
    df, bins = range_bins(df, keys, order, "_rb"), F.col("_rb")
    d = running(df, {"trades": ("count", F.lit(1)), "total_pnl": ("sum", "pnl"), "_w": ("count", F.when(F.col("pnl") > 0, 1))}, keys, order, bins)
    d = d.withColumn("portfolio_value", initial + F.col("total_pnl"))
    before = F.col("portfolio_value") - F.col("pnl")
    d = d.withColumn("_l", F.when(F.col("pnl") < 0, div(-F.col("pnl"), before)).otherwise(0.0))
    d = running(stage(d), {"_m": ("max", "_l")}, keys, order, bins)
    return d.withColumns({"win_rate": F.col("_w") / F.col("trades"), "max_drawdown": F.greatest("_m", F.lit(0.0))}).drop("_w", "_l", "_m", "_rb")


def trailing_stop(bars: DataFrame, keys, mult: float, side: Column, atr: str = "atr", price: str = "close", order=("bar_idx",)) -> DataFrame:
    """Ratcheted stop since entry: highest (price - k*ATR) of a long, lowest (price + k*ATR) of a short."""
    level = F.when(side == "long", F.col(price) - mult * F.col(atr)).otherwise(-(F.col(price) + mult * F.col(atr)))
    d = running(bars, {"_s": ("max", level)}, keys, order)
    return d.withColumn("stop", F.when(side == "long", F.col("_s")).otherwise(-F.col("_s"))).drop("_s")


def trailing_stops(bars: DataFrame, keys, mult: float, atr: str = "atr", price: str = "close", order=("bar_idx",)) -> DataFrame:
    """long_stop and short_stop since entry, both levels in one running pass."""
    reach = mult * F.col(atr)
    return running(bars, {"long_stop": ("max", F.col(price) - reach), "short_stop": ("min", F.col(price) + reach)}, keys, order)


def decision_patterns(df: DataFrame) -> DataFrame:
    """Counts and success per signal; the row with a NULL signal is the total."""
    known = F.col("pnl").isNotNull()
    good = F.count_if(known & (F.col("pnl") > 0))
    return df.rollup("signal").agg(F.count(F.lit(1)).alias("count"), good.alias("profitable"), F.count_if(known & (F.col("pnl") <= 0)).alias("unprofitable"), F.count_if(~known).alias("unknown"),
                                   F.coalesce(div(good, F.count_if(known)), F.lit(0.0)).alias("success_rate"))


def context_stats(df: DataFrame) -> DataFrame:
    return df.rollup("symbol").agg(F.count(F.lit(1)).alias("contexts"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.avg(F.col("pnl").isNotNull().cast("double")).alias("outcome_share"))


def health_score(df: DataFrame, keys=()) -> DataFrame:
    state = F.when(F.col("state") == "up", 1.0).when(F.col("state") == "degraded", 0.5).otherwise(0.0)
    d = df.groupBy(*keys).agg(F.sum(F.col("weight") * state).alias("score"))
    return d.withColumn("status", F.when(F.col("score") >= 0.9, "healthy").when(F.col("score") >= 0.6, "degraded").otherwise("unhealthy"))
