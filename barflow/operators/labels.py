"""Forward-outcome labels. Each bar sees its next H bars through a forward row frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import clip, div
from barflow.functions.names import b
from barflow.operators.series import KEYS, Roll, ema_adjusted, framed, scan, Linear


def first_hit(values: Column, test) -> Column:
    """1-based position of the first element passing ``test``; NULL if none does."""
    p = F.array_position(F.transform(values, test), F.lit(True))
    return F.when(p > 0, p)


def _ahead(d: DataFrame, r: Roll, n: int, *cols: str) -> DataFrame:
    return d.withColumns({f"_{c}s": r.ahead(c, n) for c in cols}).withColumn("_full", r.lead("close", n).isNotNull())


def _before(a: Column, z: Column) -> Column:
    """a strictly earlier than z; a missing z is later than everything."""
    return F.coalesce(a.isNotNull() & (z.isNull() | (a < z)), F.lit(False))


def _not_after(a: Column, z: Column) -> Column:
    return F.coalesce(a.isNotNull() & (z.isNull() | (a <= z)), F.lit(False))


def tp_sl(indexed: DataFrame, tp: float, sl: float, horizon: int, fee: float = 0.0, keys=KEYS) -> DataFrame:
    """1 if the target is touched strictly before the stop, 0 if not, -1 without a full window."""

    def build(d, r):
        d = _ahead(d, r, horizon, "high", "low")
        up, down = b.C * (1 + tp + fee), b.C * (1 - sl)
        win = _before(first_hit(F.col("_highs"), lambda v: v >= up), first_hit(F.col("_lows"), lambda v: v <= down))
        return d.withColumn("target", F.when(F.col("_full"), win.cast("int")).otherwise(-1))

    return framed(indexed, build, after=horizon, keys=keys)


def atr_tp_sl(indexed: DataFrame, tp_mult: float, sl_mult: float, horizon: int, period: int = 14, keys=KEYS) -> DataFrame:
    """Levels from a range filter that starts from rest: only row 0 has the full first range."""
    d = framed(indexed, lambda x, r: x.withColumn("_p", r.lag("close")).withColumn(
        "_t", F.greatest(b.H - b.L, F.abs(b.H - F.col("_p")), F.abs(b.L - F.col("_p")))), before=1, keys=keys)
    a = 2.0 / (period + 1)
    d = scan(d, [Linear("_iir", "_t", 1 - a, a)], keys)
    d = d.withColumn("_iir", F.when(b.I == 0, F.col("_t")).otherwise(F.col("_iir")))

    def build(x, r):
        x = _ahead(x, r, horizon, "high", "low")
        up, down = b.C + tp_mult * F.col("_iir"), b.C - sl_mult * F.col("_iir")
        win = _before(first_hit(F.col("_highs"), lambda v: v >= up), first_hit(F.col("_lows"), lambda v: v <= down))
        return x.withColumn("target", F.when(F.col("_full"), win.cast("int")).otherwise(-1))

    return framed(d, build, after=horizon, keys=keys)


def _outcome3(tp: Column, sl: Column) -> Column:
    """2 long wins, 0 short wins, 1 neither; a tie of target and stop is a win, both: earlier target."""
    hi, lo, up, down = F.col("_highs"), F.col("_lows"), b.C * (1 + tp), b.C * (1 - tp)
    lsl, ssl = b.C * (1 - sl), b.C * (1 + sl)
    ltp, stp = first_hit(hi, lambda v: v >= up), first_hit(lo, lambda v: v <= down)
    long_ = _not_after(ltp, first_hit(lo, lambda v: v <= lsl))
    short = _not_after(stp, first_hit(hi, lambda v: v >= ssl))
    return (F.when(long_ & short, F.when(ltp <= stp, 2).otherwise(0)).when(long_, 2).when(short, 0).otherwise(1))


def outcome3(indexed: DataFrame, tp: float, sl: float, horizon: int, fee: float, keys=KEYS) -> DataFrame:
    if tp - 2 * fee <= 0:
        raise ValueError("the target must exceed the round-trip fee")

    def build(d, r):
        d = _ahead(d, r, horizon, "high", "low")
        return d.withColumn("label", F.when(F.col("_full"), _outcome3(F.lit(tp), F.lit(sl))).otherwise(1))

    return framed(indexed, build, after=horizon, keys=keys)


def binary(label: Column) -> dict[str, Column]:
    return {"long_label": (label == 2).cast("int"), "short_label": (label == 0).cast("int")}


def adaptive(indexed: DataFrame, tp_mult: float, sl_mult: float, lo: float, hi: float, horizon: int, fee: float,
             window: int = 14, keys=KEYS) -> DataFrame:
    """Three-class outcome with levels from ATR %; the first rows take the first full value after them."""

    def build(d, r):
        d = _ahead(d, r, horizon, "high", "low").withColumn("_p", r.lag("close"))
        d = d.withColumn("_t", F.greatest(b.H - b.L, F.abs(b.H - F.col("_p")), F.abs(b.L - F.col("_p"))))
        d = d.withColumn("_ap", div(r.mean("_t", window), b.C))
        d = d.withColumn("_apf", r.over(F.first("_ap", ignorenulls=True), 0, window - 1))
        d = d.withColumns({"tp": clip(F.col("_apf") * tp_mult, lo, hi), "sl": clip(F.col("_apf") * sl_mult, lo * 0.8, hi * 0.7)})
        label = F.when(F.col("_full") & (F.col("tp") - 2 * fee > 0), _outcome3(F.col("tp"), F.col("sl"))).otherwise(1)
        return d.withColumn("label", label)

    return framed(indexed, build, before=window + 1, after=max(horizon, 2 * window), keys=keys)


def funding_single(indexed: DataFrame, tp: float, sl: float, horizon: int, fee: float, per_8h: float, keys=KEYS) -> DataFrame:
    """2 if the target comes first and pays after fees and |funding| up to that bar; 0 if the stop does."""

    def build(d, r):
        d = _ahead(d.withColumn("_af", F.abs(F.coalesce("funding_rate", F.lit(0.0))) / per_8h), r, horizon, "high", "low", "_af")
        up, down = b.C * (1 + tp), b.C * (1 - sl)
        kt = first_hit(F.col("_highs"), lambda v: v >= up)
        ks = first_hit(F.col("_lows"), lambda v: v <= down)
        paid = F.aggregate(F.slice("__afs", F.lit(1), F.coalesce(kt, F.lit(1)).cast("int")), F.lit(0.0), lambda a, x: a + x)
        win = F.when(tp - 2 * fee - paid > 0, 2).otherwise(1)
        label = F.when(_not_after(kt, ks), win).when(ks.isNotNull(), 0).otherwise(1)
        return d.withColumn("label", F.when(F.col("_full"), label).otherwise(1))

    return framed(indexed, build, after=horizon, keys=keys)


def funding_two_sided(indexed: DataFrame, long_levels: tuple[float, float], short_levels: tuple[float, float], horizon: int,
                      fee: float, per_8h: float, keys=KEYS) -> DataFrame:
    """Both sides with own levels; funding accrues to the bar at which both sides are resolved."""
    (ltp, lsl), (stp, ssl) = long_levels, short_levels

    def build(d, r):
        rate = F.coalesce("funding_rate", F.lit(0.0))
        d = d.withColumns({"_fp": F.greatest(rate, F.lit(0.0)) / per_8h, "_fn": F.greatest(-rate, F.lit(0.0)) / per_8h})
        d = _ahead(d, r, horizon, "high", "low", "_fp", "_fn")
        hi, lo = F.col("_highs"), F.col("_lows")
        lt, ls = first_hit(hi, lambda v: v >= b.C * ltp), first_hit(lo, lambda v: v <= b.C * lsl)
        st, ss = first_hit(lo, lambda v: v <= b.C * stp), first_hit(hi, lambda v: v >= b.C * ssl)
        end = F.coalesce(F.greatest(*[F.when(x.isNotNull() | y.isNotNull(), F.least(x, y)) for x, y in ((lt, ls), (st, ss))]), F.lit(horizon))
        both = (lt.isNotNull() | ls.isNotNull()) & (st.isNotNull() | ss.isNotNull())
        end = F.when(both, end).otherwise(horizon).cast("int")

        def paid(c):
            return F.aggregate(F.slice(c, F.lit(1), end), F.lit(0.0), lambda a, x: a + x)

        long_ = _not_after(lt, ls) & ((ltp - 1) - 2 * fee - paid("__fps") > 0)
        short = _not_after(st, ss) & ((1 - stp) - 2 * fee - paid("__fns") > 0)
        return d.withColumn("label", F.when(F.col("_full"), F.when(long_, 2).when(short, 0).otherwise(1)).otherwise(1))

    return framed(indexed, build, after=horizon, keys=keys)


def net_edge(indexed: DataFrame, horizon: int, delay: int, base_cost: float, vol_coef: float, per_8h: float,
             min_edge: float, min_atr: float, keys=KEYS) -> DataFrame:
    """Net forward return after fees, spread, slippage and sided funding: class and signed edge.

    Needs ``atr_pct`` and ``funding_rate``; leads and frame sums only.
    """

    def build(d, r):
        rate = F.coalesce("funding_rate", F.lit(0.0))
        d = d.withColumns({"_fp": F.greatest(rate, F.lit(0.0)) / per_8h, "_fn": F.greatest(-rate, F.lit(0.0)) / per_8h})
        entry = r.lead("open", delay) if delay else b.C
        leave, live = r.lead("close", delay + horizon), r.lead("close", horizon + delay + 1).isNotNull()
        fp, fn = (r.over(F.sum(c), delay + 1, delay + horizon) for c in ("_fp", "_fn"))
        atr = F.coalesce("atr_pct", F.lit(0.0))
        cost = base_cost + 2 * vol_coef * F.greatest(atr, F.lit(0.0))
        d = d.withColumns({"_ok": live & (entry > 0) & (atr >= min_atr), "_l": div(leave - entry, entry) - cost - fp,
                           "_s": div(entry - leave, entry) - cost - fn})
        ln, sn, ok = F.col("_l"), F.col("_s"), F.coalesce(F.col("_ok"), F.lit(False))
        return d.withColumns({
            "target_net_return": F.when(ok, F.when(ln >= sn, ln).otherwise(-sn)).otherwise(0.0),
            "label": F.when(ok & (ln > min_edge) & (ln > sn), 2).when(ok & (sn > min_edge) & (sn > ln), 0).otherwise(1)})

    return framed(indexed, build, after=horizon + delay + 1, keys=keys)


def forward_return(indexed: DataFrame, horizons, keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: d.withColumns({f"fwd_{h}": div(r.lead("close", h), b.C) - 1 for h in horizons}),
                  after=max(horizons), keys=keys)


def return_labels(indexed: DataFrame, horizon: int, threshold: float, keys=KEYS) -> DataFrame:
    """Forward return against thresholds: 0/1/2 class, -1/0/1 in percent, and separate long/short."""

    def build(d, r):
        d = d.withColumn("_fr", div(r.lead("close", horizon), b.C) - 1)
        x = F.col("_fr")
        return d.withColumns({
            "entry_label": F.when(x > threshold, 2).when(x < -threshold, 0).otherwise(1),
            "class_label": F.when(x * 100 > threshold * 100, 1).when(x * 100 < -threshold * 100, -1).otherwise(0),
            "long_label": F.coalesce((x > threshold).cast("int"), F.lit(0)), "short_label": F.coalesce((x < -threshold).cast("int"), F.lit(0))})

    return framed(indexed, build, after=horizon, keys=keys)


def future_price(indexed: DataFrame, horizon: int, keys=KEYS) -> DataFrame:
    return framed(indexed, lambda d, r: d.withColumn("future_close", F.coalesce(r.lead("close", horizon), b.C)), after=horizon, keys=keys)


def barrier(indexed: DataFrame, tp_mult: float, sl_mult: float, horizon: int, period: int = 14, keys=KEYS) -> DataFrame:
    """First bar touching either long barrier gives 1, else either short barrier -1 (blind to direction)."""

    def build(d, r):
        d = _ahead(d, r, horizon, "high", "low").withColumn("_p", r.lag("close"))
        d = d.withColumn("_t", F.greatest(b.H - b.L, F.abs(b.H - F.col("_p")), F.abs(b.L - F.col("_p"))))
        atr = r.mean("_t", period, 1)
        d = d.withColumn("_a", atr)
        a, pairs = F.col("_a"), F.arrays_zip(F.col("_highs").alias("h"), F.col("_lows").alias("l"))
        kl = first_hit(pairs, lambda v: (v["l"] <= b.C - a * sl_mult) | (v["h"] >= b.C + a * tp_mult))
        ks = first_hit(pairs, lambda v: (v["h"] >= b.C + a * sl_mult) | (v["l"] <= b.C - a * tp_mult))
        return d.withColumn("label", F.when(_not_after(kl, ks), 1).when(ks.isNotNull(), -1).otherwise(0))

    return framed(indexed, build, before=period, after=horizon, keys=keys)


def embargo_split(indexed: DataFrame, share: float, lookahead: int, keys=KEYS) -> DataFrame:
    """train / embargo / holdout by row position, from one count per series."""
    n = indexed.groupBy(*keys).agg(F.floor((F.max("bar_idx") + 1) * F.lit(share)).alias("_cut"))
    part = F.when(b.I < F.col("_cut") - lookahead, "train").when(b.I < F.col("_cut"), "embargo").otherwise("holdout")
    return indexed.join(n, list(keys)).withColumn("part", part).drop("_cut")


def oos_split(indexed: DataFrame, days: int, gap: int, keys=KEYS) -> DataFrame:
    """train up to ``days`` before the end; the first ``gap`` rows after it are skipped if more remain."""
    end = indexed.groupBy(*keys).agg((F.max("bar_ts") - F.expr(f"INTERVAL {days} DAYS")).alias("_end"))
    d = indexed.join(end, list(keys))
    old = F.col("bar_ts") <= F.col("_end")
    sizes = d.groupBy(*keys).agg(F.count_if(old).alias("_from"), F.count_if(~old).alias("_oos"))
    skipped = (b.I < F.col("_from") + gap) & (F.col("_oos") > gap)
    part = F.when(old, "train").when(skipped, "gap").otherwise("oos")
    return d.join(sizes, list(keys)).withColumn("part", part).drop("_end", "_from", "_oos")


def signal_outcome(indexed: DataFrame, signal: str, tp: float, sl: float, horizon: int, slippage: float, fee: float,
                   rule: str = "stop_first", keys=KEYS) -> DataFrame:
    """One row per signal (+1 long, -1 short): entry at the next open, exit by level, gap or timeout.

    ``stop_first``: levels from the bar after the entry bar, a bar opening beyond the stop fills at its
    open, stop before target. ``target_first``: levels from the entry bar on, target before stop.
    """
    start = 2 if rule == "stop_first" else 1

    def build(d, r):
        bar = F.struct("open", "high", "low", "close", "bar_ts")
        d = d.withColumns({"_e": r.lead("open", 1), "_w": r.ahead(bar, horizon, start)})
        side = F.col(signal)
        entry = F.col("_e") * (1 + side * slippage)
        d = d.filter((side != 0) & F.col("_e").isNotNull() & (F.size("_w") > 0)).withColumn("entry", entry)
        e = F.col("entry")
        stop, goal, w = e * (1 - side * sl), e * (1 + side * tp), F.col("_w")
        adverse = F.transform(w, lambda v: F.when(side > 0, v["low"] <= stop).otherwise(v["high"] >= stop))
        gapped = F.transform(w, lambda v: F.when(side > 0, v["open"] <= stop).otherwise(v["open"] >= stop))
        good = F.transform(w, lambda v: F.when(side > 0, v["high"] >= goal).otherwise(v["low"] <= goal))
        pos = lambda a: F.nullif(F.array_position(a, F.lit(True)), F.lit(0))
        k_bad, k_good = pos(adverse), pos(good)
        if rule == "stop_first":
            k_bad = F.least(k_bad, pos(gapped))
            is_stop = _not_after(k_bad, k_good)
        else:
            is_stop = _before(k_bad, k_good)
        is_goal = ~is_stop & k_good.isNotNull()
        k = F.when(is_stop, k_bad).when(is_goal, k_good).otherwise(F.size(w)).cast("int")
        d = d.withColumns({"_k": k, "_stop": is_stop, "_goal": is_goal})
        at = F.element_at("_w", F.col("_k"))
        gap = F.element_at(gapped, F.col("_k")) if rule == "stop_first" else F.lit(False)
        price = (F.when(F.col("_stop") & gap, at["open"]).when(F.col("_stop"), stop).when(F.col("_goal"), goal).otherwise(at["close"]))
        reason = (F.when(F.col("_stop") & gap, "sl_gap").when(F.col("_stop"), "sl").when(F.col("_goal"), "tp").otherwise("timeout"))
        d = d.withColumns({"exit": price * (1 - side * slippage), "exit_reason": reason, "exit_ts": at["bar_ts"], "bars_held": F.col("_k") + (start - 1)})
        return d.withColumn("pnl_pct", side * div(F.col("exit") - e, e) - 2 * fee)

    return framed(indexed, build, after=horizon + start, keys=keys)
