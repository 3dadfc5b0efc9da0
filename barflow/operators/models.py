"""Performance, weights and consensus of models. Newest-n filters prune map-side (window group limit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.functions.columns import clip, col, div, flag, reasons

ZERO = 0.0


def newest(df: DataFrame, keys, order, n: int, rank: str = "_rk") -> DataFrame:
    """The newest n rows per key, ranked from 1. Spark keeps at most n per key in each map task."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def sign(x, band: float = 1e-12) -> Column:
    return F.when(col(x) > band, 1).when(col(x) < -band, -1).otherwise(0)


def _performance_columns():
    ok = F.col("actual").isNotNull()
    hit = ok & (sign("prediction") == sign("actual"))
    ev, good = F.count_if(ok), F.count_if(hit)
    return [F.count(F.lit(1)).alias("total"), ev.alias("evaluated"), good.alias("correct"),
            F.coalesce(div(good, ev), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit")]


def performance(df: DataFrame, keys=("model",)) -> DataFrame:
    return df.groupBy(*keys).agg(*_performance_columns())


def performance_rollup(df: DataFrame) -> DataFrame:
    """Per model, and pooled in the row whose model is NULL."""
    return df.rollup("model").agg(*_performance_columns())


def reliability_weights(perf: DataFrame) -> DataFrame:
    k = clip(F.col("evaluated") / 50.0, 0.0, 1.0)
    rel = 0.5 * (1 - k) + clip(F.col("accuracy"), 0.0, 1.0) * k
    score = F.greatest(F.lit(0.05), 0.7 * rel + 0.3 * (0.5 + 0.5 * F.tanh(F.col("profit") / 1000.0)))
    return perf.withColumn("score", score).withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy()))


def trade_weights(df: DataFrame, order, keys=("model",)) -> DataFrame:
    """Weight from overall win rate, Sharpe of the last 50 and win rate of the last 10."""
    win = F.count_if(F.col("pnl") > 0)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), (win / F.count(F.lit(1))).alias("win_rate"))
    near = newest(df, keys, order, 50)
    sharpe = F.when(F.count(F.lit(1)) >= 10, F.coalesce(div(F.avg("pnl"), F.stddev_samp("pnl")), F.lit(0.0))).otherwise(0.0)
    last = F.col("_rk") <= 10
    recent = near.groupBy(*keys).agg(sharpe.alias("sharpe"), div(F.count_if(last & (F.col("pnl") > 0)), F.count_if(last)).alias("recent_rate"))
    w = (0.4 * F.least(F.lit(1.0), 2 * F.col("win_rate")) + 0.3 * clip(0.5 * F.col("sharpe") + 0.5, 0.0, 1.0) + 0.3 * F.col("recent_rate"))
    return total.join(recent, list(keys)).withColumn("weight", clip(w, 0.1, 1.0))


def model_flags(weights: DataFrame) -> DataFrame:
    low = (F.col("trades") > 10) & (F.col("win_rate") < 0.4)
    fading = (F.col("trades") > 20) & (F.col("recent_rate") < 0.7 * F.col("win_rate"))
    found = reasons((low, "underperforming"), (fading, "overfitting"))
    return weights.select("model", F.explode(found).alias("flag"))


def calibration_factor(df: DataFrame, order, small_pnl: float = 100.0) -> DataFrame:
    """Mean confidence when right over when wrong, on the last 100 of each model."""
    p, a = F.col("prediction"), F.col("pnl")
    right = ((p > 0.1) & (a > 0)) | ((p < -0.1) & (a < 0)) | ((F.abs(p) < 0.1) & (F.abs(a) < small_pnl))
    d = newest(df, ["model"], order, 100).withColumn("_ok", right)
    good, bad = F.avg(F.when(F.col("_ok"), F.col("confidence"))), F.avg(F.when(~F.col("_ok"), F.col("confidence")))
    out = d.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), good.alias("_g"), bad.alias("_b"))
    f = F.when((F.col("rows") >= 10) & F.col("_g").isNotNull() & F.col("_b").isNotNull(), clip(div("_g", F.greatest("_b", F.lit(0.1))), 0.5, 2.0)).otherwise(1.0)
    return out.select("model", "rows", f.alias("factor"))


def calibrated(raw, accuracy, evaluated, strength) -> Column:
    r = 1 + (F.coalesce(col(accuracy), F.lit(0.0)) - 0.5) * 0.6
    k = F.coalesce(col(evaluated), F.lit(0)) / 20.0
    r = F.when(k < 1, (1 - k) + r * k).otherwise(r)
    return clip(clip(col(raw), 0.0, 1.0) * r * (0.9 + 0.2 * clip(F.abs(col(strength)), 0.0, 1.0)), 0.0, 1.0)


def decayed_accuracy(df: DataFrame, now: Column, days: int = 30, decay: float = 0.95, keys=("model",)) -> DataFrame:
    """Accuracy with weight decay^age in whole days; ``now`` is a timestamp expression."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400_000_000))
    d = df.withColumn("_age", age).filter(F.col("actual").isNotNull() & (F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")))
    w = F.pow(F.lit(decay), F.col("_age").cast("double"))
    hit = sign("prediction", 0.1) == sign("actual", 0.1)
    return d.groupBy(*keys).agg((F.sum(F.when(hit, w).otherwise(0.0)) / F.sum(w)).alias("decayed_accuracy"))


def correlation_penalty(df: DataFrame, slot: list[str]) -> DataFrame:
    """Mean |correlation| of each model with the others over shared slots, and its penalty: whatever models there are.

    Slots hold one row per model, so the join makes models x models rows per slot and one group per pair.
    """
    one = df.groupBy(*slot, "model").agg(F.avg("prediction").alias("_p"))
    other = one.select(*slot, F.col("model").alias("_other"), F.col("_p").alias("_q"))
    pairs = one.join(other, slot).filter(F.col("model") != F.col("_other"))
    each = pairs.groupBy("model", "_other").agg(F.coalesce(F.abs(F.corr("_p", "_q")), F.lit(0.0)).alias("_c"))
    a = F.col("avg_corr")
    pen = F.when(a > 0.8, 0.5).when(a > 0.6, 0.7).when(a > 0.4, 0.9).otherwise(1.0)
    return each.groupBy("model").agg(F.avg("_c").alias("avg_corr")).withColumn("penalty", pen)


def consensus(preds: DataFrame, keys, penalty: DataFrame, recent: DataFrame, regime_score: DataFrame, min_weight=0.05, max_weight=0.40) -> DataFrame:
    """Weighted signal per slot: 1/n, correlation, recent accuracy, regime fit, confidence squared.

    Model tables have one row per model; the weights are bounded and normalised twice inside a slot.
    """
    d = (preds.join(penalty.select("model", "penalty"), "model", "left").join(recent, "model", "left")
         .join(regime_score, ["model", "regime"], "left"))
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    mult = F.when(F.col("regime_score") > 0.6, 1.2).when(F.col("regime_score") < 0.4, 0.8).otherwise(1.0)
    raw = (1.0 / n) * F.when(n >= 3, F.coalesce("penalty", F.lit(1.0))).otherwise(1.0) * (0.5 + F.coalesce("decayed_accuracy", F.lit(0.5))) * mult * F.pow("confidence", F.lit(2))
    d = d.withColumn("_w0", raw)
    d = d.withColumn("_w1", clip(F.coalesce(div("_w0", F.sum("_w0").over(w)), 1.0 / n), min_weight, max_weight))
    d = d.withColumn("weight", F.col("_w1") / F.sum("_w1").over(w))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("models"), clip(F.sum(F.col("prediction") * F.col("weight")), -1.0, 1.0).alias("signal"),
                                clip(F.sum(F.col("confidence") * F.col("weight")), 0.0, 1.0).alias("confidence"))


def consensus_damped(preds: DataFrame, keys, limit: float = 0.6) -> DataFrame:
    c = clip(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0)
    d = preds.withColumn("_c", c).groupBy(*keys).agg(
        F.sum(F.col("prediction") * F.col("_c")).alias("_s"), F.sum("_c").alias("_w"), F.avg("prediction").alias("_m"),
        F.stddev_samp("prediction").alias("_sd"), F.count(F.lit(1)).alias("models"))
    value = F.when(F.col("_w") > 0, div("_s", "_w")).otherwise(F.col("_m"))
    damp = F.when(F.col("_sd") > limit, F.greatest(F.lit(0.5), 1 - 0.5 * (F.col("_sd") - limit))).otherwise(1.0)
    return d.select(*keys, "models", (value * damp).alias("consensus"), (F.col("_w") / F.col("models")).alias("avg_confidence"))


def consensus_typed(preds: DataFrame, keys, ratio: float = 2.0) -> DataFrame:
    """Classifiers and regressors apart, regressors counting double; other types form one group."""
    c = clip(F.coalesce("confidence", F.lit(0.5)), 0.0, 1.0)
    d = preds.withColumn("_c", c)

    def part(cond, p):
        return [F.sum(F.when(cond, F.col("prediction") * F.col("_c"))).alias(f"{p}s"), F.sum(F.when(cond, F.col("_c"))).alias(f"{p}w"), F.count_if(cond).alias(f"{p}n"),
                F.avg(F.when(cond, F.col("prediction"))).alias(f"{p}m")]

    kind = F.lower(F.coalesce("model_type", F.lit("")))
    a = d.groupBy(*keys).agg(*part(kind == "classifier", "c"), *part(kind == "regressor", "r"), *part(F.lit(True), "a"))
    value = {p: F.coalesce(div(f"{p}s", f"{p}w"), F.lit(0.0)) for p in "cr"}
    conf = {p: F.when(F.col(f"{p}w") > 0, F.col(f"{p}w") / F.col(f"{p}n")).otherwise(0.0) for p in "cr"}
    both, rn, cn = conf["r"] * ratio + conf["c"], F.col("rn"), F.col("cn")
    mixed = F.when(both > 0, div(value["r"] * conf["r"] * ratio + value["c"] * conf["c"], both)).otherwise((value["r"] + value["c"]) / 2)
    out = F.when((rn > 0) & (cn > 0), mixed).when(rn > 0, value["r"]).when(cn > 0, value["c"]).otherwise(F.when(F.col("aw") > 0, div("as", "aw")).otherwise(F.col("am")))
    oc = (F.when((rn > 0) & (cn > 0), both / (ratio + 1)).when(rn > 0, conf["r"]).when(cn > 0, conf["c"]).otherwise(F.col("aw") / F.col("an")))
    return a.select(*keys, out.alias("consensus"), oc.alias("avg_confidence"))


# Weight of each step in the final confidence.
STEP_WEIGHTS = {1: 0.08, 2: 0.05, 3: 0.37, 4: 0.05, 5: 0.40, 6: 0.05}


def chain_confidence(steps: DataFrame, keys, models: DataFrame) -> DataFrame:
    """Steps (keys, step, confidence, is_hold) and models (keys, model_avg, margin) to one confidence."""
    table = F.create_map(*[F.lit(x) for p in STEP_WEIGHTS.items() for x in p])
    w = F.coalesce(table[F.col("step")], F.lit(0.1))
    s = steps.groupBy(*keys).agg((F.sum(F.col("confidence") * w) / F.sum(w)).alias("_b"), (F.max("confidence") - F.min("confidence")).alias("_r"), F.max("is_hold").alias("_h"))
    d = s.join(models, list(keys), "left")
    factor = F.greatest(F.lit(0.95), 1 - F.col("_r") * 0.12)
    factor = F.when(F.col("_h"), factor).otherwise(F.greatest(F.lit(0.98), factor))
    base = F.col("_b") * factor
    out = F.when((base > 0.1) & (F.col("model_avg") > 0), F.greatest(base, F.col("model_avg") * 0.8)).otherwise(base)
    out = F.when(F.col("model_avg") == 0, F.greatest(out, F.lit(0.5))).otherwise(out)
    boost = F.when(~F.col("_h") & (F.col("margin") > 0.10), F.least(F.lit(0.08), (F.col("margin") - 0.10) * 0.4)).otherwise(0.0)
    return d.select(*keys, clip(out + boost, 0.0, 1.0).alias("confidence"))


def select_by_health(preds: DataFrame, request) -> DataFrame:
    """Healthy predictions of a request; if none, unknown; if none, degraded; else the request has no row."""
    order = F.when(F.col("health") == "healthy", 1).when(F.col("health") == "unknown", 2).when(F.col("health") == "degraded", 3)
    d = preds.withColumn("_o", order).filter(F.col("_o").isNotNull())
    best = d.groupBy(*request).agg(F.min("_o").alias("_best"))
    return d.join(best, list(request)).filter(F.col("_o") == F.col("_best")).drop("_o", "_best")


def snapshot(df: DataFrame, keys, order, n: int, min_rows: int = 1) -> DataFrame:
    """Win rate, profit factor and drawdown of the newest n outcomes of each key."""
    d = newest(df, keys, order, n)
    run = Window.partitionBy(*keys).orderBy(F.col("_rk").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_eq", F.sum("pnl").over(run))
    d = d.withColumn("_pk", F.greatest(F.lit(0.0), F.max("_eq").over(run)))
    win, loss = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)))
    pf = F.when(loss > 0, div(win, loss)).when(win > 0, 999.0).otherwise(1.0)
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"), pf.alias("profit_factor"),
                               F.avg("pnl").alias("mean_pnl"), F.coalesce(F.max(F.when(F.col("_pk") > 0, div(F.col("_pk") - F.col("_eq"), "_pk"))), F.lit(0.0)).alias("max_drawdown"))
    return out.filter(F.col("rows") >= min_rows)


def performance_trigger(snap: DataFrame, win_floor: float, pf_floor: float, dd_ceiling: float) -> DataFrame:
    why = reasons((F.col("win_rate") < win_floor, "win_rate"), (F.col("profit_factor") < pf_floor, "profit_factor"), (F.col("max_drawdown") > dd_ceiling, "max_drawdown"))
    return snap.withColumn("reasons", why).withColumn("retrain", F.size("reasons") > 0)


def threshold_nudge(snap: DataFrame, mild=0.18, strong=0.40, conf=0.52, step=0.01, mild_b=(0.10, 0.28), strong_b=(0.30, 0.52), conf_b=(0.46, 0.80)) -> DataFrame:
    """Move thresholds by one step on poor or good outcomes (20 rows at least); strong stays 0.05 above mild."""
    wr, pf, mean = F.col("win_rate"), F.col("profit_factor"), F.col("mean_pnl")
    flat = wr.between(0.45, 0.55) & (F.abs(mean) < 1e-8)
    move = F.when((wr < 0.40) | (pf < 0.90), step).when((wr > 0.55) & (mean > 0) & (pf > 1.10), -step).otherwise(0.0)
    m, s, c = (clip(F.lit(v) + move, *b_) for v, b_ in ((mild, mild_b), (strong, strong_b), (conf, conf_b)))
    s = F.when(s < m + 0.05, clip(m + 0.05, *strong_b)).otherwise(s)
    return snap.filter((F.col("rows") >= 20) & ~flat).withColumns({"mild": m, "strong": s, "min_confidence": c})


def strategy_params(perf: DataFrame, confidence: float = 0.50) -> DataFrame:
    q = clip((F.col("accuracy") - 0.5) / 0.25, -1.0, 1.0)
    live = F.col("evaluated") >= 10
    conf = F.when(q < 0, clip(confidence + 0.10 * F.abs(q), 0.45, 0.95)).otherwise(clip(confidence - 0.10 * q, 0.20, 0.75))
    stop = F.when(F.col("profit") < 0, 0.95).when((F.col("profit") > 0) & (q > 0.3), 1.05).otherwise(1.0)
    return perf.withColumns({"size_multiplier": F.when(live, clip(1 + 0.15 * q, 0.75, 1.25)).otherwise(1.0),
                             "confidence_threshold": F.when(live, conf).otherwise(confidence), "stop_multiplier": F.when(live, stop).otherwise(1.0)})
