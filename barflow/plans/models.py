"""Registered queries on models, consensus and decisions; scores come from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import futures as X
from barflow.functions.columns import rounded
from barflow.operators import decisions as A
from barflow.operators import models as M
from barflow.operators import regimes as G
from barflow.operators import series as S
from barflow.plans import domain as D
from barflow.plans.registry import cte, query
from barflow.session import stage

ORDER = ["ts", "trade_id"]


def outcomes(spark, sf):
    f = D.fills(spark, sf)
    return f.withColumn("profit", F.col("pnl")).withColumn("actual", F.when(F.col("order_id") % 9 != 0, F.col("actual")))


cte("mo", "SELECT * REPLACE (CASE WHEN order_id % 9 <> 0 THEN actual END AS actual), pnl AS profit FROM fills", ("fills",))
cte("hits", """SELECT *, CASE WHEN prediction > 1e-12 THEN 1 WHEN prediction < -1e-12 THEN -1 ELSE 0 END = CASE WHEN actual > 1e-12 THEN 1 WHEN actual < -1e-12 THEN -1 ELSE 0 END AND actual IS NOT NULL AS hit FROM mo""", ("mo",))
PERF = "count(*) AS total, count(actual) AS evaluated, count(*) FILTER (hit) AS correct, coalesce(count(*) FILTER (hit) / nullif(count(actual), 0), 0) AS accuracy, sum(profit) AS profit"
cte("perf", f"SELECT model, {PERF} FROM hits GROUP BY 1", ("hits",))
cte("perf_all", f"SELECT model, {PERF} FROM hits GROUP BY ROLLUP (model)", ("hits",))


@query("model_performance", "SELECT model, total, evaluated, correct, round(accuracy, 9) AS accuracy, round(profit, 2) AS profit FROM perf", ("perf",))
def model_performance(spark, sf):
    return rounded(M.performance(outcomes(spark, sf)), 9, {"profit": 2})


@query("model_performance_rollup", "SELECT model, total, evaluated, correct, round(accuracy, 9) AS accuracy, round(profit, 2) AS profit FROM perf_all", ("perf_all",))
def model_performance_rollup(spark, sf):
    return rounded(M.performance_rollup(outcomes(spark, sf)), 9, {"profit": 2})


@query("model_weights", """SELECT model, round(score, 8) AS score, round(score / sum(score) OVER (), 8) AS weight FROM (SELECT model, greatest(.05, .7 * (.5 * (1 - k) + accuracy * k) + .3 * (.5 + .5 * tanh(profit / 1000))) AS score FROM
  (SELECT *, least(evaluated / 50, 1) AS k FROM perf))""", ("perf",))
def model_weights(spark, sf):
    return rounded(M.reliability_weights(M.performance(outcomes(spark, sf))).select("model", "score", "weight"), 8)


cte("tw", """SELECT model, trades, win_rate, sharpe, recent_rate, least(greatest(.4 * least(1, 2 * win_rate) + .3 * least(greatest(.5 * sharpe + .5, 0), 1) + .3 * recent_rate, .1), 1) AS weight FROM
  (SELECT model, count(*) AS trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate FROM fills GROUP BY 1) JOIN (SELECT model, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0) AS sharpe,
   count(*) FILTER (rk <= 10 AND pnl > 0) / count(*) FILTER (rk <= 10) AS recent_rate FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, trade_id DESC) AS rk FROM fills QUALIFY rk <= 50) GROUP BY 1) USING (model)""", ("fills",))


@query("model_trade_weights", "SELECT model, trades, round(win_rate, 8) AS win_rate, round(sharpe, 8) AS sharpe, round(recent_rate, 8) AS recent_rate, round(weight, 8) AS weight FROM tw", ("tw",))
def model_trade_weights(spark, sf):
    return rounded(M.trade_weights(D.fills(spark, sf), ORDER), 8)


@query("model_flags", "SELECT * FROM (SELECT model, 'underperforming' AS flag FROM tw WHERE trades > 10 AND win_rate < .4 UNION ALL SELECT model, 'overfitting' FROM tw WHERE trades > 20 AND recent_rate < .7 * win_rate)", ("tw",))
def model_flags(spark, sf):
    return M.model_flags(M.trade_weights(D.fills(spark, sf), ORDER))


@query("calibration_factor", """SELECT model, count(*) AS rows, round(CASE WHEN count(*) >= 10 AND count(*) FILTER (ok) > 0 AND count(*) FILTER (NOT ok) > 0 THEN least(greatest(avg(confidence) FILTER (ok) / greatest(avg(confidence) FILTER (NOT ok), .1), .5), 2) ELSE 1 END, 8) AS factor FROM
  (SELECT *, (prediction > .1 AND pnl > 0) OR (prediction < -.1 AND pnl < 0) OR (abs(prediction) < .1 AND abs(pnl) < 100) AS ok, row_number() OVER (PARTITION BY model ORDER BY ts DESC, trade_id DESC) AS rk FROM fills QUALIFY rk <= 100) GROUP BY 1""", ("fills",))
def calibration_factor(spark, sf):
    return rounded(M.calibration_factor(D.fills(spark, sf), ORDER), 8)


@query("confidence_calibrate", """SELECT trade_id, round(least(greatest(confidence * (1 + (accuracy - .5) * .6) * (.9 + .2 * least(abs(prediction), 1)), 0), 1), 6) AS calibrated FROM mo JOIN perf USING (model)""", ("mo", "perf"))
def confidence_calibrate(spark, sf):
    o = outcomes(spark, sf)
    p = M.performance(o).select("model", "accuracy", "evaluated")
    return rounded(o.join(p, "model").select("trade_id", M.calibrated("confidence", "accuracy", "evaluated", "prediction").alias("calibrated")))


NOW = "(SELECT max(ts) FROM mo)"
DEC = """SELECT model, sum(CASE WHEN (CASE WHEN prediction > .1 THEN 1 WHEN prediction < -.1 THEN -1 ELSE 0 END) = (CASE WHEN actual > .1 THEN 1 WHEN actual < -.1 THEN -1 ELSE 0 END) THEN w ELSE 0 END) / sum(w) AS decayed_accuracy FROM
  (SELECT *, pow(.95::DOUBLE, floor(epoch({now} - ts) / 86400)) AS w FROM mo WHERE actual IS NOT NULL AND ts >= {now} - INTERVAL '{days} days' AND ts <= {now}) GROUP BY 1"""
cte("dec30", DEC.format(now=NOW, days=30), ("mo",))
cte("dec7", DEC.format(now=NOW, days=7), ("mo",))


def decayed(spark, sf, days):
    o = outcomes(spark, sf)
    return M.decayed_accuracy(o, o.agg(F.max("ts")).scalar(), days)


@query("decayed_accuracy", "SELECT model, round(decayed_accuracy, 8) AS decayed_accuracy FROM dec30", ("dec30",))
def decayed_accuracy(spark, sf):
    return rounded(decayed(spark, sf, 30), 8)


def slots(spark, sf):
    """One prediction per model and day: the mean of that day's rows (integer cents keep it exact)."""
    f = D.fills(spark, sf)
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")) / (F.count(F.lit(1)) * 100.0)
    return f.groupBy("ts", "model").agg(cents("prediction").alias("prediction"), cents("confidence").alias("confidence"), cents("actual").alias("actual"))


cte("slots", """SELECT ts, model, CAST(sum(round(prediction * 100)::BIGINT) AS BIGINT) / (count(*) * 100.0::DOUBLE) AS prediction, CAST(sum(round(confidence * 100)::BIGINT) AS BIGINT) / (count(*) * 100.0::DOUBLE) AS confidence,
  CAST(sum(round(actual * 100)::BIGINT) AS BIGINT) / (count(*) * 100.0::DOUBLE) AS actual FROM fills GROUP BY ALL""", ("fills",))
cte("pen", "SELECT a AS model, CASE WHEN avg(c) > .8 THEN .5 WHEN avg(c) > .6 THEN .7 WHEN avg(c) > .4 THEN .9 ELSE 1.0 END::DOUBLE AS penalty FROM (SELECT x.model AS a, y.model AS b, coalesce(abs(corr(x.prediction, y.prediction)), 0) AS c FROM slots x JOIN slots y ON x.ts = y.ts AND x.model <> y.model GROUP BY ALL) GROUP BY 1", ("slots",))
cte("rsc", "SELECT model, 'r' || (month(ts) % 2) AS regime, avg(((prediction > 0) = (actual > 0))::INT) AS rs FROM slots GROUP BY ALL", ("slots",))
cte("cw", """SELECT s.ts, s.model, s.prediction, s.confidence, (1.0::DOUBLE / n) * CASE WHEN n >= 3 THEN penalty ELSE 1 END * (.5 + coalesce(decayed_accuracy, .5)) * CASE WHEN rs > .6 THEN 1.2::DOUBLE WHEN rs < .4 THEN .8::DOUBLE ELSE 1 END * pow(confidence, 2) AS w0, n FROM
  (SELECT *, count(*) OVER (PARTITION BY ts) AS n, 'r' || (month(ts) % 2) AS regime FROM slots) s JOIN pen USING (model) LEFT JOIN dec7 USING (model) LEFT JOIN rsc ON rsc.model = s.model AND rsc.regime = s.regime""", ("slots", "pen", "dec7", "rsc"))


@query("consensus", """SELECT ts, count(*) AS models, round(sum(prediction * w2), 8) AS signal, round(sum(confidence * w2), 8) AS confidence FROM (SELECT *, w1 / sum(w1) OVER (PARTITION BY ts) AS w2 FROM
  (SELECT *, least(greatest(w0 / sum(w0) OVER (PARTITION BY ts), .05), .4) AS w1 FROM cw)) GROUP BY ts""", ("cw",))
def consensus(spark, sf):
    d = stage(slots(spark, sf))
    d = d.withColumn("regime", F.concat(F.lit("r"), F.month("ts") % 2))
    fit = d.groupBy("model", "regime").agg(F.avg(((F.col("prediction") > 0) == (F.col("actual") > 0)).cast("int")).alias("regime_score"))
    return rounded(M.consensus(d, ["ts"], M.correlation_penalty(d, ["ts"]), decayed(spark, sf, 7), fit), 8)


cte("cd", "SELECT ts, count(*) AS models, CASE WHEN sum(confidence) > 0 THEN sum(prediction * confidence) / sum(confidence) ELSE avg(prediction) END AS v, coalesce(stddev_samp(prediction), 0) AS sd, sum(confidence) / count(*) AS ac FROM slots GROUP BY 1", ("slots",))


@query("consensus_damped", "SELECT ts, models, round(v * CASE WHEN sd > .3 THEN greatest(.5, 1 - .5 * (sd - .3)) ELSE 1 END, 8) AS consensus, round(ac, 8) AS avg_confidence FROM cd", ("cd",))
def consensus_damped(spark, sf):
    return rounded(M.consensus_damped(slots(spark, sf), ["ts"], 0.3), 8)


@query("consensus_typed", """SELECT ts, round(CASE WHEN rn > 0 AND cn > 0 THEN (rc * rf * 2 + cc * cf) / nullif(rf * 2 + cf, 0) WHEN rn > 0 THEN rc WHEN cn > 0 THEN cc ELSE av END, 8) AS consensus,
  round(CASE WHEN rn > 0 AND cn > 0 THEN (rf * 2 + cf) / 3 WHEN rn > 0 THEN rf WHEN cn > 0 THEN cf ELSE af END, 8) AS avg_confidence FROM (SELECT ts, count(*) FILTER (k = 'c') AS cn, count(*) FILTER (k = 'r') AS rn,
  sum(prediction * confidence) FILTER (k = 'c') / sum(confidence) FILTER (k = 'c') AS cc, sum(prediction * confidence) FILTER (k = 'r') / sum(confidence) FILTER (k = 'r') AS rc, avg(confidence) FILTER (k = 'c') AS cf,
  avg(confidence) FILTER (k = 'r') AS rf, sum(prediction * confidence) / sum(confidence) AS av, avg(confidence) AS af FROM (SELECT *, CASE WHEN model IN ('FA', 'OA') THEN 'c' WHEN model IN ('FR', 'OR') THEN 'r' END AS k FROM slots) GROUP BY 1)""", ("slots",))
def consensus_typed(spark, sf):
    kind = F.when(F.col("model").isin("FA", "OA"), "classifier").when(F.col("model").isin("FR", "OR"), "Regressor")
    return rounded(M.consensus_typed(slots(spark, sf).withColumn("model_type", kind), ["ts"]), 8)


@query("chain_confidence", """SELECT order_id, round(least(greatest(o2 + CASE WHEN NOT h AND mg > .10 THEN least(.08, (mg - .10) * .4) ELSE 0 END, 0), 1), 8) AS confidence FROM
  (SELECT *, CASE WHEN bb > .1 AND ma > 0 THEN greatest(bb, ma * .8) ELSE bb END AS o2 FROM (SELECT *, b0 * CASE WHEN h THEN f ELSE greatest(.98, f) END AS bb FROM
   (SELECT order_id, sum(confidence * w) / sum(w) AS b0, greatest(.95, 1 - (max(confidence) - min(confidence)) * .12) AS f, bool_or(abs(prediction) < .1) AS h, avg(actual) * .5 + .5 AS ma, avg(abs(actual)) AS mg FROM
    (SELECT *, CASE step WHEN 1 THEN .08 WHEN 2 THEN .05 WHEN 3 THEN .37 WHEN 4 THEN .05 WHEN 5 THEN .40 WHEN 6 THEN .05 ELSE .1 END::DOUBLE AS w FROM (SELECT *, split_part(trade_id, '-', 2)::INT AS step FROM fills)) GROUP BY 1)))""", ("fills",))
def chain_confidence(spark, sf):
    f = D.fills(spark, sf).withColumn("step", F.split("trade_id", "-")[1].cast("int"))
    steps = f.select("order_id", "step", "confidence", (F.abs("prediction") < 0.1).alias("is_hold"))
    models = f.groupBy("order_id").agg((F.avg("actual") * 0.5 + 0.5).alias("model_avg"), F.avg(F.abs("actual")).alias("margin"))
    return rounded(M.chain_confidence(steps, ["order_id"], models), 8)


@query("prediction_select", """SELECT order_id, trade_id, health FROM (SELECT *, min(o) OVER (PARTITION BY order_id) AS m FROM (SELECT order_id, trade_id, h AS health, CASE h WHEN 'healthy' THEN 1 WHEN 'unknown' THEN 2 WHEN 'degraded' THEN 3 END AS o FROM
  (SELECT *, CASE quantity::INT % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unknown' WHEN 2 THEN 'degraded' ELSE 'failed' END AS h FROM fills)) WHERE o IS NOT NULL) WHERE o = m""", ("fills",))
def prediction_select(spark, sf):
    q = F.col("quantity").cast("int") % 4
    d = D.fills(spark, sf).select("order_id", "trade_id", F.when(q == 0, "healthy").when(q == 1, "unknown").when(q == 2, "degraded").otherwise("failed").alias("health"))
    return M.select_by_health(d, ["order_id"])


SNAP = """SELECT model, count(*) AS rows, count(*) FILTER (pnl > 0) / count(*) AS win_rate, CASE WHEN coalesce(sum(pnl) FILTER (pnl < 0), 0) <> 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)) WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 999 ELSE 1 END AS profit_factor,
  avg(pnl) AS mean_pnl, coalesce(max(CASE WHEN pk > 0 THEN (pk - eq) / pk END), 0) AS max_drawdown FROM (SELECT *, greatest(0, max(eq) OVER (PARTITION BY model ORDER BY rk DESC)) AS pk FROM (SELECT *, sum(pnl) OVER (PARTITION BY model ORDER BY rk DESC) AS eq FROM
  (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, trade_id DESC) AS rk FROM fills QUALIFY rk <= {n}))) GROUP BY 1"""
cte("snap", SNAP.format(n=200), ("fills",))
cte("snap50", SNAP.format(n=50), ("fills",))
SN = "round(win_rate, 8) AS win_rate, round(profit_factor, 8) AS profit_factor, round(mean_pnl, 6) AS mean_pnl, round(max_drawdown, 8) AS max_drawdown"


@query("performance_snapshot", f"SELECT model, rows, {SN} FROM snap", ("snap",))
def performance_snapshot(spark, sf):
    return rounded(M.snapshot(D.fills(spark, sf), ["model"], ORDER, 200), 8, {"mean_pnl": 6})


@query("performance_trigger", "SELECT model, r AS reasons, len(r) > 0 AS retrain FROM (SELECT model, list_filter([CASE WHEN win_rate < .5 THEN 'win_rate' END, CASE WHEN profit_factor < 1 THEN 'profit_factor' END, CASE WHEN max_drawdown > .5 THEN 'max_drawdown' END], lambda v: v IS NOT NULL) AS r FROM snap)", ("snap",))
def performance_trigger(spark, sf):
    return M.performance_trigger(M.snapshot(D.fills(spark, sf), ["model"], ORDER, 200), 0.5, 1.0, 0.5).select("model", "reasons", "retrain")


@query("threshold_nudge", """SELECT model, round(m, 6) AS mild, round(CASE WHEN s < m + .05 THEN least(greatest(m + .05, .30), .52) ELSE s END, 6) AS strong, round(c, 6) AS min_confidence FROM (SELECT model, least(greatest(.18 + mv, .10), .28) AS m, least(greatest(.40 + mv, .30), .52) AS s, least(greatest(.52 + mv, .46), .80) AS c FROM
  (SELECT *, CASE WHEN win_rate < .4 OR profit_factor < .9 THEN .01 WHEN win_rate > .55 AND mean_pnl > 0 AND profit_factor > 1.1 THEN -.01 ELSE 0 END AS mv FROM snap50 WHERE rows >= 20 AND NOT (win_rate BETWEEN .45 AND .55 AND abs(mean_pnl) < 1e-8)))""", ("snap50",))
def threshold_nudge(spark, sf):
    return rounded(M.threshold_nudge(M.snapshot(D.fills(spark, sf), ["model"], ORDER, 50)).select("model", "mild", "strong", "min_confidence"))


@query("strategy_params", """SELECT model, round(CASE WHEN evaluated >= 10 THEN least(greatest(1 + .15 * q, .75), 1.25) ELSE 1 END, 8) AS size_multiplier, round(CASE WHEN evaluated < 10 THEN .5 WHEN q < 0 THEN least(greatest(.5 + .1 * abs(q), .45), .95) ELSE least(greatest(.5 - .1 * q, .2), .75) END, 8) AS confidence_threshold,
  CASE WHEN evaluated >= 10 AND profit < 0 THEN .95 WHEN evaluated >= 10 AND profit > 0 AND q > .3 THEN 1.05 ELSE 1 END::DOUBLE AS stop_multiplier FROM (SELECT *, least(greatest((accuracy - .5) / .25, -1), 1) AS q FROM perf_all)""", ("perf_all",))
def strategy_params(spark, sf):
    return rounded(M.strategy_params(M.performance_rollup(outcomes(spark, sf))).select("model", "size_multiplier", "confidence_threshold", "stop_multiplier"), 8)


# decisions --------------------------------------------------------------------------------------


# One number per line item that orders the predictions of a slot.
RANK = ("l_linenumber * CAST(1000000000000000 AS BIGINT) + l_partkey * 1000000000 + l_suppkey * 100000 + CAST(l_quantity AS BIGINT) * 1000 "
        "+ CAST(round(l_discount * 100) AS BIGINT) * 10 + CAST(round(l_tax * 100) AS BIGINT)")


def preds(spark, sf):
    li = D.table(spark, sf, "lineitem")
    p2 = lambda e: F.round(e, 2)
    buy, sell = p2(F.col("l_discount") * 8), p2(F.col("l_tax") * 8)
    tf = F.when(F.col("l_linenumber") % 3 == 0, "3m").when(F.col("l_linenumber") % 3 == 1, "5m").otherwise("15m")
    conf = p2(0.5 + F.col("l_quantity") / 100)
    d = li.select(F.col("l_orderkey").alias("order_id"), F.concat(F.lit("M_BTC_"), F.upper(tf)).alias("model_name"), p2((F.col("l_discount") - 0.05) * 20).alias("prediction"),
                  conf.alias("confidence"), F.expr(RANK).alias("rank"), "l_partkey", "l_quantity", buy.alias("_b"), sell.alias("_s"))
    body = F.to_json(F.struct(F.when(F.col("l_partkey") % 7 != 0, p2(F.col("_b") - F.col("_s"))).alias("entry_signal"), F.when(F.col("l_partkey") % 7 != 0, p2(F.col("confidence") - 0.01)).alias("entry_confidence"),
                              F.struct(F.col("_s").alias("sell"), F.lit(0.1).alias("hold"), F.col("_b").alias("buy")).alias("entry_proba"), F.lit("v15_pipeline").alias("format")))
    return d.withColumn("context", F.when(F.col("l_partkey") % 5 != 0, body)).drop("_b", "_s")


cte("pr0", f"""SELECT l_orderkey AS order_id, CASE l_linenumber % 3 WHEN 0 THEN '3m' WHEN 1 THEN '5m' ELSE '15m' END AS tf, round((l_discount - .05::DOUBLE) * 20, 2) AS prediction, round(.5::DOUBLE + l_quantity / 100, 2) AS confidence,
  {RANK} AS rank, l_partkey, l_quantity, round(l_discount * 8, 2) AS b0, round(l_tax * 8, 2) AS s0 FROM lineitem""")
cte("pr", """SELECT *, CASE WHEN l_partkey % 5 <> 0 AND l_partkey % 7 <> 0 THEN round(b0 - s0, 2) ELSE prediction END AS signal, CASE WHEN l_partkey % 5 <> 0 AND l_partkey % 7 <> 0 THEN least(round(confidence - .01::DOUBLE, 2), 1) ELSE least(confidence, 1) END AS conf,
  CASE WHEN l_partkey % 5 <> 0 THEN b0 END AS buy, CASE WHEN l_partkey % 5 <> 0 THEN s0 END AS sell FROM pr0""", ("pr0",))


def extracted(spark, sf):
    return A.extract(preds(spark, sf)).withColumn("tf", A.model_timeframe(F.col("model_name")))


@query("model_timeframe", "SELECT tf, count(*) AS n FROM pr GROUP BY 1", ("pr",))
def model_timeframe(spark, sf):
    return preds(spark, sf).groupBy(A.model_timeframe(F.col("model_name")).alias("tf")).agg(F.count(F.lit(1)).alias("n"))


@query("prediction_extract", "SELECT order_id, rank, tf, signal, conf, buy, sell FROM pr", ("pr",))
def prediction_extract(spark, sf):
    return extracted(spark, sf).select("order_id", "rank", "tf", "signal", "conf", "buy", "sell")


def pick_tf(t):
    return f"arg_max({{'signal': signal, 'conf': conf, 'buy': buy, 'sell': sell}}, rank) FILTER (tf = '{t}')"


cte("wide", f"SELECT order_id, {pick_tf('15m')} AS a, {pick_tf('3m')} AS c, {pick_tf('5m')} AS b FROM pr GROUP BY 1", ("pr",))
cte("mtf0", "SELECT order_id, coalesce(a, b, c) AS t, coalesce(b, a, c) AS e, c AS f FROM wide", ("wide",))
cte("mtf1", "SELECT *, t.buy IS NOT NULL AND e.buy IS NOT NULL AS pb, CASE WHEN t.buy IS NOT NULL AND e.buy IS NOT NULL THEN CASE WHEN t.buy - t.sell >= .05 THEN 1 WHEN t.sell - t.buy >= .05 THEN -1 ELSE 0 END WHEN t.signal > .1 THEN 1 WHEN t.signal < -.1 THEN -1 ELSE 0 END AS tr FROM mtf0", ("mtf0",))
HOLDS = [("pb AND tr = 0", "trend_edge_small", "e.conf * .3"), ("NOT pb AND tr = 0", "trend_neutral", "e.conf * .3"),
         ("coalesce(tr * e.signal > .15 AND tr * f.signal < -.05, false)", "filter_conflict", "e.conf * .4"), ("tr * e.signal <= 0", "not_aligned", "0"), ("pb AND e.conf < .6", "low_confidence", "0"),
         ("pb AND tr * (e.buy - e.sell) < .08", "entry_edge_small", "0"), ("NOT pb AND (tr * e.signal <= .15 OR e.conf < .6)", "entry_not_confirming", "0")]
STRONG = "CASE WHEN pb THEN tr * (e.buy - e.sell) >= .15 AND e.conf >= .72 ELSE tr * e.signal > .45 AND e.conf >= .72 END"
cte("mtf", f"SELECT *, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{n}{chr(39)}' for c, n, _ in HOLDS)} ELSE 'aligned' END AS reason, CASE {' '.join(f'WHEN {c} THEN {v}' for c, _, v in HOLDS)} ELSE e.conf END AS dc FROM mtf1", ("mtf1",))
cte("mtf_d", f"SELECT order_id, reason, round(dc, 6) AS decision_confidence, CASE WHEN reason <> 'aligned' THEN 'HOLD' ELSE CASE WHEN {STRONG} THEN 'STRONG_' ELSE '' END || CASE WHEN tr > 0 THEN 'BUY' ELSE 'SELL' END END AS decision FROM mtf", ("mtf",))


def decided(spark, sf):
    return A.two_timeframe(A.by_timeframe(extracted(spark, sf), ["order_id"], "rank", A.Rules().frames))


@query("mtf_decision", "SELECT * FROM mtf_d", ("mtf_d",))
def mtf_decision(spark, sf):
    return rounded(decided(spark, sf).select("order_id", "reason", "decision_confidence", "decision"))


SHORT = "CASE WHEN abs(buy - sell) < .05 THEN 'HOLD' WHEN buy - sell > .08 THEN CASE WHEN buy >= .55 THEN 'STRONG_BUY' ELSE 'BUY' END WHEN buy - sell < -.08 THEN CASE WHEN sell >= .58 THEN 'STRONG_SELL' ELSE 'SELL' END ELSE 'HOLD' END"


@query("mtf_short_decision", f"SELECT order_id, rank, {SHORT} AS decision, round(conf * CASE WHEN abs(buy - sell) < .05 THEN .2 WHEN abs(buy - sell) > .08 THEN 1 ELSE .25 END, 6) AS decision_confidence FROM pr WHERE buy IS NOT NULL", ("pr",))
def mtf_short_decision(spark, sf):
    d = extracted(spark, sf).filter("buy is not null")
    return rounded(d.withColumns(A.short_timeframe(F.col("buy"), F.col("sell"), F.col("conf"))).select("order_id", "rank", "decision", "decision_confidence"))


SIDE = "CASE WHEN decision LIKE '%BUY' THEN 1 WHEN decision LIKE '%SELL' THEN -1 END"


@query("context_multiplier", f"SELECT order_id, CASE WHEN {SIDE} IS NULL OR a.buy IS NULL THEN 1 WHEN {SIDE} * (a.buy - a.sell) >= .02 THEN 1.15 WHEN {SIDE} * (a.buy - a.sell) <= -.02 THEN .75 ELSE 1 END::DOUBLE AS multiplier FROM mtf_d JOIN wide USING (order_id)", ("mtf_d", "wide"))
def context_multiplier(spark, sf):
    d = decided(spark, sf)
    return d.select("order_id", A.context_multiplier(F.col("decision"), F.col("tf_15m.buy"), F.col("tf_15m.sell")).alias("multiplier"))


EDGE = "CASE WHEN NOT (coalesce(ap >= .0005, true) AND coalesce(adx <= 25, true) AND abs(e) >= .002) THEN 'HOLD' WHEN e >= .3 AND e >= .15 THEN 'BUY' WHEN e <= -.3 AND e <= -.15 THEN 'SELL' ELSE 'HOLD' END"
cte("eg", f"SELECT *, {EDGE} AS rule FROM (SELECT order_id, rank, signal AS e, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity / 10000 END AS ap, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END AS adx, CASE WHEN conf > .7 THEN 'STRONG_BUY' WHEN conf > .6 THEN 'SELL' ELSE 'HOLD' END AS syn FROM pr)", ("pr",))


def edge_rows(spark, sf):
    k, q = F.col("l_partkey"), F.col("l_quantity")
    d = extracted(spark, sf).withColumns({"ap": F.when(k % 3 != 0, q / 10000), "adx": F.when(k % 4 != 0, q), "syn": F.when(F.col("conf") > 0.7, "STRONG_BUY").when(F.col("conf") > 0.6, "SELL").otherwise("HOLD")})
    return d.withColumn("rule", A.edge_entry("signal", 0.3, "ap", "adx"))


@query("edge_entry", "SELECT order_id, rank, rule FROM eg", ("eg",))
def edge_entry(spark, sf):
    return edge_rows(spark, sf).select("order_id", "rank", "rule")


@query("edge_gate", "SELECT order_id, rank, CASE WHEN (syn IN ('BUY', 'STRONG_BUY') AND rule = 'BUY') OR (syn IN ('SELL', 'STRONG_SELL') AND rule = 'SELL') THEN syn ELSE 'HOLD' END AS signal FROM eg", ("eg",))
def edge_gate(spark, sf):
    return edge_rows(spark, sf).select("order_id", "rank", A.edge_gate(F.col("syn"), F.col("rule")).alias("signal"))


@query("primary_prediction", "SELECT order_id, arg_max(signal, (abs(signal), rank)) AS edge, arg_max(tf, (abs(signal), rank)) AS tf FROM pr WHERE l_partkey % 5 <> 0 GROUP BY 1", ("pr",))
def primary_prediction(spark, sf):
    fmt = F.get_json_object("context", "$.format")
    return A.primary_prediction(extracted(spark, sf).withColumns({"format": fmt, "edge": F.col("signal")}), ["order_id"])


@query("ensemble_edge", "SELECT order_id, rank, round(CASE WHEN (prediction > 0 AND b0 - s0 > 0) OR (prediction < 0 AND b0 - s0 < 0) THEN abs(prediction) * (b0 - s0) ELSE 0 END, 8) AS edge FROM pr", ("pr",))
def ensemble_edge(spark, sf):
    src = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.expr(RANK).alias("rank"),
                                                F.round((F.col("l_discount") - 0.05) * 20, 2).alias("reg"), F.round(F.col("l_discount") * 8, 2).alias("b"), F.round(F.col("l_tax") * 8, 2).alias("s"))
    return rounded(src.select("order_id", "rank", A.ensemble_edge("reg", "b", "s").alias("edge")), 8)


@query("sample_weight", "SELECT trade_id, round(least(greatest(pow(abs(prediction) / (.25::DOUBLE + 1e-12), 1.5), .3), 6) * CASE c WHEN 0 THEN 1.4 WHEN 1 THEN .4 WHEN 2 THEN 1.4 ELSE 1 END::DOUBLE, 8) AS weight FROM (SELECT *, CASE WHEN actual > .5 THEN 2 WHEN actual < -.5 THEN 0 WHEN actual < 0 THEN 3 ELSE 1 END AS c FROM fills)", ("fills",))
def sample_weight(spark, sf):
    c = F.when(F.col("actual") > 0.5, 2).when(F.col("actual") < -0.5, 0).when(F.col("actual") < 0, 3).otherwise(1)
    return rounded(D.fills(spark, sf).select("trade_id", A.sample_weight("prediction", c, 0.25).alias("weight")), 8)


@query("round_trip_cost", "SELECT trade_id, round(.001 + (2 * 2 + 2 * 3) / 10000::DOUBLE + 2 * .1 * (quantity / 10000), 9) AS cost FROM fills", ("fills",))
def round_trip_cost(spark, sf):
    return rounded(D.fills(spark, sf).select("trade_id", A.round_trip_cost(F.col("quantity") / 10000, 0.001, 2, 3, 0.1).alias("cost")), 9)


@query("rr_gate", "SELECT trade_id, sl, tp, CASE WHEN sl <= 0 OR tp <= 0 THEN true ELSE tp / sl >= 1.2 END AS passed FROM (SELECT trade_id, round(prediction * 100, 0) AS sl, round(actual * 100, 0) AS tp FROM fills)", ("fills",))
def rr_gate(spark, sf):
    d = D.fills(spark, sf).select("trade_id", F.round(F.col("prediction") * 100).alias("sl"), F.round(F.col("actual") * 100).alias("tp"))
    return d.withColumn("passed", A.rr_gate("sl", "tp"))


@query("score_normalize", """SELECT trade_id, round(CASE WHEN k = 0 THEN prediction - actual WHEN k = 1 THEN CASE WHEN confidence >= .6 THEN (confidence - .6::DOUBLE) / (1 - .6::DOUBLE) ELSE (confidence - .6::DOUBLE) / .6::DOUBLE END ELSE tanh((exit_price - entry_price) / entry_price / .1) END, 8) AS score,
  round(greatest(prediction, actual), 8) AS conf FROM (SELECT *, order_id % 3 AS k FROM fills)""", ("fills",))
def score_normalize(spark, sf):
    kind = F.when(F.col("order_id") % 3 == 0, "three_class").when(F.col("order_id") % 3 == 1, "binary").otherwise("forecast")
    s = A.score_normalize(kind, "prediction", "actual", "confidence", "entry_price", "exit_price", 0.6)
    return rounded(D.fills(spark, sf).select("trade_id", s.alias("score"), F.greatest("prediction", "actual").alias("conf")), 8)


@query("discrete_signal", "SELECT trade_id, CASE WHEN prediction > .3 THEN 'BUY' WHEN prediction < -.3 THEN 'SELL' ELSE 'HOLD' END AS signal FROM fills", ("fills",))
def discrete_signal(spark, sf):
    return D.fills(spark, sf).select("trade_id", A.discrete_signal("prediction").alias("signal"))


@query("hold_band_decision", """SELECT ts, CASE WHEN v > st THEN 'STRONG_BUY' WHEN v > ml THEN 'BUY' WHEN v < -st THEN 'STRONG_SELL' WHEN v < -ml THEN 'SELL' ELSE 'HOLD' END AS decision FROM (SELECT ts, v, CASE WHEN sd >= .18 THEN greatest(.30, s0 - .03) WHEN sd >= .12 THEN greatest(.32, s0 - .02) ELSE s0 END AS st,
  CASE WHEN sd >= .18 THEN greatest(.10, m0 - .02) WHEN sd >= .12 THEN greatest(.11, m0 - .01) ELSE m0 END AS ml FROM (SELECT *, CASE WHEN vol > 5 THEN .45 WHEN vol < 1.5 THEN .35 ELSE .40 END AS s0, CASE WHEN vol > 5 THEN .20 WHEN vol < 1.5 THEN .15 ELSE .18 END AS m0 FROM
   (SELECT *, CASE WHEN day(ts) % 5 <> 0 THEN day(ts) / 4.0::DOUBLE END AS vol FROM cd)))""", ("cd",))
def hold_band_decision(spark, sf):
    d = slots(spark, sf)
    m = d.groupBy("ts").agg(F.coalesce(F.stddev_samp("prediction"), F.lit(0.0)).alias("margin"))
    c = M.consensus_damped(d, ["ts"], 1e9).join(m, "ts")
    vol = F.when(F.day("ts") % 5 != 0, F.day("ts") / 4.0)
    return c.select("ts", A.hold_band("consensus", vol, "margin").alias("decision"))


@query("context_regime", "SELECT trade_id, CASE WHEN quantity / 1000 > .03 THEN 'high_volatility' WHEN confidence > .7 THEN 'trending' ELSE 'ranging' END AS regime FROM fills", ("fills",))
def context_regime(spark, sf):
    return D.fills(spark, sf).select("trade_id", G.context_regime(F.col("quantity") / 1000, F.col("confidence")).alias("regime"))


REJ_SQL = """CASE WHEN signal = 'HOLD' THEN 'hold' WHEN age > 45 THEN 'stale' WHEN rule = 'HOLD' THEN 'edge_gate' WHEN NOT buy AND NOT sell THEN 'unknown_signal' WHEN (os = 'long' AND sell) OR (os = 'short' AND buy) THEN 'reversal_exit'
  WHEN os IS NOT NULL THEN 'position_open' WHEN confidence < .55 THEN 'low_confidence' WHEN price IS NULL THEN 'no_price' WHEN vol IS NULL THEN 'no_volatility' WHEN vol < 3 THEN 'low_volatility' WHEN atr / price < .0015 THEN 'low_atr'
  WHEN cash < notional THEN 'margin' WHEN NOT ok THEN 'risk' WHEN NOT (sl <= 0 OR tp <= 0 OR tp / sl >= 1.2) THEN 'reward' WHEN (buy AND tr < 0) OR (sell AND tr > 0) THEN 'timeframe_conflict' WHEN adx < 20 AND signal IN ('BUY', 'SELL') THEN 'ranging'
  WHEN (buy AND price < ema) OR (sell AND price > ema) THEN 'against_ema200' WHEN buy AND bb >= .92 THEN 'near_upper_band' WHEN buy AND res > 0 THEN 'at_resistance' WHEN buy AND rstr >= {cap} THEN 'resistance_strength' WHEN sell AND sup > 0 THEN 'at_support'
  WHEN sell AND sstr >= {cap} THEN 'support_strength' WHEN buy AND brk < .5 THEN 'signal_filter' WHEN lots < 1 THEN 'lots' END""".format(cap=A.EntryLimits().strength_cap)
cte("rj", f"""SELECT trade_id, {REJ_SQL} AS reason FROM (SELECT *, signal LIKE '%BUY' AS buy, signal LIKE '%SELL' AS sell FROM (SELECT * EXCLUDE (actual), CASE WHEN order_id % 97 = 5 THEN 'WAIT' WHEN prediction > .6 THEN 'STRONG_BUY' WHEN prediction > .2 THEN 'BUY' WHEN prediction < -.6 THEN 'STRONG_SELL'
  WHEN prediction < -.2 THEN 'SELL' ELSE 'HOLD' END AS signal, order_id % 60 AS age, CASE WHEN order_id % 11 = 0 THEN 'HOLD' ELSE 'BUY' END AS rule, CASE order_id % 13 WHEN 0 THEN 'long' WHEN 1 THEN 'short' END AS os, CASE WHEN order_id % 89 <> 0 THEN entry_price END AS price,
  CASE WHEN order_id % 17 <> 0 THEN order_id % 53 END AS vol, entry_price * ((order_id % 23) / 1000.0::DOUBLE) AS atr, 80000.0 AS cash, order_id % 19 <> 0 AS ok, .01::DOUBLE AS sl, confidence / 50 AS tp, (order_id % 3) - 1 AS tr, quantity AS adx,
  entry_price * (1 + ((order_id % 29) - 14) / 100.0::DOUBLE) AS ema, actual AS bb, order_id % 31 = 0 AS res, (order_id % 37) / 40.0::DOUBLE AS rstr, order_id % 41 = 0 AS sup, (order_id % 43) / 40.0::DOUBLE AS sstr, (order_id % 47) / 10.0::DOUBLE AS brk, order_id % 59 - 1 AS lots FROM fills))""".replace("res > 0", "res").replace("sup > 0", "sup"), ("fills",))


def rejections(spark, sf):
    """Every check fed from the line item, so that each of them decides for some rows."""
    c, p, o = F.col, F.col("prediction"), F.col("order_id")
    sig = F.when(o % 97 == 5, "WAIT").when(p > 0.6, "STRONG_BUY").when(p > 0.2, "BUY").when(p < -0.6, "STRONG_SELL").when(p < -0.2, "SELL").otherwise("HOLD")
    d = D.fills(spark, sf).withColumns({
        "signal": sig, "age_seconds": o % 60, "edge_signal": F.when(o % 11 == 0, "HOLD").otherwise("BUY"), "open_side": F.when(o % 13 == 0, "long").when(o % 13 == 1, "short"),
        "price": F.when(o % 89 != 0, c("entry_price")), "volatility": F.when(o % 17 != 0, o % 53), "atr": c("entry_price") * ((o % 23) / 1000.0), "required": c("notional"), "cash": F.lit(80000.0), "risk_ok": o % 19 != 0,
        "sl_pct": F.lit(0.01), "tp_pct": c("confidence") / 50, "trend_15m": o % 3 - 1, "adx": c("quantity"), "ema_200": c("entry_price") * (1 + (o % 29 - 14) / 100.0), "bb_position": c("actual"),
        "at_resistance": (o % 31 == 0).cast("int"), "resistance_strength": (o % 37) / 40.0, "at_support": (o % 41 == 0).cast("int"), "support_strength": (o % 43) / 40.0, "breakout_score": (o % 47) / 10.0, "lots": o % 59 - 1})
    return d.withColumn("reason", A.reject_reason(A.EntryLimits(min_confidence=0.55, min_volatility=3.0, min_atr_pct=0.0015, breakout_floor=0.5)))


@query("reject_reason", "SELECT * FROM rj", ("rj",))
def reject_reason(spark, sf):
    return rejections(spark, sf).select("trade_id", "reason")


@query("filter_funnel", "SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM rj GROUP BY 1", ("rj",))
def filter_funnel(spark, sf):
    return rejections(spark, sf).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("market_flags", """SELECT symbol, bar_ts, list_filter([CASE WHEN rsi > 70 THEN 'overbought' END, CASE WHEN rsi < 30 THEN 'oversold' END, CASE WHEN v > 100 THEN 'high_volatility' END, CASE WHEN v < 60 THEN 'low_volatility' END], lambda v: v IS NOT NULL) AS flags FROM (SELECT symbol, bar_ts, %s AS rsi, coalesce(%s, 0) * 100 AS v FROM x)""", ("x",))
def market_flags(spark, sf):
    from barflow.functions.columns import reasons
    from barflow.operators import indicators as I
    d = S.framed(D.indexed(spark, sf), lambda x, r: (lambda y: y.withColumns({**I.rsi_sma(r, (14,)), **I.volatility(r)}))(I.base(x, r)), before=22)
    # The rule's limits fit calm prices; these bars swing far more.
    return d.select("symbol", "bar_ts", A.market_flags("rsi_14", "volatility_20", high=100.0, low=60.0).alias("flags"))


def _fill_market_flags():
    from barflow.plans.indicators import RSI, std
    from barflow.plans.registry import ORACLE
    body, uses = ORACLE["market_flags"]
    ORACLE["market_flags"] = (body % (RSI["rsi_14"], std("ret", 20, 1)), uses)


_fill_market_flags()


@query("perp_regime", """SELECT symbol, bar_ts, CASE WHEN fr > .0006 AND abs(fz) > 1 THEN 'x' END IS NOT NULL AS hot, CASE WHEN fr > .0003 AND abs(fz) > 1 THEN 'overheated_long' WHEN fr < -.0002 AND abs(fz) > 1 THEN 'overheated_short' WHEN basis_pct > .002 THEN 'contango_heavy' WHEN basis_pct < -.002 THEN 'backwardation' ELSE 'neutral' END AS perp_regime,
  CASE WHEN oc < -.3 THEN 'long' ELSE 'short' END AS squeeze_side, list_filter([CASE WHEN oc < -.3 THEN 'squeeze' END, CASE WHEN abs(oc) > .2 THEN 'book_pressure' END, CASE WHEN abs(fr) > .0005 THEN 'funding_cost' END], lambda v: v IS NOT NULL) AS notes FROM p2""", ("p2",))
def perp_regime(spark, sf):
    from barflow.functions.columns import flag
    from barflow.plans.patterns import perp
    d = perp(spark, sf)
    spike = flag(F.abs("funding_zscore") > 1)
    out = A.perp_regime("funding_rate", spike, "basis_pct", flag(F.col("oi_change_pct") < -0.3), F.lit(0), "oi_change_pct")
    hot = F.coalesce((F.col("funding_rate") > 0.0006) & (F.abs("funding_zscore") > 1), F.lit(False))
    return d.select("symbol", "bar_ts", hot.alias("hot"), *[e.alias(n) for n, e in out.items()])


# contract arithmetic ------------------------------------------------------------------------------


def _fills_lots(spark, sf):
    return D.fills(spark, sf).withColumns({"lots": F.col("quantity"), "lev": (F.col("order_id") % 20 + 1).cast("int"), "funding": F.col("prediction") / 1000})


cte("fx", "SELECT *, quantity AS lots, (order_id % 20 + 1)::INT AS lev, prediction / 1000 AS funding, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d FROM fills", ("fills",))


def fq(name, cols, sql, digits=6):
    """cols: output -> column builder; sql: output -> expression over fx."""

    @query(name, f"SELECT trade_id, {', '.join((f'round({e}, {digits})' if not c.startswith('!') else e) + ' AS ' + c.lstrip('!') for c, e in sql.items())} FROM fx", ("fx",))
    def run(spark, sf):
        return rounded(_fills_lots(spark, sf).select("trade_id", *[e().alias(c) for c, e in cols.items()]), digits)

    return run


LEG = X.leg_rate(0.0005, 5)
fq("futures_pnl", {"notional": lambda: X.notional("lots", "entry_price"), "gross": lambda: X.gross_pnl("entry_price", "exit_price", "lots", "side"),
                   "entry_fee": lambda: X.notional("lots", "entry_price") * LEG, "exit_fee": lambda: X.notional("lots", "exit_price") * LEG,
                   "net": lambda: X.gross_pnl("entry_price", "exit_price", "lots", "side") - (X.notional("lots", "entry_price") + X.notional("lots", "exit_price")) * LEG,
                   "equity": lambda: X.notional("lots", "entry_price") / F.col("lev") + X.gross_pnl("entry_price", "exit_price", "lots", "side")},
   {"notional": "lots * entry_price * .001", "gross": "d * (exit_price - entry_price) * lots * .001", "entry_fee": "lots * entry_price * .001 * .001", "exit_fee": "lots * exit_price * .001 * .001",
    "net": "d * (exit_price - entry_price) * lots * .001 - (lots * entry_price * .001 + lots * exit_price * .001) * .001", "equity": "lots * entry_price * .001 / lev + d * (exit_price - entry_price) * lots * .001"}, 9)
fq("liquidation_price", {"liq_long": lambda: X.liquidation_price("entry_price", "lev", F.lit("long")), "liq_short": lambda: X.liquidation_price("entry_price", "lev", F.lit("short"))},
   {"liq_long": "entry_price * (1 - 1.0::DOUBLE / lev + .0025::DOUBLE)", "liq_short": "entry_price * (1 + 1.0::DOUBLE / lev - .0025::DOUBLE)"}, 7)
fq("lot_sizing", {"size_lots": lambda: X.lots_for_margin("quantity", "entry_price", "lev")}, {"!size_lots": "greatest(1, least(100, floor(quantity * lev / (entry_price * .001::DOUBLE))))::INT"})
fq("round_to_tick", {"ticked": lambda: X.to_tick("entry_price", 0.5)}, {"ticked": "round_even(round_even(entry_price / .5::DOUBLE, 0) * .5::DOUBLE, 2)"})
fq("fee_adjusted_pnl", {"pnl_after": lambda: X.fee_adjusted_pnl("entry_price", "exit_price", "lots", "side", 0.0005, "funding")},
   {"pnl_after": "d * (exit_price - entry_price) * lots * .001::DOUBLE - 2 * .0005::DOUBLE * (lots * entry_price * .001::DOUBLE) - funding * (lots * entry_price * .001::DOUBLE)"}, 10)
fq("margin_inr", {"margin": lambda: X.margin_second_currency("lots", "entry_price", F.col("order_id") % 5 * 20.5, "lev")},
   {"margin": "CASE WHEN order_id % 5 > 0 THEN lots * entry_price * .001::DOUBLE / lev * (order_id % 5 * 20.5::DOUBLE) ELSE 0 END"}, 9)


def _levels(atr):
    return X.stop_target("entry_price", "side", F.col("confidence") / 10, F.when(F.col("order_id") % 4 != 0, F.col("confidence") / 5).otherwise(0.0), atr)


ATRX = "(CASE WHEN order_id % 3 <> 0 THEN quantity END)"
TPX = "(CASE WHEN order_id % 4 <> 0 THEN confidence / 5 ELSE 0 END)"
fq("sl_tp_levels", {"sl": lambda: _levels(None)[0], "tp": lambda: _levels(None)[1], "sl_atr": lambda: _levels(F.when(F.col("order_id") % 3 != 0, F.col("quantity")))[0],
                    "tp_atr": lambda: _levels(F.when(F.col("order_id") % 3 != 0, F.col("quantity")))[1]},
   {"sl": "entry_price - d * (entry_price * (confidence / 10))", "tp": f"entry_price + d * CASE WHEN {TPX} <> 0 THEN entry_price * {TPX} END",
    "sl_atr": f"entry_price - d * CASE WHEN {ATRX} > 0 THEN greatest(entry_price * (confidence / 10), {ATRX}) ELSE entry_price * (confidence / 10) END",
    "tp_atr": f"entry_price + d * CASE WHEN {ATRX} > 0 THEN greatest(entry_price * {TPX}, {ATRX} * 1.5) WHEN {TPX} <> 0 THEN entry_price * {TPX} END"}, 7)
fq("sl_tp_rebase", {"sl": lambda: X.rebase(_levels(None)[0], "entry_price", "exit_price"), "tp": lambda: X.rebase(_levels(None)[1], "entry_price", "exit_price")},
   {"sl": "entry_price - d * (entry_price * (confidence / 10)) + (exit_price - entry_price)", "tp": f"entry_price + d * CASE WHEN {TPX} <> 0 THEN entry_price * {TPX} END + (exit_price - entry_price)"}, 7)
RAW_SIDE = "CASE order_id % 6 WHEN 0 THEN ' long ' WHEN 1 THEN 'Short' WHEN 2 THEN 'buy' WHEN 3 THEN 'SELL' WHEN 4 THEN 'flat' END"
fq("side_normalize", {"normal": lambda: X.normal_side(F.expr(RAW_SIDE))}, {"!normal": "CASE order_id % 6 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'BUY' WHEN 3 THEN 'SELL' WHEN 4 THEN NULL ELSE 'BUY' END"})

@query("kelly_size", "SELECT trade_id, round(greatest(0, least(CASE WHEN least(k, .1) > .08 THEN .08 ELSE least(k, .1) END, .1)), 9) AS size FROM (SELECT *, (confidence * 2 - (1 - confidence)) * .25 * abs(prediction) * confidence AS k FROM fx)", ("fx",))
def kelly_size(spark, sf):
    k = X.kelly("prediction", "confidence", "confidence", F.lit(2.0), F.lit(1.0), F.lit(0.08))
    return rounded(D.fills(spark, sf).select("trade_id", k.alias("size")), 9)


@query("futures_size", """SELECT trade_id, lev AS leverage, round(sh, 9) AS size, round(mg, 6) AS margin, CASE WHEN entry_price > 0 THEN greatest(1, least(100, floor(mg * lev / (entry_price * .001::DOUBLE))))::INT ELSE 0 END AS lots, round(entry_price * (1 - 1.0::DOUBLE / lev + .0025::DOUBLE), 6) AS liq_long FROM
  (SELECT *, greatest(1, least(20, round_even(5 * confidence * pen, 0)))::INT AS lev, greatest(.01, least(.1 * confidence * vm * pen, .1)) AS sh, 2000 * greatest(.01, least(.1 * confidence * vm * pen, .1)) AS mg FROM (SELECT * EXCLUDE (lev), CASE WHEN abs(funding) > .0003 THEN .5 ELSE 1 END::DOUBLE AS pen,
   CASE WHEN quantity / 1000 > .05 THEN .5 WHEN quantity / 1000 > .03 THEN .7 ELSE 1 END::DOUBLE AS vm FROM fx))""", ("fx",))
def futures_size(spark, sf):
    d = _fills_lots(spark, sf)
    out = X.futures_size("entry_price", "confidence", "funding", F.col("quantity") / 1000, F.lit(2000.0))
    return rounded(d.select("trade_id", *[out[k].alias(k) for k in ("leverage", "size", "margin", "lots", "liq_long")]), 6, {"size": 9})


fq("ob_imbalance", {"imbalance": lambda: X.imbalance(F.col("quantity") - 1, F.col("lev") - 1)}, {"imbalance": "coalesce(((quantity - 1) - (lev - 1)) / nullif((quantity - 1) + (lev - 1), 0), 0)"}, 9)
