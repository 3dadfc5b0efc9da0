"""Registered portfolio, equity, risk and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.columns import rounded
from barflow.operators import indicators as I
from barflow.operators import portfolio as P
from barflow.operators import series as S
from barflow.operators import similarity as V
from barflow.plans import domain as D
from barflow.plans.indicators import scanned
from barflow.plans.registry import cte, query
from barflow.session import stage

FX, START = 83.0, 1_000_000.0


def positions(spark, sf):
    cur = F.when(F.col("order_id") % 7 != 0, F.col("exit_price"))
    return D.positions(spark, sf).withColumns({"current_price": cur, "realized_pnl": F.col("pnl"), "stop_loss": F.floor(F.col("entry_price") * 95) / 100})


cte("pos", "SELECT *, CASE WHEN order_id % 7 <> 0 THEN exit_price END AS current_price, pnl AS realized_pnl, floor(entry_price * 95) / 100 AS stop_loss, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d FROM positions", ("positions",))


@query("portfolio_summary", """SELECT symbol, o AS open_positions, round(u, 6) AS unrealized, round(m, 6) AS margin, round(r, 2) AS realized, round(greatest(0, 1000000 + (r - m) * 83), 2) AS available, round(1000000 + (u + r) * 83, 2) AS total_value FROM
  (SELECT symbol, count(*) FILTER (status = 'OPEN') AS o, sum(d * (coalesce(current_price, entry_price) - entry_price) * quantity * .001::DOUBLE) FILTER (status = 'OPEN') AS u, sum(quantity * entry_price * .001::DOUBLE / 5) FILTER (status = 'OPEN') AS m, sum(realized_pnl) FILTER (status = 'CLOSED') AS r FROM pos GROUP BY 1)""", ("pos",))
def portfolio_summary(spark, sf):
    return rounded(P.summary(positions(spark, sf), FX, 5, START, ["symbol"]), 6, {"realized": 2, "available": 2, "total_value": 2})


CLOSED = """SELECT 'closed_' || trade_id AS trade_id, symbol, side, quantity, entry_price, coalesce(current_price, entry_price) AS exit_price, realized_pnl AS pnl_usd, round(realized_pnl * 83, 4) AS pnl, opened_at AS entry_time, closed_at AS exit_time,
  greatest(0, floor(epoch(closed_at - opened_at)))::BIGINT AS duration_seconds FROM pos WHERE status = 'CLOSED'"""


@query("recent_closed", f"SELECT * FROM ({CLOSED}) ORDER BY exit_time DESC, trade_id DESC LIMIT 50 OFFSET 10", ("pos",))
def recent_closed(spark, sf):
    return rounded(P.page(P.closed_trades(positions(spark, sf), FX), ["exit_time", "trade_id"], 50, 10), 4)


@query("filtered_page", "SELECT trade_id, symbol, side, pnl, closed_at FROM pos WHERE symbol = 'S3' AND status = 'OPEN' AND closed_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31' ORDER BY closed_at DESC, trade_id DESC LIMIT 25 OFFSET 25", ("pos",))
def filtered_page(spark, sf):
    n = lambda s: F.lit(s).cast("timestamp_ntz")
    d = positions(spark, sf).filter((F.col("symbol") == "S3") & (F.col("status") == "OPEN") & F.col("closed_at").between(n("1997-01-01"), n("1999-12-31")))
    return P.page(d.select("trade_id", "symbol", "side", "pnl", "closed_at"), ["closed_at", "trade_id"], 25, 25)


@query("pnl_summary", "SELECT count(*) AS trades, round(sum(pnl), 2) AS total, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(count(*) FILTER (pnl > 0) / count(*), 8) AS win_rate FROM (SELECT pnl FROM pos WHERE status = 'CLOSED' AND symbol IN ('S1', 'S2') ORDER BY closed_at DESC, trade_id DESC LIMIT 500)", ("pos",))
def pnl_summary(spark, sf):
    d = positions(spark, sf).filter((F.col("status") == "CLOSED") & F.col("symbol").isin("S1", "S2"))
    return rounded(P.pnl_summary(P.page(d, ["closed_at", "trade_id"], 500)), 8, {"total": 2})


@query("trade_count", "SELECT count(*) AS trades FROM pos WHERE status = 'CLOSED' AND closed_at >= (SELECT max(closed_at) FROM pos) - INTERVAL '365 days'", ("pos",))
def trade_count(spark, sf):
    p = positions(spark, sf)
    since = p.agg((F.max("closed_at") - F.expr("INTERVAL 365 DAYS")).alias("t")).scalar()
    return p.filter((F.col("status") == "CLOSED") & (F.col("closed_at") >= since)).agg(F.count(F.lit(1)).alias("trades"))


# equity -----------------------------------------------------------------------------------------


def daily(spark, sf):
    return D.fills(spark, sf).groupBy("symbol", "ts").agg((F.sum(F.round(F.col("pnl") * 100).cast("bigint")) / 100.0).alias("pnl"))


def curve(spark, sf):
    c = P.equity_curve(stage(daily(spark, sf)), START * 20, ["symbol"])
    return S.index_series(stage(c), ["symbol"], ("ts",), bin_seconds=P.MONTH)


cte("dy", "SELECT symbol, ts, CAST(sum(round(pnl * 100)::BIGINT) AS BIGINT) / 100.0::DOUBLE AS pnl FROM fills GROUP BY ALL", ("fills",))
cte("eq", "SELECT *, max(equity) OVER w AS peak, lag(equity) OVER w AS pe, row_number() OVER w AS rn FROM (SELECT *, 20000000 + sum(pnl) OVER w AS equity FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WINDOW w AS (PARTITION BY symbol ORDER BY ts)", ("dy",))
cte("eqh", """SELECT symbol, h, last_value(equity IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY h) AS equity FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS h FROM eq GROUP BY 1) g LEFT JOIN (SELECT symbol AS s2, ts, equity FROM eq) e ON e.s2 = g.symbol AND e.ts = g.h""", ("eq",))


@query("equity_metrics", """SELECT symbol, round(m / (s + 1e-9) * sqrt(8760), 6) AS sharpe, round(CASE WHEN ln > 2 THEN m / (ld + 1e-9) * sqrt(8760) ELSE 0 END, 6) AS sortino, round(dd, 8) AS max_drawdown, round(le / fe - 1, 8) AS total_return FROM
  (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s, count(*) FILTER (r < 0) AS ln, stddev_samp(r) FILTER (r < 0) AS ld FROM (SELECT symbol, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY h) - 1 AS r FROM eqh) GROUP BY 1)
  JOIN (SELECT symbol, min(equity / peak - 1) AS dd, arg_min(equity, ts) AS fe, arg_max(equity, ts) AS le FROM eq GROUP BY 1) USING (symbol)""", ("eqh", "eq"))
def equity_metrics(spark, sf):
    return rounded(P.equity_metrics(curve(spark, sf), ["symbol"]), 6, {"max_drawdown": 8, "total_return": 8})


@query("equity_metrics_bar", "SELECT symbol, round(avg(equity / pe - 1) / (stddev_samp(equity / pe - 1) + 1e-9) * sqrt(252), 6) AS sharpe, round(min(equity / peak - 1), 8) AS max_drawdown, round(arg_max(equity, rn) / arg_min(equity, rn) - 1, 8) AS cum_return FROM eq GROUP BY 1", ("eq",))
def equity_metrics_bar(spark, sf):
    return rounded(P.bar_metrics(curve(spark, sf), ["symbol"]), 6, {"max_drawdown": 8, "cum_return": 8})


@query("drawdown", "SELECT symbol, ts, round(equity, 2) AS equity, round(peak, 2) AS peak, round(equity / peak - 1, 8) AS drawdown FROM eq", ("eq",))
def drawdown(spark, sf):
    c = P.equity_curve(stage(daily(spark, sf)), START * 20, ["symbol"])
    return rounded(c.select("symbol", "ts", "equity", "peak", "drawdown"), 8, {"equity": 2, "peak": 2})


@query("trade_stats", """SELECT symbol, count(*) AS trades, round(count(*) FILTER (pnl_pct > 0) / count(*), 8) AS win_rate, round(sum(pnl_pct) FILTER (pnl_pct > 0) / abs(sum(pnl_pct) FILTER (pnl_pct <= 0)), 8) AS profit_factor,
  round(count(*) FILTER (pnl_pct > 0) / count(*) * coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0) - (1 - count(*) FILTER (pnl_pct > 0) / count(*)) * abs(coalesce(avg(pnl_pct) FILTER (pnl_pct <= 0), 0)), 8) AS expectancy,
  count(*) FILTER (exit_reason = 'sl') AS exit_sl, count(*) FILTER (exit_reason = 'sl_gap') AS exit_sl_gap, count(*) FILTER (exit_reason = 'tp') AS exit_tp, count(*) FILTER (exit_reason = 'timeout') AS exit_timeout FROM
  (SELECT symbol, exit_reason, signal * (exit - entry) / entry - 2 * .0005::DOUBLE AS pnl_pct FROM so1) GROUP BY 1""", ("so1",))
def trade_stats(spark, sf):
    from barflow.plans.labels import outcomes
    d = outcomes(spark, sf).withColumn("pnl", F.col("pnl_pct"))
    return rounded(P.trade_stats(d, ["symbol"], "exit_reason", ("sl", "sl_gap", "tp", "timeout")), 8)


@query("buy_hold", "SELECT symbol, bar_ts, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY i)), 6) AS growth FROM x", ("x",))
def buy_hold(spark, sf):
    d = I.with_base(D.indexed(spark, sf))
    return rounded(P.growth(d, "_ret", S.KEYS).select("symbol", "bar_ts", "growth"))


@query("running_performance", """SELECT trade_id, trades, round(total_pnl, 2) AS total_pnl, round(w / trades, 8) AS win_rate, round(pv, 2) AS portfolio_value, round(greatest(0, max(CASE WHEN pnl < 0 THEN -pnl / (pv - pnl) ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, trade_id)), 8) AS max_drawdown FROM
  (SELECT *, 20000000 + total_pnl AS pv FROM (SELECT *, count(*) OVER w AS trades, sum(pnl) OVER w AS total_pnl, count(*) FILTER (pnl > 0) OVER w AS w FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)))""", ("fills",))
def running_performance(spark, sf):
    d = P.running_performance(D.fills(spark, sf).select("symbol", "ts", "trade_id", "pnl"), ["symbol"], START * 20)
    return rounded(d.select("trade_id", "trades", "total_pnl", "win_rate", "portfolio_value", "max_drawdown"), 8, {"total_pnl": 2, "portfolio_value": 2})


@query("trailing_stop", """SELECT symbol, bar_ts, round(max(close - 1.5::DOUBLE * atr_e) OVER w, 6) AS long_stop, round(min(close + 1.5::DOUBLE * atr_e) OVER w, 6) AS short_stop FROM (SELECT *, i // 100 AS trade FROM xw) WINDOW w AS (PARTITION BY symbol, trade ORDER BY i)""", ("xw",))
def trailing_stop(spark, sf):
    d = scanned(spark, sf, [S.ema("atr", "_tr0", 14)]).withColumn("trade", F.floor(F.col("bar_idx") / 100))
    keys = [*S.KEYS, "trade"]
    d = P.trailing_stops(stage(d.select(*S.KEYS, "bar_idx", "bar_ts", "close", "atr", "trade")), keys, 1.5)
    return rounded(d.select("symbol", "bar_ts", "long_stop", "short_stop"))


# exposure and risk ------------------------------------------------------------------------------

cte("imp", """SELECT *, d * (exit_price - entry_price) * quantity * .001::DOUBLE AS pc, abs(d * (exit_price - entry_price) * quantity * .001::DOUBLE) / (quantity * entry_price * .001::DOUBLE) AS pp FROM (SELECT * REPLACE (exit_price AS current_price) FROM pos)""", ("pos",))
cte("imp2", "SELECT *, CASE WHEN pp > .10 THEN 3 WHEN pp > .05 THEN 2 WHEN pp > .02 THEN 1 ELSE 0 END AS lv, (side = 'BUY' AND exit_price <= stop_loss) OR (side = 'SELL' AND exit_price >= stop_loss) AS br FROM imp", ("imp",))
LV = "['low', 'medium', 'high', 'critical']"


def impacts(spark, sf):
    return P.impact(positions(spark, sf).withColumn("current_price", F.col("exit_price")))


@query("position_impact", f"SELECT trade_id, round(pc, 8) AS pnl_change, round(pp, 7) AS pnl_percent, {LV}[lv + 1] AS risk_level, br AS stop_breached FROM imp2", ("imp2",))
def position_impact(spark, sf):
    return rounded(impacts(spark, sf).select("trade_id", "pnl_change", "pnl_percent", "risk_level", "stop_breached"), 8, {"pnl_percent": 7})


@query("impact_rollup", f"SELECT symbol, round(sum(pc), 6) AS total_pnl, {LV}[max(lv) + 1] AS risk_level, bool_or(br) AS any_stop, count(*) AS positions FROM imp2 GROUP BY symbol", ("imp2",))
def impact_rollup(spark, sf):
    return rounded(P.impact_rollup(impacts(spark, sf), ["symbol"]))


@query("roe", "SELECT trade_id, round(CASE WHEN m > 0 THEN pnl / m END, 7) AS roe FROM (SELECT *, (order_id % 4) * 1000.0::DOUBLE AS m FROM fills)", ("fills",))
def roe(spark, sf):
    return rounded(D.fills(spark, sf).select("trade_id", P.return_on_margin("pnl", (F.col("order_id") % 4) * 1000.0).alias("roe")), 7)


@query("risk_score", """SELECT account, round(ex, 2) AS exposure, round(lev, 8) AS leverage, round(dr, 8) AS drawdown, n AS open_positions, round(least(1, CASE WHEN dr > .15 THEN .4 WHEN dr > .15 * .7 THEN .2 ELSE 0 END + CASE WHEN lev > 5 THEN .3 WHEN lev > 4 THEN .15 ELSE 0 END + CASE WHEN n >= 5 THEN .2 WHEN n > 4 THEN .1 ELSE 0 END + CASE WHEN big / nullif(ex, 0) > .5 THEN .15 ELSE 0 END), 6) AS risk_score, n < 5 AS can_trade FROM
  (SELECT *, ex / cash AS lev, (greatest(peak, tot) - tot) / greatest(peak, tot) AS dr FROM (SELECT *, cash + ex + u AS tot FROM (SELECT c_custkey AS account, 5000 + abs(c_acctbal) AS cash, 6000 + abs(c_acctbal) * 1.2::DOUBLE AS peak, coalesce(ex, 0) AS ex, coalesce(big, 0) AS big, coalesce(u, 0) AS u, coalesce(n, 0) AS n FROM customer LEFT JOIN
   (SELECT account, sum(entry_price * quantity) AS ex, max(entry_price * quantity) AS big, sum(pnl) AS u, count(*) AS n FROM pos WHERE status = 'OPEN' GROUP BY 1) ON account = c_custkey)))""", ("pos",))
def risk_score(spark, sf):
    a = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), (5000 + F.abs("c_acctbal")).alias("cash"), (6000 + F.abs("c_acctbal") * 1.2).alias("peak"))
    p = positions(spark, sf).filter(F.col("status") == "OPEN")
    return rounded(P.risk_score(p, a, ["account"]), 8, {"exposure": 2, "risk_score": 6})


@query("trade_sharpe", "SELECT model, round((avg(r) - .02) / stddev_samp(r), 7) AS sharpe FROM (SELECT model, pnl / notional AS r FROM fills) GROUP BY 1", ("fills",))
def trade_sharpe(spark, sf):
    return rounded(P.trade_sharpe(D.fills(spark, sf).withColumn("value", F.col("notional")), ["model"]), 7)


@query("allocation", """SELECT ts, symbol, round(CASE WHEN n > 3 AND kept > 0 THEN a / kept ELSE a END, 8) AS allocation FROM (SELECT *, sum(a) OVER (PARTITION BY ts) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY a DESC, symbol) AS rk FROM
  (SELECT *, CASE WHEN st = 0 THEN 1.0::DOUBLE / n ELSE abs(prediction) / st END * .6::DOUBLE AS a FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS n, sum(abs(prediction)) OVER (PARTITION BY ts) AS st FROM
   (SELECT ts, symbol, CAST(sum(round(prediction * 100)::BIGINT) AS BIGINT) / 128.0::DOUBLE AS prediction FROM fills GROUP BY ALL)))) WHERE rk <= 3)""", ("fills",))
def allocation(spark, sf):
    d = D.fills(spark, sf).groupBy("ts", "symbol").agg((F.sum(F.round(F.col("prediction") * 100).cast("bigint")) / 128.0).alias("prediction"))
    return rounded(P.allocation(d, ["ts"], F.lit("high"), 3).select("ts", "symbol", "allocation"), 8)


@query("daily_loss_breach", """SELECT symbol, CAST(ts AS DATE) AS day, round(sum(pnl), 2) AS daily_pnl, list_filter([CASE WHEN sum(pnl) < -.02 * 400000 THEN 'daily_loss_limit' END, CASE WHEN max(coalesce(n, 0)) >= 2000 THEN 'max_open_positions' END], lambda v: v IS NOT NULL) AS breaches
  FROM fills LEFT JOIN (SELECT symbol, count(*) AS n FROM pos WHERE status = 'OPEN' GROUP BY 1) USING (symbol) GROUP BY 1, 2""", ("fills", "pos"))
def daily_loss_breach(spark, sf):
    o = positions(spark, sf).filter("status = 'OPEN'").groupBy("symbol").agg(F.count(F.lit(1)).alias("open_positions"))
    return rounded(P.daily_breach(D.fills(spark, sf), ["symbol"], 0.02, 400_000.0, o, 2000), 2)


SIGNAL = "CASE WHEN prediction > .3 THEN 'BUY' WHEN prediction < -.3 THEN 'SELL' ELSE 'HOLD' END"


def contexts(spark, sf):
    from barflow.operators.decisions import discrete_signal
    f = D.fills(spark, sf)
    return f.select("symbol", "ts", discrete_signal("prediction").alias("signal"), F.when(F.col("order_id") % 5 != 0, F.col("pnl")).alias("pnl"))


cte("ctx", f"SELECT symbol, ts, {SIGNAL} AS signal, CASE WHEN order_id % 5 <> 0 THEN pnl END AS pnl FROM fills", ("fills",))


@query("decision_patterns", "SELECT signal, count(*) AS count, count(*) FILTER (pnl > 0) AS profitable, count(*) FILTER (pnl <= 0) AS unprofitable, count(*) FILTER (pnl IS NULL) AS unknown, round(coalesce(count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 0), 8) AS success_rate FROM ctx WHERE ts >= (SELECT max(ts) FROM ctx) - INTERVAL '700 days' GROUP BY ROLLUP (signal)", ("ctx",))
def decision_patterns(spark, sf):
    c = contexts(spark, sf)
    since = c.agg((F.max("ts") - F.expr("INTERVAL 700 DAYS")).alias("t")).scalar()
    return rounded(P.decision_patterns(c.filter(F.col("ts") >= since)), 8)


@query("context_stats", "SELECT symbol, count(*) AS contexts, min(ts) AS oldest, max(ts) AS newest, round(avg((pnl IS NOT NULL)::INT), 8) AS outcome_share FROM ctx GROUP BY ROLLUP (symbol)", ("ctx",))
def context_stats(spark, sf):
    return rounded(P.context_stats(contexts(spark, sf)), 8)


@query("health_score", """SELECT symbol, round(s, 8) AS score, CASE WHEN s >= .9 THEN 'healthy' WHEN s >= .6 THEN 'degraded' ELSE 'unhealthy' END AS status FROM (SELECT symbol, sum(w * CASE WHEN c % 3 = 0 THEN 1 WHEN c % 3 = 1 THEN .5 ELSE 0 END)::DOUBLE AS s FROM
  (SELECT symbol, CASE model WHEN 'FA' THEN .15 WHEN 'FN' THEN .2 WHEN 'FR' THEN .25 WHEN 'OA' THEN .15 WHEN 'ON' THEN .15 ELSE .1 END AS w, count(*) AS c FROM fills GROUP BY symbol, model) GROUP BY 1)""", ("fills",))
def health_score(spark, sf):
    w = {"FA": 0.15, "FN": 0.2, "FR": 0.25, "OA": 0.15, "ON": 0.15, "OR": 0.1}
    table = F.create_map(*[F.lit(x) for p in w.items() for x in p])
    c = D.fills(spark, sf).groupBy("symbol", "model").agg((F.count(F.lit(1)) % 3).alias("k"))
    return rounded(P.health_score(c.select("symbol", table[F.col("model")].alias("weight"), F.when(F.col("k") == 0, "up").when(F.col("k") == 1, "degraded").otherwise("down").alias("state")), ["symbol"]), 8)


@query("edge_history", "SELECT ts, trade_id, prediction AS edge FROM fills WHERE symbol = 'S5' ORDER BY ts DESC, trade_id DESC LIMIT 100", ("fills",))
def edge_history(spark, sf):
    f = D.fills(spark, sf).filter("symbol = 'S5'").select("ts", "trade_id", F.col("prediction").alias("edge"))
    return P.page(f, ["ts", "trade_id"], 100)


@query("prediction_outcome", "SELECT f.trade_id, f.model, f.confidence, p.status, p.pnl AS outcome FROM fills f LEFT JOIN (SELECT * FROM pos WHERE status = 'CLOSED') p USING (trade_id)", ("fills", "pos"))
def prediction_outcome(spark, sf):
    p = positions(spark, sf).filter("status = 'CLOSED'").select("trade_id", "status", F.col("pnl").alias("outcome"))
    return D.fills(spark, sf).select("trade_id", "model", "confidence").join(p, "trade_id", "left")


# similarity -------------------------------------------------------------------------------------

SIM = """SELECT q.vec_id AS query_id, e.vec_id, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM (SELECT max(vec_id) AS vec_id, arg_max(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q JOIN embeddings e ON q.vec_id <> e.vec_id"""


def queries_of(spark, sf):
    """The newest context of each label, looked up in the whole memory."""
    e = D.table(spark, sf, "embeddings")
    return e.groupBy("label").agg(F.max("vec_id").alias("query_id"), F.max_by("embedding", "vec_id").alias("query")).drop("label"), e


@query("similar_topk", f"SELECT query_id, vec_id, round(sim, 6) AS similarity FROM ({SIM}) WHERE sim >= .1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5")
def similar_topk(spark, sf):
    q, e = queries_of(spark, sf)
    return rounded(V.similar_topk(q, e, 5, 0.1).select("query_id", "vec_id", "similarity"))


@query("similar_all", """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
  WHERE list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= .1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) <= 3""")
def similar_all(spark, sf):
    """Every context against the whole memory."""
    e = D.table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(V.similar_topk(q, e, 3, 0.1).select("query_id", "vec_id", "similarity"))


@query("similar_with_outcome", f"SELECT query_id, vec_id, label, round(sim, 6) AS similarity FROM (SELECT * FROM ({SIM}) WHERE sim >= .1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10) WHERE label % 2 = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5")
def similar_with_outcome(spark, sf):
    q, e = queries_of(spark, sf)
    return rounded(V.similar_with_outcome(q, e, 5, 0.1, F.col("label") % 2 == 1).select("query_id", "vec_id", "label", "similarity"))


@query("context_embedding", """SELECT vec_id, list_transform(raw, lambda v: round(v / n, 6) + 0.0::DOUBLE) AS embedding FROM (SELECT *, sqrt(list_sum(list_transform(raw, lambda v: v * v))) AS n FROM (SELECT vec_id, list_concat(list_transform(embedding, lambda v: v::DOUBLE), [least(1, vec_id % 7 / 100.0::DOUBLE * 50), (label % 3 = 0)::INT, (label % 3 = 1)::INT, (label % 3 = 2)::INT, .25, sin(2 * pi() * (vec_id % 24) / 24), cos(2 * pi() * (vec_id % 24) / 24), 0, 0, 0]::DOUBLE[]) AS raw FROM embeddings))""")
def context_embedding(spark, sf):
    from barflow.functions.vectors import context_embedding as build
    e = D.table(spark, sf, "embeddings")
    k = F.col("label") % 3
    ts = F.timestamp_seconds(F.col("vec_id") % 24 * 3600)
    v = build(F.col("embedding"), F.col("vec_id") % 7 / 100.0, F.when(k == 0, "bull").when(k == 1, "bear").otherwise("neutral"), F.lit(0.25), ts)
    return e.select("vec_id", F.transform(v, lambda x: F.round(x, 6) + 0.0).alias("embedding"))
