"""Registered log, ledger, event and reconciliation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barflow.functions.columns import micros, rounded
from barflow.operators import logs as L
from barflow.plans import domain as D
from barflow.plans.registry import cte, query
from barflow.session import shared_folder
from barflow.sources import events as E
from barflow.sources import ledger as G
from barflow.sources import logs as SL

LEVEL = "CASE WHEN k % 10 < 2 THEN 'ERROR' WHEN k % 10 = 2 THEN 'WARNING' WHEN k % 50 = 3 THEN 'CRITICAL' ELSE 'INFO' END"
MESSAGE = ("CASE WHEN k % 4 = 0 THEN 'Timeout after ' || k || ' ms for user ' || user_id || ' at 2024-01-02 03:04:05' WHEN k % 4 = 1 THEN 'Unhandled exception in handler deadbeef' || (10 + k) || ' step ' || user_id "
           "WHEN k % 4 = 2 THEN 'Order rejected  by venue ' || k ELSE 'ok ' || k END")


def logs(spark, sf):
    t = D.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return t.select("event_id", F.col("ts").alias("timestamp"), F.expr(LEVEL).alias("level"), F.expr("'svc' || (user_id % 5)").alias("service"), F.col("event_type").alias("component"),
                    F.expr(MESSAGE).alias("message"), F.expr("CASE k % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' END").alias("error_type"),
                    F.expr("CASE WHEN k % 7 = 0 THEN 'Traceback' END").alias("stack_trace"), "user_id", "k")


cte("logs", f"""SELECT event_id, ts AS timestamp, {LEVEL} AS level, 'svc' || (user_id % 5) AS service, event_type AS component, {MESSAGE} AS message, CASE k % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' END AS error_type,
  CASE WHEN k % 7 = 0 THEN 'Traceback' END AS stack_trace, user_id, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
ERR = "level IN ('ERROR', 'CRITICAL')"


def lines(spark, sf):
    """Log lines in every shape the parser knows, and some it must drop."""
    d = logs(spark, sf)
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    js1 = F.to_json(F.struct(F.concat(iso, F.lit("Z")).alias("timestamp"), F.lower("level").alias("level"), "service", "component", "message", F.struct(F.coalesce("error_type", F.lit("None")).alias("type"), F.lit("m").alias("message")).alias("error")))
    js2 = F.to_json(F.struct(iso.alias("time"), F.col("component").alias("logger"), F.col("message").alias("msg"), F.concat(F.lit("r"), "event_id").alias("request_id"), "error_type"))
    shape = F.col("event_id") % 6
    line = (F.when(shape == 0, js1).when(shape == 1, js2).when(shape == 2, F.concat(F.lit("["), at, F.lit("] "), "level", F.lit(": "), "message"))
            .when(shape == 3, F.concat(at, F.lit(" "), "level", F.lit(" "), "message")).when(shape == 4, F.concat(F.lower("level"), F.lit(": "), "message")).otherwise(F.lit("--- no shape ---")))
    return d.select("event_id", line.alias("line"), F.lit("agent").alias("stem"))


@query("log_parse", """SELECT event_id, CASE WHEN s <> 4 THEN date_trunc('second', timestamp) END AS timestamp, CASE WHEN s = 1 THEN 'INFO' ELSE level END AS level, CASE WHEN s = 0 THEN service ELSE 'agent' END AS service, CASE WHEN s < 2 THEN component END AS component, message,
  CASE WHEN s = 1 THEN 'r' || event_id END AS correlation_id, CASE WHEN s = 0 THEN coalesce(error_type, 'None') WHEN s = 1 THEN error_type END AS error_type FROM (SELECT *, event_id % 6 AS s FROM logs) WHERE s < 5""", ("logs",))
def log_parse(spark, sf):
    return SL.parse_logs(lines(spark, sf)).select("event_id", "timestamp", "level", "service", "component", "message", "correlation_id", "error_type")


@query("error_report", f"""SELECT kind, key, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, key) AS rank FROM (SELECT 'error_type' AS kind, coalesce(error_type, 'UnknownError') AS key, count(*) AS count FROM logs WHERE {ERR} GROUP BY 2
  UNION ALL SELECT 'component', component, count(*) FROM logs WHERE {ERR} GROUP BY 2 UNION ALL SELECT 'warning', message, count(*) FROM logs WHERE level = 'WARNING' GROUP BY 2)) WHERE rank <= 10""", ("logs",))
def error_report(spark, sf):
    return L.error_report(logs(spark, sf))


@query("recent_errors", f"SELECT event_id, timestamp, level, message FROM logs WHERE {ERR} ORDER BY timestamp DESC, event_id LIMIT 50", ("logs",))
def recent_errors(spark, sf):
    return L.recent(logs(spark, sf), 50, "event_id").select("event_id", "timestamp", "level", "message")


cte("pat", r"""SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(message), '\d{4}-\d{2}-\d{2}[\st]\d{2}:\d{2}:\d{2}', '', 'g'), '\b[a-f0-9]{8,}\b', '', 'g'), '\d+', '', 'g'), '\s+', ' ', 'g')) AS pattern FROM logs WHERE level IN ('ERROR', 'CRITICAL')""", ("logs",))


@query("error_patterns", """SELECT p.pattern, count, first_seen, last_seen, services, components, samples FROM (SELECT pattern, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, list_sort(list(DISTINCT service)) AS services, list_sort(list(DISTINCT component)) AS components FROM pat WHERE length(pattern) >= 10 GROUP BY 1 HAVING count(*) > 1) p
  JOIN (SELECT pattern, list(message ORDER BY a, message) AS samples FROM (SELECT pattern, message, min(timestamp) AS a FROM pat GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY min(timestamp), message) <= 3) GROUP BY 1) s USING (pattern)""", ("pat",))
def error_patterns(spark, sf):
    return L.error_patterns(logs(spark, sf).filter(L.is_error()))


UNH = f"{ERR} AND (lower(message) LIKE '%exception%' OR lower(message) LIKE '%traceback%' OR stack_trace IS NOT NULL)"


@query("log_slices", f"""SELECT event_id, s AS slice FROM (SELECT event_id, unnest(list_filter([CASE WHEN {UNH} THEN 'unhandled' END, CASE WHEN regexp_matches(lower(message), 'timeout|slow|latency|performance') THEN 'performance' END,
  CASE WHEN lower(message) LIKE '%exception%' AND error_type IS NULL THEN 'untyped_exception' END], lambda v: v IS NOT NULL)) AS s FROM logs)""", ("logs",))
def log_slices(spark, sf):
    return L.slices(logs(spark, sf)).select("event_id", "slice")


@query("log_health", f"""SELECT service, entries, errors, warnings, critical, unhandled, round(greatest(0, 1.0::DOUBLE - least(.5, 2 * errors / entries) - least(.2, .5 * warnings / entries) - least(.3, .1 * critical) - least(.2, .05 * unhandled)), 8) AS score FROM
  (SELECT service, count(*) AS entries, count(*) FILTER ({ERR}) AS errors, count(*) FILTER (level = 'WARNING') AS warnings, count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER ({UNH}) AS unhandled FROM logs GROUP BY 1)""", ("logs",))
def log_health(spark, sf):
    return rounded(L.health(logs(spark, sf), ["service"]), 8)


@query("error_rate", f"""SELECT m + INTERVAL '5 minutes' AS "at", count(*) AS errors, round(count(*) / 5.0::DOUBLE, 6) AS per_minute FROM (SELECT unnest(generate_series(date_trunc('minute', timestamp) - INTERVAL '4 minutes', date_trunc('minute', timestamp), INTERVAL '1 minute')) AS m FROM logs WHERE {ERR}) GROUP BY 1""", ("logs",))
def error_rate(spark, sf):
    from barflow.streaming.windows import error_rate as rate
    d = rate(logs(spark, sf).filter(L.is_error()), "timestamp")
    return rounded(d.select(F.col("at").cast("timestamp_ntz").alias("at"), "errors", "per_minute"))


# ledger -----------------------------------------------------------------------------------------


def ledger_lines(spark, sf):
    p = D.positions(spark, sf)
    ts = F.date_format("opened_at", "yyyy-MM-dd'T'HH:mm:ss")
    head = F.concat_ws("|", F.lit("TRADE"), ts, "trade_id", "symbol", "side", "quantity", "entry_price", F.concat(F.lit("order_id="), "order_id"), F.concat(F.lit("position_id="), "trade_id"), F.lit("reasoning_chain_id="), F.concat(F.lit("fees_inr="), "account"))
    tail = F.concat_ws("|", F.lit("CLOSE"), ts, "trade_id", "symbol", "side", "entry_price", "exit_price", "quantity", "pnl", "status", F.concat(F.lit("net_pnl_inr="), F.col("pnl") * 83), F.lit("note=a=b"))
    both = F.array(head, F.when(F.col("status") != "OPEN", tail), F.when(F.col("account") % 10 == 0, F.lit("# comment")))
    return p.select("trade_id", F.concat(F.lit("ledger-"), F.col("account") % 3).alias("file"), F.explode(F.array_compact(both)).alias("line"))


@query("ledger_parse", """SELECT trade_id, opened_at AS time, symbol, side, quantity, entry_price AS price, order_id::VARCHAR AS order_id, '' AS chain, NULL AS pnl, NULL AS exit_reason, NULL AS note FROM positions
  UNION ALL SELECT trade_id, opened_at, symbol, side, quantity, exit_price, NULL, NULL, pnl, status, 'a=b' FROM positions WHERE status <> 'OPEN'""", ("positions",))
def ledger_parse(spark, sf):
    d = ledger_lines(spark, sf).select("line")
    a, n = F.col("attributes"), lambda t: F.lit(None).cast(t)
    at = F.col("time").cast("timestamp_ntz").alias("time")
    t = G.parse_trades(d).select("trade_id", at, "symbol", "side", "quantity", "price", a["order_id"].alias("order_id"), a["reasoning_chain_id"].alias("chain"), n("double").alias("pnl"), n("string").alias("exit_reason"), n("string").alias("note"))
    c = G.parse_closes(d).select(F.col("position_id").alias("trade_id"), at, "symbol", "side", "quantity", F.col("exit_price").alias("price"), n("string").alias("order_id"), n("string").alias("chain"), "pnl", "exit_reason", a["note"].alias("note"))
    return t.unionByName(c)


@query("ledger_counts", "SELECT file, count(*) AS trades, count(*) FILTER (status <> 'OPEN') AS closes FROM (SELECT *, 'ledger-' || (account % 3) AS file FROM positions) GROUP BY ROLLUP (file)", ("positions",))
def ledger_counts(spark, sf):
    return G.line_counts(ledger_lines(spark, sf))


@query("reconcile_ledger", """SELECT trade_id, CASE WHEN l IS NULL THEN 'table_only' WHEN t IS NULL THEN 'ledger_only' ELSE 'matched' END AS state FROM (SELECT trade_id, 1 AS l FROM fills WHERE confidence < .9) FULL JOIN (SELECT trade_id, 1 AS t FROM fills WHERE side = 'BUY') USING (trade_id)""", ("fills",))
def reconcile_ledger(spark, sf):
    f = D.fills(spark, sf)
    return L.reconcile_ledger(f.filter("confidence < 0.9"), f.filter("side = 'BUY'"))


APPROVED, FILLED, REJECTED, FAILED = "o_orderstatus <> 'P'", "l_returnflag = 'N'", "l_linestatus = 'O' AND l_returnflag = 'R'", "l_linenumber = 7"


@query("reconcile_approvals", f"""SELECT id, 'orphan' AS kind FROM (SELECT o_orderkey AS id FROM orders WHERE {APPROVED} EXCEPT (SELECT l_orderkey FROM lineitem WHERE {FILLED} UNION SELECT l_orderkey FROM lineitem WHERE {REJECTED} UNION SELECT l_orderkey FROM lineitem WHERE {FAILED}))
  UNION ALL SELECT id, 'unexpected_fill' FROM (SELECT l_orderkey AS id FROM lineitem WHERE {FILLED} EXCEPT SELECT o_orderkey FROM orders WHERE {APPROVED})""")
def reconcile_approvals(spark, sf):
    o, l = D.table(spark, sf, "orders"), D.table(spark, sf, "lineitem")
    line = lambda cond: l.filter(cond).select(F.col("l_orderkey").alias("id"))
    return L.reconcile_sets(o.filter(APPROVED).select(F.col("o_orderkey").alias("id")), line(FILLED), line(REJECTED), line(FAILED), "id")


@query("audit_sink", """SELECT trade_id AS request_id, model AS model_version, CAST(round(confidence / 3, 4) AS DECIMAL(5, 4)) AS confidence, CAST(floor(quantity * 700 / 3) / 100 AS DECIMAL(12, 2)) AS latency_ms, 'T' || order_id AS outcome_reference FROM fills""", ("fills",))
def audit_sink(spark, sf):
    from barflow.sources.sinks import prediction_audit
    f = D.fills(spark, sf)
    return prediction_audit(f.select(F.col("trade_id").alias("request_id"), F.col("model").alias("model_version"), (F.col("confidence") / 3).alias("confidence"),
                                     (F.floor(F.col("quantity") * 700 / 3) / 100).alias("latency_ms"), F.concat(F.lit("T"), "order_id").alias("outcome_reference")))


@query("trade_outcomes", """SELECT trade_id, symbol, side, CAST(entry_price AS DECIMAL(24, 8)) AS entry_price, CAST(exit_price AS DECIMAL(24, 8)) AS exit_price, CAST(pnl AS DECIMAL(24, 8)) AS pnl, CAST(prediction AS DECIMAL(12, 6)) AS pnl_pct,
  CASE WHEN quantity > 25 THEN 'take_profit' ELSE 'stop_loss' END AS close_reason, CAST(ts AS TIMESTAMP) - INTERVAL '1 day' AS opened_at, CAST(ts AS TIMESTAMP) AS closed_at, CAST(order_id % 3 AS BIGINT) AS epoch FROM fills""", ("fills",))
def trade_outcomes(spark, sf):
    """Closed trades in an append table, one epoch after the other; the second one is replayed."""
    from barflow.sources.commits import AppendTable
    from barflow.sources.sinks import trade_outcomes as outcomes
    at = F.col("ts").cast("timestamp_ntz")
    f = D.fills(spark, sf).withColumns({"pnl_pct": F.col("prediction"), "close_reason": F.when(F.col("quantity") > 25, "take_profit").otherwise("stop_loss"),
                                        "opened_at": at - F.expr("INTERVAL 1 DAY"), "closed_at": at})
    schema = ", ".join(f"{c} {kind}" for c, kind in outcomes(f).dtypes)
    table = AppendTable(spark, f"{shared_folder(spark)}/outcomes-{uuid.uuid4().hex}", schema, "closed_at", 1, "month")
    for epoch in (0, 1, 2, 1):
        table.append(outcomes(f.filter(F.col("order_id") % 3 == epoch)), epoch)
    return table.read().drop("month")


@query("trade_insert", """SELECT trade_id, symbol, side, quantity, entry_price AS price FROM (SELECT * REPLACE (CASE WHEN order_id % 23 = 0 THEN 'HOLD' ELSE side END AS side, CASE WHEN order_id % 29 = 0 THEN 0 ELSE quantity END AS quantity) FROM fills WHERE confidence < .8)
  WHERE side IN ('BUY', 'SELL') AND quantity > 0 AND entry_price > 0 AND trade_id NOT IN (SELECT trade_id FROM fills WHERE model LIKE '%N')""", ("fills",))
def trade_insert(spark, sf):
    from barflow.sources.sinks import new_trades
    f = D.fills(spark, sf).withColumn("price", F.col("entry_price"))
    batch = f.filter("confidence < 0.8").withColumns({"side": F.when(F.col("order_id") % 23 == 0, "HOLD").otherwise(F.col("side")), "quantity": F.when(F.col("order_id") % 29 == 0, 0.0).otherwise(F.col("quantity"))})
    return new_trades(batch, f.filter("model LIKE '%N'")).select("trade_id", "symbol", "side", "quantity", "price")


# event envelopes --------------------------------------------------------------------------------


def envelopes(spark, sf):
    """Envelopes around the given events; some malformed, empty or lacking a required field."""
    t = D.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "order_fill").when(F.col("event_type") == "click", "market_tick").otherwise("decision_ready")
    tick = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.col("k").cast("double").alias("volume")))
    body = F.to_json(F.struct(F.concat(F.lit("e"), "event_id").alias("event_id"), F.when(F.col("k") % 11 != 0, kind).alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                              F.when(F.col("k") % 17 != 0, F.concat(F.lit("svc"), F.col("user_id") % 3)).otherwise("").alias("source"), tick.alias("payload")))
    return t.select(F.concat(F.lit("m"), "event_id").alias("message_id"), F.when(F.col("k") % 13 == 0, F.substring(body, 1, 40)).when(F.col("k") % 19 == 0, "  ").otherwise(body).alias("body"))


cte("env", """SELECT 'm' || event_id AS message_id, CASE WHEN k % 13 = 0 THEN 'malformed_json' WHEN k % 19 = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'missing_event_type' WHEN k % 17 = 0 THEN 'missing_source' END AS reason,
  CASE event_type WHEN 'purchase' THEN 'order_fill' WHEN 'click' THEN 'market_tick' ELSE 'decision_ready' END AS kind, 'svc' || (user_id % 3) AS source, event_type, value, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")


@query("event_parse_dlq", "SELECT message_id, CASE WHEN reason IS NULL THEN kind END AS event_type, CASE WHEN reason IS NULL THEN source END AS source, reason FROM env", ("env",))
def event_parse_dlq(spark, sf):
    p = E.parse_events(envelopes(spark, sf), "message_id", "body")
    ok = F.col("reason").isNull()
    return p.select("message_id", F.when(ok, F.col("event_type")).alias("event_type"), F.when(ok, F.col("source")).alias("source"), "reason")


@query("event_route", "SELECT message_id, event_type AS symbol, value AS price, k::DOUBLE AS volume FROM env WHERE reason IS NULL AND kind = 'market_tick'", ("env",))
def event_route(spark, sf):
    r = E.route(E.parse_events(envelopes(spark, sf), "message_id", "body"), "market_tick")
    return r.select("message_id", "p.symbol", "p.price", "p.volume")
