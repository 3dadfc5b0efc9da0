"""Registered batch forms of the streaming rules, over the given events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barflow.functions.columns import micros, rounded
from barflow.operators import bars as B
from barflow.operators import folds
from barflow.operators import ticks as T
from barflow.plans import domain as D
from barflow.plans.registry import cte, query
from barflow.session import shared_folder
from barflow.sources.commits import KeyedTable
from barflow.streaming import windows as W

cte("tk", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i FROM ticks", ("ticks",))


@query("tick_throttle", """SELECT event_id, symbol, ts, price FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS du, abs((price - lag(price) OVER w) / nullif(lag(price) OVER w, 0)) AS dp FROM tk WINDOW w AS (PARTITION BY symbol ORDER BY i))
  WHERE du IS NULL OR (du >= 600000000 AND (coalesce(dp >= .3, false) OR du >= 3600000000))""", ("tk",))
def tick_throttle(spark, sf):
    return T.throttle(D.ticks(spark, sf), 600_000_000, 0.3, 3_600_000_000).select("event_id", "symbol", "ts", "price")


cte("fl2", """(SELECT symbol, i, event_id, price, NULL::DOUBLE AS base, price AS nxt FROM tk WHERE i = 0 UNION ALL
  SELECT t.symbol, t.i, t.event_id, t.price, f.nxt, CASE WHEN f.nxt <> 0 AND abs((t.price - f.nxt) / f.nxt) >= .9 THEN t.price ELSE f.nxt END FROM fl2 f JOIN tk t ON t.symbol = f.symbol AND t.i = f.i + 1)""", ("tk",))


@query("price_fluctuation", "SELECT event_id, symbol, price, base AS baseline, round(abs((price - base) / base) * 100, 6) AS change_pct FROM fl2 WHERE base <> 0 AND abs((price - base) / base) >= .9", ("fl2",))
def price_fluctuation(spark, sf):
    return rounded(T.fluctuations(D.ticks(spark, sf), 90.0).select("event_id", "symbol", "price", "baseline", "change_pct"))


@query("candle_closed_stream", "SELECT symbol, bar_ts, open, high, low, close, volume, n FROM bars1h WHERE bar_ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM ticks)", ("bars1h", "ticks"))
def candle_closed(spark, sf):
    """Bars whose end has passed, from the same expression the stream runs."""
    t = D.ticks(spark, sf)
    last = t.agg(F.max("ts").alias("m")).scalar()
    b = W.closed_bars(t, 3600)
    done = micros("bar_ts") + 3_600_000_000 <= micros(last)
    return b.filter(done).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")).drop("timeframe")


def spaced(name, keys, gap, src="tk"):
    cte(name, f"""(SELECT {keys}, min(ts) AS ts FROM {src} GROUP BY {keys} UNION ALL SELECT {', '.join('t.' + k for k in keys.split(', '))}, min(t.ts) FROM {name} a JOIN {src} t ON {' AND '.join(f't.{k} = a.{k}' for k in keys.split(', '))}
      AND t.ts >= a.ts + INTERVAL '{gap} seconds' GROUP BY {', '.join('t.' + k for k in keys.split(', '))})""", (src,))


cte("sg", "SELECT event_id, symbol, ts, price, volume, user_id, CASE WHEN volume < 50 THEN 'BUY' ELSE 'SELL' END AS side FROM ticks", ("ticks",))
spaced("dbn", "symbol, side", 3600, "sg")
spaced("ddp", "user_id", 21600, "sg")


def signals(spark, sf):
    return D.ticks(spark, sf).withColumn("side", F.when(F.col("volume") < 50, "BUY").otherwise("SELL"))


@query("debounce", "SELECT symbol, side, ts FROM dbn WHERE ts IS NOT NULL", ("dbn",))
def debounce(spark, sf):
    return T.debounce(signals(spark, sf), 3600).select("symbol", "side", "ts")


@query("event_dedup", "SELECT user_id, ts FROM ddp WHERE ts IS NOT NULL", ("ddp",))
def event_dedup(spark, sf):
    return T.deduplicate(signals(spark, sf), 21600, F.col("user_id")).select("user_id", "ts")


# Events of all days on one day's clock, so that keys come again within minutes; some ids are missing or empty.
cte("evk", """SELECT n, TIMESTAMP '2024-01-01' + to_microseconds(epoch_us(ts) % 86400000000) AS ts, CASE WHEN eid <> '' THEN eid WHEN cid <> '' THEN cid WHEN pid <> '' THEN pid END AS key FROM (SELECT event_id AS n, ts, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 0 THEN '' ELSE 'e' || (event_id % 90) END AS eid,
  CASE WHEN k % 4 <> 0 THEN 'c' || user_id END AS cid, CASE WHEN k % 8 = 0 THEN 'p' || (k % 5) ELSE '' END AS pid FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""")
spaced("evd", "key", 300, "evk")


@query("event_dedup_id", "SELECT key, ts FROM evd WHERE ts IS NOT NULL AND key IS NOT NULL UNION ALL SELECT key, ts FROM evk WHERE key IS NULL", ("evd", "evk"))
def event_dedup_id(spark, sf):
    return T.deduplicate_events(identified(spark, sf), IDS, order=("ts", "n")).select(T.event_key(*IDS).alias("key"), "ts")


IDS = ("event_id", "correlation_id", "payload_id")


def identified(spark, sf):
    """Events with an id of their own, of their flow or in their payload, or none."""
    k = F.get_json_object("props", "$.k").cast("int")
    clock = F.timestamp_micros(F.lit(1704067200000000) + F.pmod(micros("ts"), F.lit(86400000000))).cast("timestamp_ntz")
    return D.table(spark, sf, "events").select(
        F.col("event_id").alias("n"), clock.alias("ts"), F.when(k % 3 == 0, None).when(k % 7 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id") % 90)).alias("event_id"),
        F.when(k % 4 != 0, F.concat(F.lit("c"), "user_id")).alias("correlation_id"), F.when(k % 8 == 0, F.concat(F.lit("p"), k % 5)).otherwise("").alias("payload_id"))


cte("sgi", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i FROM sg WHERE NOT (side = 'BUY' AND price < 5)", ("sg",))
cte("cap", """(SELECT symbol, i, event_id, ts, true AS ok, [ts] AS acc FROM sgi WHERE i = 0 UNION ALL SELECT s.symbol, s.i, s.event_id, s.ts, len(list_filter(c.acc, lambda v: v > s.ts - INTERVAL '1 hour')) < 2,
  CASE WHEN len(list_filter(c.acc, lambda v: v > s.ts - INTERVAL '1 hour')) < 2 THEN list_append(list_filter(c.acc, lambda v: v > s.ts - INTERVAL '1 hour'), s.ts) ELSE list_filter(c.acc, lambda v: v > s.ts - INTERVAL '1 hour') END FROM cap c JOIN sgi s ON s.symbol = c.symbol AND s.i = c.i + 1)""", ("sgi",))


@query("hourly_cap", "SELECT event_id, symbol, ts FROM cap WHERE ok", ("cap",))
def hourly_cap(spark, sf):
    return T.hourly_cap(signals(spark, sf), 2, breakout="price", floor=5.0).select("event_id", "symbol", "ts")


cte("gd", "SELECT *, close > open AS cand, CAST(bar_ts AS DATE) AS day FROM b", ("b",))
cte("gdf", """(SELECT symbol, i, bar_ts, day, cand AS ok, CASE WHEN cand THEN i ELSE -1000 END AS last, CASE WHEN cand THEN 1 ELSE 0 END AS used FROM gd WHERE i = 0 UNION ALL
  SELECT symbol, i, bar_ts, day, ok, CASE WHEN ok THEN i ELSE last END, used + ok::INT FROM (SELECT g.symbol, g.i, g.bar_ts, g.day, f.last, CASE WHEN g.day = f.day THEN f.used ELSE 0 END AS used, g.cand AND g.i - f.last >= 3 AND (CASE WHEN g.day = f.day THEN f.used ELSE 0 END) < 4 AS ok
   FROM gdf f JOIN gd g ON g.symbol = f.symbol AND g.i = f.i + 1))""", ("gd",))


@query("gap_daily_cap", "SELECT symbol, bar_ts FROM gdf WHERE ok", ("gdf",))
def gap_daily_cap(spark, sf):
    d = D.indexed(spark, sf).withColumns({"cand": F.col("close") > F.col("open"), "day": F.unix_date(F.to_date("bar_ts"))})
    return folds.gap_and_daily_cap(d, ["symbol", "timeframe"], "cand", "day", 3, 4).filter("accepted").select("symbol", "bar_ts")


@query("stats_24h", """SELECT symbol, m + INTERVAL '1 minute' AS "at", first_value(o) OVER w AS open, max(h) OVER w AS high, min(l) OVER w AS low, c AS close, sum(v) OVER w AS volume,
  round((c - first_value(o) OVER w) / nullif(first_value(o) OVER w, 0) * 100, 6) AS change_pct FROM
  (SELECT symbol, time_bucket(INTERVAL '1 minute', ts) AS m, arg_min(price, (ts, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, event_id)) AS c, sum(volume) AS v FROM ticks GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY symbol ORDER BY m RANGE BETWEEN INTERVAL '1439 minutes' PRECEDING AND CURRENT ROW)""", ("ticks",))
def stats_24h(spark, sf):
    d = W.stats_24h(D.ticks(spark, sf))
    return rounded(d.withColumn("at", F.col("at").cast("timestamp_ntz")))


@query("throughput", """SELECT "at", messages, round(coalesce(messages / nullif(span, 0), 0), 6) AS per_second FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS "at", count(*) AS messages, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM ticks GROUP BY 1)""", ("ticks",))
def throughput(spark, sf):
    d = W.throughput(D.ticks(spark, sf), "ts", 3600)
    return rounded(d.withColumn("at", F.col("at").cast("timestamp_ntz")))


@query("stale_reject", "SELECT event_id, age <= 45 AS accepted, age AS age_seconds FROM (SELECT event_id, volume::BIGINT::DOUBLE AS age FROM ticks)", ("ticks",))
def stale_reject(spark, sf):
    t = D.ticks(spark, sf).withColumn("received", F.timestamp_micros(micros("ts") + F.col("volume").cast("bigint") * 1_000_000))
    ok, old = T.split_stale(t, 45, "ts", "received")
    return ok.withColumn("accepted", F.lit(True)).unionByName(old.withColumn("accepted", F.lit(False))).select("event_id", "accepted", "age_seconds")


@query("latest_tick", "SELECT symbol, max(ts) AS ts, arg_max(price, (ts, event_id)) AS price, arg_max(volume, (ts, event_id)) AS volume FROM ticks GROUP BY 1", ("ticks",))
def latest_tick(spark, sf):
    return T.latest(D.ticks(spark, sf)).select("symbol", "ts", "price", "volume")


@query("latest_tick_table", "SELECT symbol, max(ts) AS ts, arg_max(price, (ts, event_id)) AS price, arg_max(volume, (ts, event_id)) AS volume FROM ticks GROUP BY 1", ("ticks",))
def latest_tick_table(spark, sf):
    """The newest tick of each symbol in a keyed table, batch by batch; the last one comes twice."""
    t = D.ticks(spark, sf).select("symbol", "ts", "event_id", "price", "volume")
    schema = ", ".join(f"{c} {kind}" for c, kind in t.dtypes)
    kept = KeyedTable(spark, f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}", schema, ["symbol"], T.latest, 16)
    for epoch in (0, 1, 2, 2):
        kept.upsert(t.filter(F.pmod(F.col("event_id"), F.lit(3)) == epoch), epoch)
    return kept.read().select("symbol", "ts", "price", "volume")


@query("mark_positions", """SELECT account, marked_at, round((CASE WHEN s = 'BUY' THEN 1 ELSE -1 END) * (price - e) * q * .001::DOUBLE, 8) AS unrealized FROM (SELECT symbol, max(ts) AS marked_at, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1) JOIN
  (SELECT c_custkey AS account, CASE c_nationkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END AS symbol, CASE WHEN c_acctbal > 0 THEN 'BUY' ELSE 'SELL' END AS s, abs(c_acctbal) / 100 AS e, c_nationkey + 1 AS q FROM customer) USING (symbol)""", ("ticks",))
def mark_positions(spark, sf):
    k = F.col("c_nationkey") % 5
    symbol = F.when(k == 0, "view").when(k == 1, "click").when(k == 2, "error").when(k == 3, "signup").otherwise("purchase")
    p = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), symbol.alias("symbol"), F.when(F.col("c_acctbal") > 0, "BUY").otherwise("SELL").alias("side"),
                                              (F.abs("c_acctbal") / 100).alias("entry_price"), (F.col("c_nationkey") + 1).alias("quantity"), F.lit("OPEN").alias("status"))
    return rounded(T.mark_positions(D.ticks(spark, sf), p).select("account", "marked_at", "unrealized"), 8)


def _streaming_features():
    from barflow.plans.indicators import LATEST

    @query("streaming_features", f"SELECT * EXCLUDE (i) FROM (SELECT symbol, bar_ts, i, {LATEST} FROM xall) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1 AND i >= 29", ("xall",),
           own={"bars": (("ticks",), f"SELECT * FROM ({D.bars_sql(1800, '30m')}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 500")})
    def streaming_features(spark, sf):
        from barflow.operators.indicators import CANONICAL
        from barflow.plans.indicators import LOOSE
        from barflow.streaming.sinks import newest_features
        out = newest_features(D.bars(spark, sf), 30)
        return rounded(out.select("symbol", "bar_ts", *CANONICAL), 9, LOOSE)


_streaming_features()
