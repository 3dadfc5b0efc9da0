"""The given tables seen as market data: ticks, bars, side series, trades, predictions, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.operators.series import index_series
from barflow.plans.registry import cte
from barflow.session import shared_folder, stage
from barflow.sources.tables import write_bars


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"), "event_id", "user_id")


cte("ticks", """SELECT event_type AS symbol, ts, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id, user_id FROM events""")


def bars(spark, sf, seconds: int = 1800) -> DataFrame:
    return B.bars_from_ticks(ticks(spark, sf), seconds)


def bars_sql(seconds: int, tf: str) -> str:
    return f"""SELECT symbol, '{tf}' AS timeframe, time_bucket(INTERVAL '{seconds} seconds', ts) AS bar_ts,
  arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
  sum(volume) AS volume, count(*) AS n FROM ticks GROUP BY ALL"""


cte("bars", bars_sql(1800, "30m"), ("ticks",))
cte("bars1h", bars_sql(3600, "1h"), ("ticks",))
cte("bars2h", bars_sql(7200, "2h"), ("ticks",))
cte("b", """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i FROM bars""", ("bars",))


def indexed(spark, sf, seconds: int = 1800) -> DataFrame:
    """Bars are written once (they are far smaller than ticks) and indexed from there."""
    return index_series(stage(bars(spark, sf, seconds)))


def stored_bars(spark, rows: DataFrame) -> str:
    """Write bars as a partitioned table in the shared folder and return its path."""
    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    write_bars(rows, path)
    return path


def side_series(spark, sf, event_type: str, out: str, scale: float) -> DataFrame:
    """Hourly mean of one event type as a side series shared by all symbols' bars of that hour."""
    t = ticks(spark, sf).filter(F.col("symbol") == event_type)
    hour = B.bucket_start_ntz("ts", 3600)
    return (t.groupBy(hour.alias("bar_ts")).agg(F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("_s"),
                                                F.count(F.lit(1)).alias("_n"))
            .select("bar_ts", (F.col("_s") / (F.col("_n") * scale)).alias(out)))


def side_sql(event_type: str, out: str, scale: float) -> str:
    return f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS bar_ts,
  CAST(sum(CAST(round(price*100) AS BIGINT)) AS BIGINT) / (count(*) * {scale}) AS {out}
  FROM ticks WHERE symbol = '{event_type}' GROUP BY 1"""


cte("funding_s", side_sql("signup", "funding_rate", 1.0e7), ("ticks",))
cte("mark_s", side_sql("view", "mark_price", 100.0), ("ticks",))
cte("oi_s", side_sql("error", "open_interest", 1.0), ("ticks",))


SIDES = {"mark_price": ("view", 100.0), "funding_rate": ("signup", 1.0e7), "open_interest": ("error", 1.0)}


def all_sides(spark, sf) -> DataFrame:
    """The three side series in one pass over the ticks, a row per hour that has any of them."""
    t = ticks(spark, sf).filter(F.col("symbol").isin([kind for kind, _ in SIDES.values()]))
    sums = []
    for out, (kind, scale) in SIDES.items():
        own = F.when(F.col("symbol") == kind, F.round(F.col("price") * 100).cast("bigint"))
        sums.append(F.try_divide(F.sum(own), F.count_if(F.col("symbol") == kind) * scale).alias(out))
    return t.groupBy(B.bucket_start_ntz("ts", 3600).alias("bar_ts")).agg(*sums)


OWN_SIDES = {"mark_price": (0, 100.0), "funding_rate": (1, 1.0e7), "open_interest": (2, 1.0)}


def own_sides(spark, sf) -> dict[str, DataFrame]:
    """Side series of each symbol itself: hourly means of the ticks of every third user."""
    t = stage(ticks(spark, sf).select("symbol", B.bucket_start_ntz("ts", 3600).alias("bar_ts"), (F.col("user_id") % 3).alias("kind"),
                                      F.round(F.col("price") * 100).cast("bigint").alias("cents"))
              .groupBy("symbol", "bar_ts", "kind").agg(F.sum("cents").alias("s"), F.count(F.lit(1)).alias("n")))
    return {out: t.filter(F.col("kind") == kind).select("symbol", "bar_ts", (F.col("s") / (F.col("n") * scale)).alias(out))
            for out, (kind, scale) in OWN_SIDES.items()}


cte("own_sides", "SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar_ts, " + ", ".join(
    f"CAST(sum(CAST(round(price*100) AS BIGINT)) FILTER (user_id % 3 = {kind}) AS BIGINT) / (count(*) FILTER (user_id % 3 = {kind}) * {scale}) AS {out}"
    for out, (kind, scale) in OWN_SIDES.items()) + " FROM ticks GROUP BY 1, 2", ("ticks",))


def funding(spark, sf):
    return side_series(spark, sf, "signup", "funding_rate", 1.0e7)


def mark(spark, sf):
    return side_series(spark, sf, "view", "mark_price", 100.0)


def open_interest(spark, sf):
    return side_series(spark, sf, "error", "open_interest", 1.0)


def fills(spark, sf) -> DataFrame:
    """Line items as filled trades with a model, a score and an outcome."""
    li = table(spark, sf, "lineitem")
    # Whole cents and thousandths, so that both engines hold the same numbers.
    cents = F.round(F.col("l_extendedprice") * 100)
    price_c = F.floor(cents / F.col("l_quantity"))
    long_ = F.col("l_returnflag") != "R"
    move = F.round((F.col("l_tax") - F.col("l_discount") * 0.8) * 1000)
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 10).alias("symbol"),
        F.when(long_, "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("quantity"), (price_c / 100.0).alias("entry_price"),
        (F.floor(price_c * (1000 + move) / 1000) / 100.0).alias("exit_price"),
        (F.when(long_, 1).otherwise(-1) * F.floor(cents * move / 1000) / 100.0).alias("pnl"),
        F.concat("l_linestatus", "l_returnflag").alias("model"),
        F.round((F.col("l_discount") - 0.05) * 20, 2).alias("prediction"),
        F.round(0.5 + F.col("l_quantity") / 100, 2).alias("confidence"),
        F.round((F.col("l_tax") - 0.04) * 25, 2).alias("actual"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_shipdate").alias("ts"))


cte("fills", """SELECT l_orderkey AS order_id,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id,
  'S' || (l_suppkey % 10) AS symbol, CASE WHEN l_returnflag <> 'R' THEN 'BUY' ELSE 'SELL' END AS side,
  l_quantity AS quantity, floor(round(l_extendedprice * 100) / l_quantity) / 100 AS entry_price,
  floor(floor(round(l_extendedprice * 100) / l_quantity) * (1000 + round((l_tax - l_discount * 0.8::DOUBLE) * 1000)) / 1000) / 100 AS exit_price,
  (CASE WHEN l_returnflag <> 'R' THEN 1 ELSE -1 END) * floor(round(l_extendedprice * 100) * round((l_tax - l_discount * 0.8::DOUBLE) * 1000) / 1000) / 100 AS pnl,
  l_linestatus || l_returnflag AS model, round((l_discount - 0.05::DOUBLE) * 20, 2) AS prediction,
  round(0.5::DOUBLE + l_quantity / 100, 2) AS confidence, round((l_tax - 0.04::DOUBLE) * 25, 2) AS actual,
  l_extendedprice AS notional, l_shipdate AS ts FROM lineitem""")


def positions(spark, sf) -> DataFrame:
    """Fills joined to their orders: account, status and opening time."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED")
        .otherwise("LIQUIDATED").alias("status"),
        F.col("o_orderdate").alias("opened_at"))
    return fills(spark, sf).withColumnRenamed("ts", "closed_at").join(o, "order_id")


cte("positions", """SELECT f.* EXCLUDE (ts), f.ts AS closed_at, o_custkey AS account,
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'LIQUIDATED' END AS status,
  o_orderdate AS opened_at FROM fills f JOIN orders ON order_id = o_orderkey""", ("fills",))
