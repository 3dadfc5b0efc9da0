"""Sources, data quality, resampling and as-of joins over bars of the given events."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.columns import micros, rounded
from barflow.operators import bars as B
from barflow.operators import perpetual as PB
from barflow.operators import quality as Q
from barflow.operators import series as S
from barflow.plans import domain as D
from barflow.sources import tables as TB
from barflow.session import shared_folder, stage
from barflow.plans.registry import cte, query

OHLC = "symbol, bar_ts, open, high, low, close, volume"


@query("bars_from_events", f"SELECT symbol, timeframe, bar_ts, open, high, low, close, volume, n FROM bars", ("bars",))
def bars_from_events(spark, sf):
    return D.bars(spark, sf)


@query("candle_scan", f"""SELECT {OHLC} FROM bars WHERE symbol = 'click'
  AND bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts <= TIMESTAMP '2024-01-20'""", ("bars",))
def candle_scan(spark, sf):
    stored = TB.read_bars(spark, D.stored_bars(spark, D.bars(spark, sf)), "2024-01-05", "2024-01-20")
    return B.scan_range(stored, "click", "30m", "2024-01-05", "2024-01-20").drop("timeframe", "n")


@query("candle_upsert", f"""SELECT symbol, bar_ts,
  CASE WHEN new THEN open + 1 ELSE open END AS open, CASE WHEN new THEN high + 1 ELSE high END AS high,
  CASE WHEN new THEN low + 1 ELSE low END AS low, CASE WHEN new THEN close + 1 ELSE close END AS close,
  volume FROM (SELECT *, bar_ts >= TIMESTAMP '2024-01-15' AS new FROM bars)""", ("bars",))
def candle_upsert(spark, sf):
    b = D.bars(spark, sf)
    stored = b.filter(F.col("bar_ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    late = b.filter(F.col("bar_ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    batch = late.withColumn("seq", F.lit(1)).unionByName(
        late.withColumns({c: F.col(c) + 1 for c in B.OHLCV[:4]}).withColumn("seq", F.lit(2)))
    path = D.stored_bars(spark, stored.drop("n"))
    TB.upsert_bars(spark, path, batch)
    return TB.read_bars(spark, path).drop("timeframe")


@query("candle_normalize", """SELECT symbol, time_bucket(INTERVAL '60 seconds', ts) AS bar_ts,
  arg_min(price, event_id) AS open, arg_min(price, event_id) AS high, arg_min(price, event_id) AS low,
  arg_min(price, event_id) AS close, arg_min(volume, event_id) AS volume FROM ticks GROUP BY ALL""", ("ticks",))
def candle_normalize(spark, sf):
    t = D.ticks(spark, sf)
    rows = t.select("symbol", F.lit("1m").alias("timeframe"), F.col("event_id").alias("seq"),
                    F.floor(micros("ts") / 60_000_000).cast("bigint").alias("_m"), "price", "volume")
    rows = rows.select("symbol", "timeframe", "seq", (F.col("_m") * 60).alias("time"),
                       *[F.col("price").alias(c) for c in "ohlc"], F.col("volume").alias("v"))
    return B.from_exchange_rows(rows).drop("timeframe")


@query("epoch_normalize", """SELECT event_id, ts AS from_micros, make_timestamp(epoch_us(ts) // 1000) AS from_millis,
  make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS from_seconds,
  make_timestamp(epoch_us(ts) // 1000 * 1000) AS second_variant,
  date_trunc('second', ts) AS from_text FROM ticks""", ("ticks",))
def epoch_normalize(spark, sf):
    us = micros("ts")
    t = D.ticks(spark, sf)
    ntz = "timestamp_ntz"
    return t.select(
        "event_id", B.epoch_to_timestamp(us).cast(ntz).alias("from_micros"),
        B.epoch_to_timestamp(F.floor(us / 1000), ).cast(ntz).alias("from_millis"),
        B.epoch_to_timestamp(F.floor(us / 1_000_000)).cast(ntz).alias("from_seconds"),
        B.epoch_millis_to_timestamp(F.floor(us / 1000)).cast(ntz).alias("second_variant"),
        B.text_to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).cast(ntz).alias("from_text"))


@query("page_union", f"""SELECT {OHLC} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS rn
  FROM bars) WHERE rn <= 500""", ("bars",))
def page_union(spark, sf):
    b = D.bars(spark, sf).drop("n")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    pages = [b.filter(F.col("bar_ts") >= cut), b.filter(F.col("bar_ts") <= cut)]
    return B.tail(B.union_pages(pages), 500).drop("timeframe", "bar_idx")


@query("tail_n", f"""SELECT {OHLC} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS rn
  FROM bars) WHERE rn <= 100""", ("bars",))
def tail_n(spark, sf):
    return B.tail(D.bars(spark, sf), 100).drop("timeframe", "bar_idx", "n")


cte("perp", """SELECT symbol, b.bar_ts, open, high, low, close, volume, mark_price, funding_rate, open_interest
  FROM bars1h b LEFT JOIN mark_s USING (bar_ts) LEFT JOIN funding_s USING (bar_ts) LEFT JOIN oi_s USING (bar_ts)""",
    ("bars1h", "mark_s", "funding_s", "oi_s"))


def perp_matrix(spark, sf):
    """OHLCV with mark, funding and open interest, the three filled forward."""
    m = D.bars(spark, sf, 3600).drop("n").join(D.all_sides(spark, sf), "bar_ts", "left")
    return Q.fill_forward(S.index_series(stage(m)), ["mark_price", "funding_rate", "open_interest"], None)


cte("perp_filled", """SELECT * REPLACE (last_value(mark_price IGNORE NULLS) OVER w AS mark_price,
  last_value(funding_rate IGNORE NULLS) OVER w AS funding_rate,
  last_value(open_interest IGNORE NULLS) OVER w AS open_interest),
  row_number() OVER w - 1 AS i FROM perp WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""", ("perp",))


@query("perp_matrix", "SELECT * EXCLUDE (i) FROM perp_filled", ("perp_filled",))
def perp_matrix_q(spark, sf):
    return perp_matrix(spark, sf).drop("bar_idx", "timeframe")


@query("perp_matrix_own", """SELECT symbol, bar_ts, open, high, low, close, volume, last_value(mark_price IGNORE NULLS) OVER w AS mark_price,
  last_value(funding_rate IGNORE NULLS) OVER w AS funding_rate, last_value(open_interest IGNORE NULLS) OVER w AS open_interest
  FROM bars1h LEFT JOIN own_sides USING (symbol, bar_ts) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""", ("bars1h", "own_sides"))
def perp_matrix_own(spark, sf):
    """OHLCV beside the symbol's own mark, funding and open interest, stored as a partitioned table and read from there."""
    m = PB.side_matrix(stage(D.bars(spark, sf, 3600).drop("n")), D.own_sides(spark, sf)).drop("bar_idx")
    return TB.read_bars(spark, D.stored_bars(spark, m)).drop("timeframe")


# data quality ---------------------------------------------------------------------------------


@query("resolution_seconds", """SELECT timeframe, CASE timeframe WHEN '30m' THEN 1800 WHEN '2h' THEN 7200 END AS seconds,
  count(*) AS n FROM (SELECT timeframe FROM bars UNION ALL SELECT timeframe FROM bars2h) GROUP BY 1""",
       ("bars", "bars2h"))
def resolution_seconds(spark, sf):
    both = D.bars(spark, sf).unionByName(D.bars(spark, sf, 7200))
    return (both.groupBy("timeframe").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("seconds", B.bar_seconds_column(F.col("timeframe"))))


cte("steps", """SELECT *, epoch(bar_ts - lag(bar_ts) OVER w) AS step, lead(bar_ts) OVER w IS NULL AS final
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""", ("b",))


@query("candle_validate", """SELECT * FROM (
  SELECT symbol, 'duplicate_ts' AS rule, count(*) FILTER (step = 0) AS violations FROM steps GROUP BY 1
  UNION ALL SELECT symbol, 'irregular_step', count(*) FILTER (step <> 1800 AND NOT (final AND i >= 2)) FROM steps GROUP BY 1
  UNION ALL SELECT symbol, 'high_below_low', count(*) FILTER (high < low) FROM steps GROUP BY 1
  UNION ALL SELECT symbol, 'outside_range', count(*) FILTER (close > high OR close < low OR open > high OR open < low)
    FROM steps GROUP BY 1
  UNION ALL SELECT symbol, 'too_few_rows', CASE WHEN count(*) < 5000 THEN 1 ELSE 0 END FROM steps GROUP BY 1)
  WHERE violations > 0""", ("steps",))
def candle_validate(spark, sf):
    return Q.validate(D.bars(spark, sf), 1800, 5000, True).drop("timeframe")


@query("candle_gaps", """SELECT symbol, count(*) FILTER (step > 3600) AS gaps, max(step) FILTER (step > 3600)
  AS largest_seconds FROM steps GROUP BY 1""", ("steps",))
def candle_gaps(spark, sf):
    return Q.gaps(D.bars(spark, sf), 1800).drop("timeframe")


@query("price_spikes", """SELECT symbol, count(*) AS spikes, round(max(s), 6) AS worst, arg_max(bar_ts, (s, -epoch_us(bar_ts)))
  AS worst_ts FROM (SELECT *, (high - low) / (close + 1e-9) AS s FROM bars) WHERE s > 0.10 GROUP BY 1""", ("bars",))
def price_spikes(spark, sf):
    return rounded(Q.spikes(D.bars(spark, sf)).drop("timeframe"))


@query("load_sanity", """SELECT symbol, count(*) AS rows, count(*) FILTER (close <= 0) AS bad_close,
  count(*) FILTER (high < low) AS bad_range, count(*) FILTER (volume < 0) AS bad_volume, 0 AS duplicates,
  count(*) FILTER (close <= 0 OR high < low OR volume < 0) = 0 AND count(*) >= 1000 AS passed FROM bars GROUP BY 1""",
       ("bars",))
def load_sanity(spark, sf):
    return Q.sanity(D.bars(spark, sf), 1000).drop("timeframe")


cte("grid", """SELECT symbol, g.bar_ts, open, high, low, close, volume, open IS NULL AS filled FROM
  (SELECT symbol, unnest(generate_series(min(bar_ts), max(bar_ts), INTERVAL '30 minutes')) AS bar_ts FROM bars
   GROUP BY symbol) g LEFT JOIN bars USING (symbol, bar_ts)""", ("bars",))
cte("gridf", """SELECT symbol, bar_ts, filled, CASE WHEN filled AND run > 3 THEN NULL ELSE o END AS open,
  CASE WHEN filled AND run > 3 THEN NULL ELSE h END AS high, CASE WHEN filled AND run > 3 THEN NULL ELSE l END AS low,
  CASE WHEN filled AND run > 3 THEN NULL ELSE c END AS close, CASE WHEN filled AND run > 3 THEN NULL ELSE v END AS volume
  FROM (SELECT *, count(*) FILTER (filled) OVER (PARTITION BY symbol, isl) AS run FROM
   (SELECT symbol, bar_ts, filled, count(*) FILTER (NOT filled) OVER w AS isl,
    last_value(open IGNORE NULLS) OVER w AS o, last_value(high IGNORE NULLS) OVER w AS h,
    last_value(low IGNORE NULLS) OVER w AS l, last_value(close IGNORE NULLS) OVER w AS c,
    last_value(volume IGNORE NULLS) OVER w AS v FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)))""",
    ("grid",))


@query("grid_fill", "SELECT * FROM gridf WHERE bar_ts <= TIMESTAMP '2024-01-30 12:10:00' - INTERVAL '30 minutes'", ("gridf",))
def grid_fill(spark, sf):
    now = F.lit("2024-01-30 12:10:00").cast("timestamp_ntz")
    return B.grid_fill(D.bars(spark, sf), 1800, now=now).drop("timeframe")


@query("grid_report", """SELECT * FROM (SELECT symbol, 0 AS duplicates, count(*) FILTER (step > 1800) AS raw_gaps
  FROM steps GROUP BY 1) JOIN (SELECT symbol, count(*) FILTER (filled) AS missing, count(*) AS final_rows,
  count(*) FILTER (close IS NULL) AS null_rows, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts FROM gridf GROUP BY 1)
  USING (symbol)""", ("steps", "gridf"))
def grid_report(spark, sf):
    b = D.bars(spark, sf)
    return Q.grid_report(b, B.grid_fill(b, 1800), 1800).drop("timeframe")


@query("coverage_gate", """SELECT symbol, count(*) // 3 AS rows, round(count(*) // 3 / 480.0::DOUBLE, 6) AS share,
  count(*) // 3 / 480.0::DOUBLE >= 0.75 AS passed FROM bars GROUP BY 1""", ("bars",))
def coverage_gate(spark, sf):
    return rounded(Q.coverage(D.bars(spark, sf), 480, 0.75, 3).drop("timeframe"))


@query("dataset_gate", """SELECT symbol, count(*) AS rows, CAST(count(*) FILTER (close IS NULL) * 5 AS BIGINT) AS nulls,
  count(*) >= 1000 AND count(*) FILTER (close IS NULL) = 0 AS passed FROM gridf GROUP BY 1""", ("gridf",))
def dataset_gate(spark, sf):
    return Q.dataset_gate(B.grid_fill(D.bars(spark, sf), 1800), B.OHLCV, 1000).drop("timeframe")


@query("series_coverage", """SELECT symbol, min(bar_ts) AS bars_from, (SELECT min(bar_ts) FROM funding_s) AS side_from,
  (SELECT min(bar_ts) FROM funding_s) <= min(bar_ts) + INTERVAL '2 days' AS aligned,
  CAST(floor(greatest(epoch((SELECT min(bar_ts) FROM funding_s) - min(bar_ts)), 0) / 1800) AS BIGINT) AS rows_at_risk
  FROM bars GROUP BY 1""", ("bars", "funding_s"))
def series_coverage(spark, sf):
    return Q.side_coverage(D.bars(spark, sf), D.funding(spark, sf), 1800, 172_800).drop("timeframe")


cte("feature_q", """SELECT symbol, event_id, CASE WHEN price IS NULL THEN 'DEGRADED' WHEN age > 3600 THEN 'LOW'
  WHEN age > 600 THEN 'MEDIUM' WHEN abs(price * volume * 200) > 1e6 THEN 'DEGRADED' ELSE 'HIGH' END AS quality FROM
  (SELECT *, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(ts) / 1e6 - 2500000 AS age FROM ticks)""", ("ticks",))


def _quality(spark, sf):
    age = micros(F.lit("2024-01-31").cast("timestamp_ntz")) / 1e6 - micros("ts") / 1e6 - 2_500_000
    value = F.when(F.col("price").isNotNull(), F.col("price") * F.col("volume") * 200)
    return D.ticks(spark, sf).select("symbol", "event_id", Q.quality_class(value, age).alias("quality"))


@query("feature_quality", "SELECT * FROM feature_q", ("feature_q",))
def feature_quality(spark, sf):
    return _quality(spark, sf)


@query("quality_score", """SELECT symbol, round(s, 6) AS score, CASE WHEN s >= .9 THEN 'HIGH' WHEN s >= .7 THEN 'MEDIUM'
  WHEN s >= .4 THEN 'LOW' WHEN s > 0 THEN 'DEGRADED' ELSE 'UNAVAILABLE' END AS overall FROM
  (SELECT symbol, avg(CASE quality WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN .7 WHEN 'LOW' THEN .4 WHEN 'DEGRADED' THEN .1
   ELSE 0 END::DOUBLE) AS s FROM feature_q GROUP BY 1)""", ("feature_q",))
def quality_score(spark, sf):
    return rounded(Q.quality_score(_quality(spark, sf), ["symbol"]))


@query("freshness_buckets", """SELECT symbol, CASE WHEN a < 30 THEN 'live' WHEN a < 60 THEN 'fresh' WHEN a < 120 THEN 'recent'
  WHEN a < 300 THEN 'aging' WHEN a < 900 THEN 'stale' ELSE 'very_stale' END AS bucket, count(*) AS n FROM
  (SELECT symbol, epoch_us(bar_ts) / 1e6 + 1800 - epoch_us(last_ts) / 1e6 AS a FROM (SELECT symbol,
   time_bucket(INTERVAL '30 minutes', ts) AS bar_ts, max(ts) AS last_ts FROM ticks GROUP BY ALL)) GROUP BY ALL""", ("ticks",))
def freshness_buckets(spark, sf):
    last = D.ticks(spark, sf).groupBy("symbol", B.bucket_start_ntz("ts", 1800).alias("bar_ts")).agg(F.max("ts").alias("l"))
    age = micros("bar_ts") / 1e6 + 1800 - micros("l") / 1e6
    return last.groupBy("symbol", Q.freshness(age).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("table_diff", """SELECT symbol, bar_ts, d.col AS "column", d.kind AS kind, d.e AS expected, d.a AS actual FROM
  (SELECT symbol, bar_ts, unnest([CASE WHEN NOT in_a THEN {'col': NULL, 'kind': 'missing', 'e': NULL::VARCHAR, 'a': NULL::VARCHAR} END,
    CASE WHEN NOT in_e THEN {'col': NULL, 'kind': 'extra', 'e': NULL::VARCHAR, 'a': NULL::VARCHAR} END,
    CASE WHEN in_a AND in_e AND n % 7 = 0 THEN {'col': 'n', 'kind': 'value', 'e': n::VARCHAR, 'a': (n + 2)::VARCHAR} END]) AS d
   FROM (SELECT symbol, bar_ts, n, bar_ts < TIMESTAMP '2024-01-29' AS in_e, bar_ts >= TIMESTAMP '2024-01-02' AS in_a FROM bars))
  WHERE d IS NOT NULL""", ("bars",))
def table_diff(spark, sf):
    b = D.bars(spark, sf).select("symbol", "bar_ts", "n")
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    expected = b.filter(F.col("bar_ts") < ntz("2024-01-29"))
    actual = (b.filter(F.col("bar_ts") >= ntz("2024-01-02"))
              .withColumn("n", F.when(F.col("n") % 7 == 0, F.col("n") + 2).otherwise(F.col("n") + 1)))
    return Q.table_diff(expected, actual, ["symbol", "bar_ts"], 1.0)


@query("schema_check", """SELECT count(*) AS rows, count(*) FILTER (NOT json_valid(props)) AS malformed,
  count(*) FILTER (json_extract(props, '$.k') IS NULL) AS missing_k,
  count(*) FILTER (json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT')) AS type_k,
  count(*) FILTER (json_extract(props, '$.z') IS NULL) AS missing_z, 0 AS type_z FROM events""")
def schema_check(spark, sf):
    return Q.payload_check(D.table(spark, sf, "events"), "props", {"k": "BIGINT", "z": "DOUBLE"})


@query("clean_dataset", """SELECT symbol, bar_ts, open, high, low, close, volume FROM
  (SELECT symbol, bar_ts, i, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
   last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close,
   last_value(volume IGNORE NULLS) OVER w AS volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1
   AS i FROM gridf QUALIFY i >= 250)
   WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE open IS NOT NULL""", ("gridf",))
def clean_dataset(spark, sf):
    return Q.clean_dataset(B.grid_fill(D.bars(spark, sf), 1800).drop("filled")).drop("timeframe")


# resampling and as-of joins -------------------------------------------------------------------


cte("r4", """SELECT symbol, time_bucket(INTERVAL '4 hours', bar_ts - INTERVAL '1 microsecond') + INTERVAL '4 hours' AS bar_ts,
  arg_min(open, bar_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY ALL""", ("bars",))


@query("resample_ohlcv", f"SELECT {OHLC} FROM r4", ("r4",))
def resample_ohlcv(spark, sf):
    return B.resample(D.bars(spark, sf), 14400)


@query("asof_join", """SELECT b.symbol, b.bar_ts, b.close, r4.close AS close_4h, r4.bar_ts AS ts_4h FROM bars b
  ASOF LEFT JOIN r4 ON b.symbol = r4.symbol AND b.bar_ts >= r4.bar_ts""", ("bars", "r4"))
def asof_join(spark, sf):
    b = D.bars(spark, sf)
    return S.asof_join(b.select("symbol", "bar_ts", "close"),
                       [(B.resample(b, 14400), "bar_ts", {"close": "close_4h", "bar_ts": "ts_4h"})])


@query("asof_ticks", """SELECT t.event_id, t.symbol, t.price, c.closed_at, c.close AS last_close, f.funding_rate FROM ticks t
  ASOF LEFT JOIN (SELECT symbol, bar_ts + INTERVAL '30 minutes' AS closed_at, close FROM bars) c ON t.symbol = c.symbol AND t.ts >= c.closed_at
  ASOF LEFT JOIN (SELECT symbol, bar_ts + INTERVAL '1 hour' AS known_at, funding_rate FROM own_sides WHERE funding_rate IS NOT NULL) f
    ON t.symbol = f.symbol AND t.ts >= f.known_at""", ("ticks", "bars", "own_sides"))
def asof_ticks(spark, sf):
    """Every tick with the last bar closed before it and the last funding known then; bins of even size over all sides."""
    t = D.ticks(spark, sf).select("event_id", "symbol", "ts", "price")
    closed = D.bars(spark, sf).withColumn("closed_at", F.expr("bar_ts + INTERVAL 30 MINUTES"))
    fund = D.own_sides(spark, sf)["funding_rate"].withColumn("known_at", F.expr("bar_ts + INTERVAL 1 HOUR"))
    return S.asof_join(t, [(closed, "closed_at", {"closed_at": "closed_at", "close": "last_close"}), (fund, "known_at", {"funding_rate": "funding_rate"})],
                       ts="ts", balanced=True).drop("ts")


@query("asof_chain", """SELECT b.symbol, b.bar_ts, b.close, r2.close AS h_close, r4.close AS h1_close, f.funding_rate FROM bars b
  ASOF LEFT JOIN (SELECT symbol, bar_ts + INTERVAL '2 hours' AS bar_ts, close FROM bars2h) r2
    ON b.symbol = r2.symbol AND b.bar_ts >= r2.bar_ts
  ASOF LEFT JOIN r4 ON b.symbol = r4.symbol AND b.bar_ts >= r4.bar_ts
  ASOF LEFT JOIN funding_s f ON b.bar_ts >= f.bar_ts""", ("bars", "r4", "bars2h", "funding_s"))
def asof_chain(spark, sf):
    b = stage(D.bars(spark, sf))
    two = D.bars(spark, sf, 7200).withColumn("bar_ts", F.expr("bar_ts + INTERVAL 2 HOURS"))
    fund = _per_symbol(b, stage(D.funding(spark, sf)))
    return S.asof_join(b.select("symbol", "bar_ts", "close"), [
        (two, "bar_ts", {"close": "h_close"}), (B.resample(b, 14400), "bar_ts", {"close": "h1_close"}),
        (fund, "bar_ts", {"funding_rate": "funding_rate"})])


def _per_symbol(bars, side):
    """Copy a market-wide side series to every symbol it serves."""
    symbols = bars.agg(F.collect_set("symbol")).scalar()
    return side.withColumn("symbol", F.explode(symbols))


@query("htf_align", """SELECT symbol, bar_ts, close, last_value(c4 IGNORE NULLS) OVER
  (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close_15m FROM
  (SELECT b.symbol, b.bar_ts, b.close, CASE WHEN r4.volume > 100 THEN r4.close END AS c4 FROM bars b ASOF LEFT JOIN r4
   ON b.symbol = r4.symbol AND b.bar_ts >= r4.bar_ts)""", ("bars", "r4"))
def htf_align(spark, sf):
    b = D.bars(spark, sf)
    high = B.resample(b, 14400).withColumn("close", F.when(F.col("volume") > 100, F.col("close")))
    joined = S.asof_join(b.select("symbol", "timeframe", "bar_ts", "close"),
                         [(high, "bar_ts", {"close": "close_15m"})])
    return Q.fill_forward(S.index_series(joined), ["close_15m"], 5).drop("bar_idx", "timeframe")


@query("labeled_scan", """SELECT timeframe, symbol, count(*) AS rows, round(avg(close), 6) AS mean_close FROM bars2h GROUP BY ALL""",
       ("bars2h",))
def labeled_scan(spark, sf):
    from barflow.sources.tables import load_partition
    path = D.stored_bars(spark, D.bars(spark, sf).unionByName(D.bars(spark, sf, 7200)))
    return rounded(load_partition(TB.read_bars(spark, path), "2h").groupBy("timeframe", "symbol")
                   .agg(F.count(F.lit(1)).alias("rows"), F.avg("close").alias("mean_close")))


@query("labeled_files", """SELECT timeframe, symbol, count(*) AS rows, sum(label)::BIGINT AS ups, round(avg(close), 6) AS mean_close FROM (
  SELECT *, CASE WHEN lead(close) OVER (PARTITION BY symbol, timeframe ORDER BY bar_ts) > close THEN 1 ELSE 0 END AS label,
    lead(close) OVER (PARTITION BY symbol, timeframe ORDER BY bar_ts) IS NULL AS final FROM (SELECT * FROM bars UNION ALL SELECT * FROM bars2h))
  WHERE NOT final GROUP BY ALL""", ("bars", "bars2h"))
def labeled_files(spark, sf):
    """Bars labelled by whether the next one closes higher, written as a file per timeframe; those that exist are read back."""
    both = S.index_series(stage(D.bars(spark, sf).unionByName(D.bars(spark, sf, 7200))))
    ahead = S.framed(both, lambda d, r: d.withColumn("_next", r.lead("close")), after=1)
    labeled = ahead.filter(F.col("_next").isNotNull()).withColumn("label", (F.col("_next") > F.col("close")).cast("int")).drop("_next", "bar_idx")
    folder = f"{shared_folder(spark)}/labeled-{uuid.uuid4().hex}"
    TB.write_labeled(stage(labeled), folder, ["30m", "2h"])
    # Nothing was written for 1d.
    found = [d for d in (TB.read_labeled(spark, folder, name) for name in ("30m", "2h", "1d")) if d is not None]
    rows = functools.reduce(DataFrame.unionByName, found)
    return rounded(rows.groupBy("timeframe", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("ups"), F.avg("close").alias("mean_close")))


BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType()),
                           T.StructField("bar_ts", T.TimestampNTZType()),
                           *[T.StructField(c, T.DoubleType()) for c in B.OHLCV]])
