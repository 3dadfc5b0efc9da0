"""Streams give the rows of their batch forms on the same events."""

import uuid

import pytest
from pyspark.sql import functions as F

from barflow.operators import ticks as T
from barflow.plans import domain as D
from barflow.plans import logs as PL
from barflow.sources import events as E
from barflow.streaming import sinks, stateful, windows


@pytest.fixture(scope="module")
def ticks(spark, sf):
    return D.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def folder(spark, ticks, tmp_path_factory):
    """The ticks as four files in time order, one per micro-batch."""
    path = str(tmp_path_factory.mktemp("ticks"))
    cuts = [ticks.approxQuantile("event_id", [q], 0.0)[0] for q in (0.25, 0.5, 0.75)]
    edges = [-1, *cuts, 1e18]
    for a, b in zip(edges, edges[1:]):
        ticks.filter((F.col("event_id") > a) & (F.col("event_id") <= b)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, ticks):
    return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, mode="append"):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def same(a, b, *cols):
    key = lambda d: sorted(tuple(r) for r in d.select(*cols).collect())
    assert key(a) == key(b)


def test_throttle(spark, folder, ticks):
    args = (600_000_000, 0.3, 3_600_000_000)
    same(drain(stateful.throttle(stream(spark, folder, ticks), *args)), T.throttle(ticks, *args), "event_id")


def test_fluctuations(spark, folder, ticks):
    same(drain(stateful.fluctuations(stream(spark, folder, ticks), 90.0)), T.fluctuations(ticks, 90.0), "event_id", "baseline")


def test_debounce_and_cap(spark, folder, ticks):
    side = F.when(F.col("volume") < 50, "BUY").otherwise("SELL")
    s = stream(spark, folder, ticks).withColumn("side", side)
    same(drain(stateful.debounce(s, 7200)), T.debounce(ticks.withColumn("side", side), 7200), "event_id")
    same(drain(stateful.hourly_cap(s, 1)), T.hourly_cap(ticks.withColumn("side", side), 1), "event_id")


def test_closed_bars_are_final(spark, folder, ticks):
    got = drain(windows.closed_bars(stream(spark, folder, ticks), 3600, "10 minutes"))
    want = windows.closed_bars(ticks, 3600)
    assert got.count() > 0.95 * want.count()
    assert got.join(want, ["symbol", "bar_ts", "open", "close", "volume", "n"], "left_anti").count() == 0


def test_duplicates_within_watermark(spark, folder, ticks):
    twice = stream(spark, folder, ticks).withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2))))
    got = drain(stateful.deduplicate(twice))
    assert got.count() == ticks.count() == got.select("event_id").distinct().count()


def test_routing_and_dead_letters(spark, sf, tmp_path):
    raw = PL.envelopes(spark, sf)
    src = str(tmp_path / "raw")
    raw.write.parquet(src)
    good, dead = str(tmp_path / "tick"), str(tmp_path / "dead")
    handler = sinks.routing_handler("message_id", "body", {"market_tick": sinks.parquet_sink(good)}, sinks.parquet_sink(dead))
    q = spark.readStream.schema(raw.schema).parquet(src).writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    parsed = E.parse_events(raw, "message_id", "body")
    same(spark.read.parquet(good), E.route(parsed, "market_tick"), "message_id")
    assert spark.read.parquet(dead).count() == parsed.filter("reason is not null").count()


def test_features_of_closed_bars(spark, sf, tmp_path):
    from barflow.operators.indicators import CANONICAL
    bars = D.bars(spark, sf).drop("n")
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    stored = bars.filter(F.col("bar_ts") < cut)
    out = {}
    handler = sinks.feature_handler(lambda: stored, lambda df, epoch: out.update({r.symbol: r for r in df.collect()}), 30)
    handler(bars.filter((F.col("bar_ts") >= cut) & (F.col("symbol") == "click")), 0)
    assert list(out) == ["click"]
    want = sinks.newest_features(bars, 30).filter("symbol = 'click'").collect()[0]
    assert all(abs(out["click"][c] - want[c]) < 1e-9 * max(1, abs(want[c])) for c in CANONICAL)


def test_cap_with_breakout_floor_and_spaced_duplicates(spark, folder, ticks):
    side = F.when(F.col("volume") < 50, "BUY").otherwise("SELL")
    s, b = stream(spark, folder, ticks).withColumn("side", side), ticks.withColumn("side", side)
    same(drain(stateful.hourly_cap(s, 2, breakout="price", floor=5.0)), T.hourly_cap(b, 2, breakout="price", floor=5.0), "event_id")
    same(drain(stateful.deduplicate_spaced(s, 21600, ("user_id",))), T.deduplicate(b, 21600, F.col("user_id")), "event_id")


def test_stale_rows_and_marks_of_positions(spark, folder, ticks):
    aged = lambda d: d.withColumn("received", F.timestamp_micros(F.unix_micros("ts") + F.col("volume").cast("bigint") * 1_000_000))
    for got, want in zip(T.split_stale(aged(stream(spark, folder, ticks)), 45, "ts", "received"), T.split_stale(aged(ticks), 45, "ts", "received")):
        same(drain(got), want, "event_id", "age_seconds")
    held = spark.createDataFrame([("a1", "click", "BUY", 10.0, 2, "OPEN"), ("a2", "view", "SELL", 20.0, 1, "OPEN"), ("a3", "view", "BUY", 20.0, 1, "CLOSED")],
                                 "account string, symbol string, side string, entry_price double, quantity int, status string")
    store, marks = {}, {}

    def handle(batch, epoch):
        # The newest tick of each symbol so far, then the open positions at these prices.
        sinks.latest_handler(lambda: store.get("d"), lambda d: store.update(d=spark.createDataFrame(d.collect(), d.schema)))(batch, epoch)
        marks["rows"] = [tuple(r) for r in T.mark_positions(store["d"], held).select("account", "unrealized").collect()]

    q = stream(spark, folder, ticks).writeStream.foreachBatch(handle).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    same(store["d"], T.latest(ticks), "symbol", "ts", "price")
    assert sorted(marks["rows"]) == sorted(tuple(r) for r in T.mark_positions(ticks, held).select("account", "unrealized").collect())


def test_rates_and_day_statistics_slide(spark, folder, ticks):
    small = windows.throughput(stream(spark, folder, ticks), "ts", 3600, "10 minutes")
    assert drain(small).join(windows.throughput(ticks, "ts", 3600), ["at", "messages", "per_second"], "left_anti").count() == 0
    got = drain(windows.error_rate(stream(spark, folder, ticks), "ts", "10 minutes"))
    assert got.count() > 0 and got.join(windows.error_rate(ticks, "ts"), ["at", "errors"], "left_anti").count() == 0
    day = drain(windows.stats_24h(stream(spark, folder, ticks), 30, "10 minutes"))
    want = windows.stats_24h(ticks, 30)
    assert day.count() > 0 and day.join(want, ["symbol", "at"], "left_semi").join(want, ["symbol", "at", "open", "high", "low", "close", "volume"], "left_anti").count() == 0


def test_late_rows_and_idle_state(spark, tmp_path):
    """A row behind its key's time is dropped; a key that was silent for long starts anew."""
    path, base = str(tmp_path / "in"), "2024-01-01 00:00:00"
    rows = [[("a", 0), ("a", 100), ("b", 0)], [("a", 50), ("a", 160)], [("b", 9000)], [("b", 9100)], [("a", 9200)]]
    for batch in rows:
        d = spark.createDataFrame(batch, "symbol string, s int").selectExpr("symbol", "'BUY' AS side", f"timestamp'{base}' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts")
        d.coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "10 seconds")
    got = drain(stateful.debounce(s, 120, ("symbol",), idle="1 hour")).selectExpr("symbol", f"unix_seconds(ts) - unix_seconds(timestamp'{base}') AS s").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("a", 160), ("a", 9200), ("b", 0), ("b", 9000)]
