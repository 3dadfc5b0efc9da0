"""Boundary cases: ties, empty ranges, gaps, malformed input, decision tables."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from barflow.functions import futures as X
from barflow.functions.registry import resolve
from barflow.operators import bars as B
from barflow.operators import charts as H
from barflow.operators import decisions as A
from barflow.operators import evaluation as E
from barflow.operators import indicators as I
from barflow.operators import labels as L
from barflow.operators import models as M
from barflow.operators import quality as Q
from barflow.operators import series as S
from barflow.sources import ledger, logs, tables
from tests.fixtures import START, frame, series, walk


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_canonical_is_finite_everywhere(spark):
    d = I.canonical(frame(spark, series(260)), 5)
    bad = d.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in I.CANONICAL]).collect()[0].asDict()
    assert not any(bad.values())
    assert Q.check_contract(d.select(*I.CANONICAL), I.CANONICAL) == []
    flat = d.filter("symbol = 'FLAT'").select("rsi_14", "stochastic_k_14", "volume_ratio", "bb_position").distinct().collect()
    assert [tuple(r) for r in flat] == [(0.0, 0.0, 0.0, 0.0)]


def test_later_bars_do_not_change_earlier_features(spark):
    pdf = walk(200, "A")
    names = ["ema_26", "macd_signal", "obv", "chaikin_oscillator", "adx_14"]
    whole = I.canonical(frame(spark, pdf), 5).filter("bar_idx = 150").select(names).collect()[0]
    part = I.canonical(frame(spark, pdf.iloc[:151]), 5).filter("bar_idx = 150").select(names).collect()[0]
    assert all(abs(a - b) <= 1e-9 * max(1, abs(a)) for a, b in zip(whole, part))


def test_unknown_feature():
    assert resolve("macd_hist_15m") == "macd_histogram"
    try:
        resolve("nope")
    except ValueError:
        return
    raise AssertionError


def test_upsert_keeps_the_newest_and_skips_bad_batches(spark):
    a = frame(spark, walk(3, "A"))
    late = a.withColumn("close", F.lit(1.0)).withColumn("seq", F.lit(1)).unionByName(a.withColumn("close", F.lit(2.0)).withColumn("seq", F.lit(2)))
    assert [r["close"] for r in rows(B.upsert(a, late), "bar_ts")] == [2.0] * 3
    assert B.upsert(a, a.drop("volume")) is a


def test_grid_fill_runs(spark):
    pdf = walk(30, "A")
    keep = [i for i in range(30) if i not in (3, 8, 9, 10, 15, 16, 17, 18)]
    out = rows(B.grid_fill(frame(spark, pdf.iloc[keep]), 300, piece=2), "bar_ts")
    state = ["real" if not r["filled"] else "null" if r["close"] is None else "fill" for r in out]
    assert len(out) == 30
    assert state[3] == "fill" and state[8:11] == ["fill"] * 3 and state[15:19] == ["null"] * 4
    now = B.grid_fill(frame(spark, pdf), 300, now=F.lit(START + dt.timedelta(minutes=147)).cast("timestamp_ntz"))
    assert now.count() == 29


def test_validate_reports(spark):
    pdf = walk(20, "A")
    gap = pdf.drop(index=[11, 12])
    found = {r["rule"] for r in rows(Q.validate(frame(spark, gap), 300, 100), "rule")}
    assert found == {"irregular_step", "outside_range", "too_few_rows"} or found == {"irregular_step", "too_few_rows"}
    assert {r["rule"] for r in rows(Q.validate(frame(spark, walk(1, "A")), 300), "rule")} == {"single_row"}
    odd = pdf.drop(index=[18])
    assert not [r for r in rows(Q.validate(frame(spark, odd), 300, 0, True), "rule") if r["rule"] == "irregular_step"]
    missing = rows(Q.validate(frame(spark, pdf).drop("volume"), 300), "rule")
    assert [r["rule"] for r in missing] == ["missing_column:volume"]


def test_resample_is_right_closed(spark):
    pdf = walk(6, "A")
    pdf["bar_ts"] = [START + dt.timedelta(minutes=5 * i) for i in (1, 2, 3, 4, 5, 6)]
    out = rows(B.resample(frame(spark, pdf), 900), "bar_ts")
    assert [r["bar_ts"].minute for r in out] == [15, 30]
    assert out[0]["close"] == pdf.close.iloc[2] and out[1]["open"] == pdf.open.iloc[3]


def test_labels_ties_and_tails(spark):
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "5m", "bar_ts": [START + dt.timedelta(minutes=5 * i) for i in range(5)],
                        "open": 100.0, "high": [100.0, 111.0, 100, 100, 100], "low": [100.0, 89.0, 100, 100, 100], "close": 100.0, "volume": 1.0})
    d = S.index_series(frame(spark, pdf))
    strict = [r["target"] for r in rows(L.tp_sl(d, 0.1, 0.1, 2), "bar_idx")]
    tie_wins = [r["label"] for r in rows(L.outcome3(d, 0.1, 0.1, 2, 0.001), "bar_idx")]
    assert strict == [0, 0, 0, -1, -1]
    assert tie_wins == [2, 1, 1, 1, 1]


def test_pivots_are_strict_and_never_at_the_ends(spark):
    pdf = walk(30, "A")
    pdf["high"] = 10.0
    pdf.loc[[0, 12, 20, 21, 29], "high"] = 20.0
    got = [r["bar_idx"] for r in rows(H.pivots(S.index_series(frame(spark, pdf))).filter("pivot_high is not null"), "bar_idx")]
    assert got == [12]


def test_pivots_of_one_price_have_no_trend(spark):
    pdf = walk(120, "A").assign(open=15.0, close=15.0, high=16.0, low=14.0)
    pdf.loc[::10, "high"] = 20.0
    pdf.loc[5::10, "low"] = 10.0
    d = S.index_series(frame(spark, pdf))
    for down_corr in ("parity", "negative"):
        got = rows(H.trendlines(d, down_corr=down_corr), "bar_idx")
        assert len(got) == 120
        assert not any(r[c] for r in got for c in ("tl_uptrend_detected", "tl_downtrend_detected", "tl_trend_slope", "tl_breakout_up", "tl_breakout_down"))
    every = rows(H.chart_patterns(d), "bar_idx")
    assert len(every) == 120 and every[-1]["sr_resistance_strength"] > 0 and not any(r["tl_uptrend_detected"] for r in every)


def test_pivots_on_a_line_have_its_trend(spark):
    pdf = walk(120, "A").assign(open=15.0, close=15.0, high=16.0, low=14.0)
    pdf.loc[::10, "high"] = 30.0 - pdf.index[::10] * 0.1
    pdf.loc[5::10, "low"] = 1.0 + pdf.index[5::10] * 0.1
    d = S.index_series(frame(spark, pdf))
    last = rows(H.trendlines(d, down_corr="negative"), "bar_idx")[-1]
    assert last["tl_uptrend_detected"] == 1 and last["tl_downtrend_detected"] == 1


def test_confirmed_mode_waits(spark):
    pdf = walk(200, "A")
    d = S.index_series(frame(spark, pdf))
    a = H.support_resistance(d.filter("bar_idx <= 150"), "confirmed").filter("bar_idx = 150").select("sr_resistance_dist_pct", "sr_support_strength").collect()
    b = H.support_resistance(d, "confirmed").filter("bar_idx = 150").select("sr_resistance_dist_pct", "sr_support_strength").collect()
    assert a == b


def test_mtf_rules(spark):
    schema = "id int, model_name string, prediction double, confidence double, context string"
    ctx = '{{"entry_signal":{s},"entry_confidence":{c},"entry_proba":{{"sell":{p},"hold":0.1,"buy":{b}}}}}'.format
    data = [(1, "m_BTC_15m", 0.0, 0.0, ctx(s=0.4, c=0.8, p=0.1, b=0.7)), (1, "m_BTC_5m", 0.0, 0.0, ctx(s=0.5, c=0.8, p=0.1, b=0.75)),
            (2, "m_BTC_15m", 0.0, 0.0, ctx(s=0.4, c=0.8, p=0.1, b=0.7)), (2, "m_BTC_5m", 0.0, 0.0, ctx(s=-0.2, c=0.8, p=0.4, b=0.2)),
            (3, "m_BTC_15m", 0.0, 0.0, ctx(s=0.0, c=0.8, p=0.45, b=0.45)), (3, "m_BTC_5m", 0.0, 0.0, ctx(s=0.5, c=0.8, p=0.1, b=0.7)),
            (4, "m_BTC_5m", -0.5, 0.9, None), (5, "plain", 0.4, 0.9, None)]
    d = A.extract(spark.createDataFrame(data, schema)).withColumns({"tf": A.model_timeframe(F.col("model_name")), "rank": F.monotonically_increasing_id()})
    out = {r["id"]: (r["decision"], r["reason"]) for r in rows(A.two_timeframe(A.by_timeframe(d, ["id"], "rank", A.Rules().frames)), "id")}
    assert out == {1: ("STRONG_BUY", "aligned"), 2: ("HOLD", "not_aligned"), 3: ("HOLD", "trend_edge_small"), 4: ("STRONG_SELL", "aligned")}


def test_levels(spark):
    d = spark.createDataFrame([(100.0, "BUY", 5.0), (100.0, "SELL", None), (-1.0, "BUY", 1.0), (100.0, "flat", 1.0)], "e double, s string, a double")
    s, t = X.stop_target("e", "s", F.lit(0.01), F.lit(0.02), "a", 1.0, 1.5, 0.5)
    got = [tuple(r) for r in d.select(s.alias("sl"), t.alias("tp")).collect()]
    assert got == [(95.0, 107.5), (101.0, 98.0), (None, None), (None, None)]


def test_performance_counts_only_evaluated(spark):
    d = spark.createDataFrame([("m", 0.5, 1.0, 10.0), ("m", -0.5, 1.0, -4.0), ("m", 0.5, None, None)], "model string, prediction double, actual double, profit double")
    r = M.performance(d).collect()[0]
    assert (r.total, r.evaluated, r.correct, r.accuracy, r.profit) == (3, 2, 1, 0.5, 6.0)


def test_thresholds_do_not_sort_the_scores_of_a_key(spark):
    """Even where Spark would not broadcast by size."""
    data = [(m, round((i * 37 % 101) / 100, 2), int(i % 101 > 60)) for m in ("a", "b") for i in range(505)]
    d = spark.createDataFrame([*data, (None, 0.5, 1)], "model string, score double, y int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fn in (E.ev_threshold, E.oof_threshold):
            out = fn(d, ["model"], 0.02, 0.03)
            assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
            assert [r["model"] for r in rows(out, "model")] == ["a", "b"]
        for r in rows(E.ev_threshold(d, ["model"], 0.02, 0.03), "model"):
            s = sorted(x for m, x, _ in data if m == r["model"])
            best = None
            for p in range(50, 96, 2):
                at = (len(s) - 1) * p / 100
                t = s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))
                hits = [y for m, x, y in data if m == r["model"] and x >= t]
                ev = sum(hits) / len(hits) * 0.02 - (1 - sum(hits) / len(hits)) * 0.03
                best = ev if best is None or ev > best else best
            assert abs(r["best_ev"] - best) < 1e-12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines(spark):
    text = ['{"time":"2024-01-01T00:00:01","logger":"c","msg":"hello","request_id":"r"}', "[2024-01-01 00:00:02] error: bad thing", "2024-01-01 00:00:03 WARN slow", "INFO: fine", "no shape at all", "{broken"]
    d = spark.createDataFrame([(t, "svc", n) for n, t in enumerate(text)], "line string, stem string, n int")
    out = {r["n"]: (r["level"], r["message"], r["component"]) for r in rows(logs.parse_logs(d), "n")}
    assert out == {0: ("INFO", "hello", "c"), 1: ("ERROR", "bad thing", None), 2: ("WARN", "slow", None), 3: ("INFO", "fine", None)}
    led = spark.createDataFrame([("TRADE|t|id|S|BUY|1.5|100|order_id=o|x=",), ("CLOSE|t|p|S|BUY|1|2|3|4|tp|k=v",), ("TRADER|x",)], "line string")
    tr = ledger.parse_trades(led).collect()
    assert len(tr) == 1 and tr[0].quantity == 1.5 and tr[0].attributes == {"order_id": "o", "x": ""}
    assert ledger.parse_closes(led).collect()[0].attributes == {"k": "v"}


def test_table_layout_prunes(spark, tmp_path):
    path = str(tmp_path / "bars")
    tables.write_bars(frame(spark, series(100)), path)
    d = B.scan_range(tables.read_bars(spark, path), "A", "5m", "2024-01-01 01:00:00", "2024-01-01 02:00:00")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(bar_ts)" in plan
    assert d.count() == 13
    assert tables.read_labeled(spark, str(tmp_path), "5m") is None
