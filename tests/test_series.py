"""The chunked core against pandas, with chunks much smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import folds
from barflow.operators import series as S
from barflow.operators.ranking import ordered_counts, quantiles
from tests.fixtures import frame, series

CHUNK = 32


@pytest.fixture(scope="module")
def data():
    return series()


@pytest.fixture(scope="module")
def idx(spark, data):
    return S.index_series(frame(spark, data), bin_seconds=7200).cache()


def per_symbol(data, fn):
    return pd.concat([fn(g.reset_index(drop=True)).assign(symbol=s, bar_idx=range(len(g))) for s, g in data.groupby("symbol")])


def check(df, expected, cols, tol=1e-9):
    got = df.select("symbol", "bar_idx", *cols).toPandas().merge(expected, on=["symbol", "bar_idx"], suffixes=("", "_x"))
    assert len(got) == len(expected)
    for c in cols:
        a, b = got[c].astype(float).to_numpy(), got[f"{c}_x"].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), c
        np.testing.assert_allclose(np.nan_to_num(a), np.nan_to_num(b), rtol=tol, atol=1e-12, err_msg=c)


def test_index_is_dense(idx, data):
    got = idx.groupBy("symbol").agg(F.count("*").alias("n"), F.max("bar_idx").alias("m"), F.count_distinct("bar_idx").alias("d")).collect()
    assert {r.symbol: r.n for r in got} == data.groupby("symbol").size().to_dict()
    assert all(r.m == r.n - 1 and r.d == r.n for r in got)


def test_frames_cross_chunks(idx, data):
    def build(d, r):
        return d.withColumns({"m": r.mean("close", 50), "s": r.std("close", 20, 1), "q": r.quantile("close", 0.5, 40), "f": r.lead("close", 40)})

    want = per_symbol(data, lambda g: pd.DataFrame({"m": g.close.rolling(50).mean(), "s": g.close.rolling(20, 1).std(), "q": g.close.rolling(40).median(), "f": g.close.shift(-40)}))
    check(S.framed(idx, build, 60, 40, chunk=CHUNK), want, ["m", "s", "q", "f"])


def test_scan_equals_ewm(idx, data):
    specs = [S.ema(f"e{s}", "close", s) for s in (3, 9, 12, 26, 200)] + [S.wilder("w", "close", 14), S.total("t", "volume")]
    want = per_symbol(data, lambda g: pd.DataFrame({**{f"e{s}": g.close.ewm(span=s, adjust=False).mean() for s in (3, 9, 12, 26, 200)},
                                                    "w": g.close.ewm(alpha=1 / 14, adjust=False).mean(), "t": g.volume.cumsum()}))
    for chunk in (CHUNK, 1024):
        check(S.scan(idx, specs, chunk=chunk), want, ["e3", "e9", "e12", "e26", "e200", "w", "t"], 1e-12)


def test_normalised_and_cascaded_ema(idx, data):
    d = S.ema_adjusted(idx, {"a": ("close", 12)}, chunk=CHUNK)
    d = S.scan(d, [S.ema("f", "close", 12), S.ema("n", "close", 9)], chunk=CHUNK).withColumn("c", S.cascade("f", "n", 12, 9))
    want = per_symbol(data, lambda g: pd.DataFrame({"a": g.close.ewm(span=12).mean(), "c": g.close.ewm(span=12, adjust=False).mean().ewm(span=9, adjust=False).mean()}))
    check(d, want, ["a", "c"], 1e-11)


def test_running_and_streak(idx, data):
    d = S.running(idx, {"mx": ("max", "high"), "n": ("count", F.when(F.col("close") > F.col("open"), 1)), "l": ("last", F.when(F.col("bar_idx") % 37 == 0, F.col("close")))}, bins=F.floor(F.col("bar_idx") / 16))
    d = S.streak(d, F.col("close") > F.col("open"), "st")

    def want(g):
        up = g.close > g.open
        return pd.DataFrame({"mx": g.high.cummax(), "n": up.cumsum(), "l": g.close.where(g.index % 37 == 0).ffill(), "st": up.groupby((~up).cumsum()).cumsum()})

    check(d, per_symbol(data, want), ["mx", "n", "l", "st"])


def test_asof_equal_times_and_missing(spark):
    left = spark.sql("select 'a' k, timestamp_ntz'2024-01-01 00:00:00' ts union all select 'a', timestamp_ntz'2024-01-03 00:00:00' union all select 'b', timestamp_ntz'2024-01-03 00:00:00'")
    right = spark.sql("select 'a' k, timestamp_ntz'2024-01-01 00:00:00' rt, 1 v union all select 'a', timestamp_ntz'2024-01-02 12:00:00', null union all select 'b', timestamp_ntz'2024-01-04 00:00:00', 9")
    got = {(r.k, r.ts.day): (r.v, r.at) for r in S.asof_join(left, [(right, "rt", {"v": "v", "rt": "at"})], ("k",), "ts").collect()}
    assert got[("a", 1)][0] == 1
    assert got[("a", 3)][0] is None and got[("a", 3)][1].day == 2
    assert got[("b", 3)] == (None, None)


def test_exact_quantiles_with_ties(spark):
    g = np.random.default_rng(1)
    v = np.r_[np.round(g.standard_normal(2000), 2), np.zeros(1000)]
    df = spark.createDataFrame(pd.DataFrame({"k": ["x"] * 3000, "v": v}))
    got = quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.93}, ["k"]).collect()[0]
    np.testing.assert_allclose([got.a, got.m, got.z], np.quantile(v, [0.1, 0.5, 0.93]), rtol=1e-12)
    c = ordered_counts(df, "v", ["k"]).toPandas().sort_values("value")
    assert (c["before"].to_numpy() == np.r_[0, np.cumsum(c["n"])[:-1]]).all()


def brute_spacing(us, gap):
    out, last = [], None
    for t in us:
        ok = last is None or t - last >= gap
        out.append(ok)
        last = t if ok else last
    return out


@pytest.mark.parametrize("gap", [1, 7, 40, 400])
def test_greedy_spacing(spark, gap):
    g = np.random.default_rng(gap)
    secs = np.sort(g.choice(4000, 900, replace=False))
    pdf = pd.DataFrame({"k": ["a"] * 900, "ts": pd.to_datetime(secs, unit="s")})
    df = spark.createDataFrame(pdf, "k string, ts timestamp_ntz")
    got = folds.greedy_spacing(df, ["k"], gap * 1_000_000, chunk=64).orderBy("ts").toPandas()
    assert got.accepted.tolist() == brute_spacing(secs.tolist(), gap)


def test_short_segments_are_not_folded_one_by_one(spark, monkeypatch):
    """Many keys with segments longer than the gap but of few rows, one with more rows than a chunk, equal times included."""
    g, rows = np.random.default_rng(5), []
    for k in range(60):
        rows += [(f"k{k}", int(t)) for t in np.sort(g.choice(3000, 25))]
    rows += [("hot", int(t)) for t in np.sort(g.choice(3000, 400))]
    df = spark.createDataFrame(pd.DataFrame({"k": [r[0] for r in rows], "ts": pd.to_datetime([r[1] for r in rows], unit="s")}), "k string, ts timestamp_ntz")
    folded, fold = [], folds.chunk_fold
    monkeypatch.setattr(folds, "chunk_fold", lambda d, *args: folded.append(d.select("k").distinct().collect()) or fold(d, *args))
    got = folds.greedy_spacing(df, ["k"], 200_000_000, chunk=64).orderBy("ts").toPandas()
    assert len(got) == len(rows) and [[r.k for r in x] for x in folded] == [["hot"]]
    for key in {r[0] for r in rows}:
        mine = got[got.k == key].sort_values(["ts", "accepted"], ascending=[True, False])
        assert mine.accepted.tolist() == brute_spacing(sorted(t for k, t in rows if k == key), 200)


@pytest.mark.parametrize("thr", [0.002, 0.01, 0.2])
def test_moving_baseline(spark, idx, data, thr):
    got = folds.moving_baseline(idx, ["symbol"], "close", thr, chunk=CHUNK).orderBy("symbol", "bar_idx").toPandas()
    for s, g in data.groupby("symbol"):
        base, want = None, []
        for p in g.close:
            want.append(base)
            if base is None or abs((p - base) / base) >= thr:
                base = p
        assert [None if pd.isna(x) else x for x in got[got.symbol == s].baseline] == want


def test_gap_and_daily_cap(spark, idx, data):
    d = idx.withColumns({"cand": F.col("close") > F.col("open"), "day": F.unix_date(F.to_date("bar_ts"))})
    got = folds.gap_and_daily_cap(d, ["symbol"], "cand", "day", 4, 9, chunk=CHUNK).orderBy("symbol", "bar_idx").toPandas()
    for s, g in data.groupby("symbol"):
        last, used, want = -1000, {}, []
        for i, (o, c, t) in enumerate(zip(g.open, g.close, g.bar_ts)):
            ok = c > o and i - last >= 4 and used.get(t.date(), 0) < 9
            want.append(ok)
            if ok:
                last, used[t.date()] = i, used.get(t.date(), 0) + 1
        assert got[got.symbol == s].accepted.tolist() == want


def test_rolling_cap(spark):
    g = np.random.default_rng(3)
    secs = np.sort(g.choice(40_000, 300, replace=False))
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 300, "ts": pd.to_datetime(secs, unit="s")}), "k string, ts timestamp_ntz")
    got = folds.rolling_cap(df, ["k"], 3, 3_600_000_000).orderBy("ts").toPandas()
    acc, want = [], []
    for t in secs:
        acc = [a for a in acc if a > t - 3600]
        want.append(len(acc) < 3)
        if want[-1]:
            acc.append(t)
    assert got.accepted.tolist() == want


def test_regime_smoothing(spark):
    from barflow.operators.regimes import REGIMES, smooth_labels
    g = np.random.default_rng(5)
    labels = np.repeat(g.choice(REGIMES, 120), g.integers(1, 9, 120))
    pdf = pd.DataFrame({"symbol": "a", "timeframe": "5m", "bar_idx": range(len(labels)), "label": labels})
    got = smooth_labels(spark.createDataFrame(pdf), "label", "out", chunk=CHUNK).orderBy("bar_idx").toPandas().out.tolist()
    want, cur, run = list(labels), labels[0], 0
    for i in range(1, len(want)):
        if want[i] == cur:
            run += 1
        elif run >= 6:
            cur, run = want[i], 1
        else:
            want[i] = cur
    assert got == want


@pytest.fixture
def small_groups(monkeypatch):
    """Three chunks to a group, so that short series already go through composition and several groups."""
    monkeypatch.setattr(folds, "GROUP", 3)


def test_hot_key_without_pauses(spark, small_groups):
    """One key holds nine tenths of the rows and never pauses for the gap; chunks both shorter and longer than it."""
    g = np.random.default_rng(11)
    hot = np.sort(g.choice(30_000, 1800, replace=False))
    rest = [(f"k{i % 20}", int(t)) for i, t in enumerate(np.sort(g.choice(30_000, 200, replace=False)))]
    rows = [("hot", int(t)) for t in hot] + rest
    df = spark.createDataFrame(pd.DataFrame({"k": [r[0] for r in rows], "ts": pd.to_datetime([r[1] for r in rows], unit="s")}), "k string, ts timestamp_ntz")
    for gap in (60, 900, 5000):
        got = folds.greedy_spacing(df, ["k"], gap * 1_000_000, chunk=16).orderBy("ts").toPandas()
        for key in {r[0] for r in rows}:
            assert got[got.k == key].accepted.tolist() == brute_spacing(sorted(t for k, t in rows if k == key), gap)


@pytest.mark.parametrize("thr", [0.003, 0.05])
def test_composed_baselines_on_trends_and_zero(spark, small_groups, thr):
    g = np.random.default_rng(2)
    price = np.r_[100 * np.cumprod(1 + 0.004 * np.abs(g.standard_normal(150))), 0.0, 150 - np.arange(140) * 0.7, 80 + g.standard_normal(100)]
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "bar_idx": range(len(price)), "p": price}), "k string, bar_idx bigint, p double")
    got = folds.moving_baseline(d, ["k"], "p", thr, chunk=8).orderBy("bar_idx").toPandas().baseline
    base, want = None, []
    for p in price:
        want.append(base)
        if base is None or (base != 0 and abs((p - base) / base) >= thr):
            base = p
    assert [None if pd.isna(x) else x for x in got] == want


def test_composed_gaps_and_regimes(spark, idx, data, small_groups):
    test_gap_and_daily_cap(spark, idx, data)
    test_regime_smoothing(spark)
