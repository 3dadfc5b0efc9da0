"""As-of joins of ticks, features of the newest bars, side series by symbol, labelled files, union of feature groups."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import indicators as I
from barflow.operators import perpetual, quality
from barflow.operators import series as S
from barflow.sources import tables
from tests.fixtures import START, frame, series

SIDE = "symbol string, bar_ts timestamp_ntz, {} double"


def test_asof_of_ticks_spreads_a_hot_day(spark, monkeypatch):
    """Nine of ten ticks are one symbol's within one day; the side has rows at equal times, NULL values and an unknown symbol."""
    rng = np.random.default_rng(3)
    n = 6000
    ticks = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.9, "hot", "cold"), "id": np.arange(n),
                          "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 86_000, n), unit="s")})
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(86_000, 900, replace=False)), unit="s")
    side = pd.DataFrame({"symbol": np.where(np.arange(900) % 3 > 0, "hot", "none"), "at": at, "v": np.where(np.arange(900) % 5, np.arange(900.0), np.nan)})
    side.loc[5, "at"] = ticks.ts[ticks.symbol == "hot"].iloc[0]
    side = side.drop_duplicates(["symbol", "at"]).sort_values("at")
    left = spark.createDataFrame(ticks).select("symbol", "id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    right = spark.createDataFrame(side).select("symbol", F.col("at").cast("timestamp_ntz").alias("at"), F.when(~F.isnan("v"), F.col("v")).alias("v"))
    bins = []
    original = S.range_bins

    def watched(df, keys, order, name="_bin"):
        out = original(df, keys, order, name)
        bins.extend(r["count"] for r in out.filter("symbol = 'hot'").groupBy(name).count().collect())
        return out

    monkeypatch.setattr(S, "range_bins", watched)
    got = S.asof_join(left, [(right, "at", {"v": "v", "at": "matched"})], ts="ts", balanced=True).toPandas().sort_values("id")
    assert len(bins) >= 6 and max(bins) < n / 3
    want = pd.merge_asof(ticks.sort_values("ts"), side, left_on="ts", right_on="at", by="symbol").sort_values("id")
    assert len(got) == n
    np.testing.assert_array_equal(got.v.to_numpy(float), want.v.to_numpy(float))
    assert (got.matched.isna().to_numpy() == want["at"].isna().to_numpy()).all()


@pytest.mark.parametrize("last", [1, 7])
def test_newest_features_equal_those_of_the_whole_series(spark, monkeypatch, last):
    data = series(2600)  # three chunks, two, and one
    bars = frame(spark, data).withColumn("timeframe", F.lit("30m"))
    whole = I.canonical(bars, 30)
    want = whole.join(whole.groupBy("symbol").agg(F.max("bar_idx").alias("end")), "symbol").filter(F.col("bar_idx") > F.col("end") - last)
    seen, original = [], S.framed

    def watched(df, build, before=0, *rest, **more):
        if before > 1:
            seen.append(df.count())
        return original(df, build, before, *rest, **more)

    order = ["symbol", "bar_idx"]
    want = want.select(*order, *I.CANONICAL).orderBy(*order).toPandas()
    monkeypatch.setattr(I, "framed", watched)
    got = I.canonical(bars, 30, last=last).select(*order, *I.CANONICAL).orderBy(*order).toPandas()
    symbols = data.symbol.nunique()
    assert len(got) == len(want) == sum(min(last, n) for n in data.symbol.value_counts())
    assert seen[0] <= symbols * (I.REACH + 16 + last) and (got[order].to_numpy() == want[order].to_numpy()).all()
    np.testing.assert_allclose(got[I.CANONICAL].to_numpy(float), want[I.CANONICAL].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_side_series_belong_to_their_symbol(spark):
    at = [START + dt.timedelta(hours=h) for h in range(4)]
    bars = spark.createDataFrame([(s, "1h", t, float(k)) for s in "ab" for k, t in enumerate(at)], "symbol string, timeframe string, bar_ts timestamp_ntz, close double")
    mark = spark.createDataFrame([("a", at[1], 10.0), ("b", at[0], 20.0), ("b", at[2], None), ("c", at[0], 5.0)], SIDE.format("mark_price"))
    none = spark.createDataFrame([], SIDE.format("funding_rate"))
    rows = perpetual.side_matrix(bars, {"mark_price": mark, "funding_rate": none}).orderBy("symbol", "bar_ts").collect()
    assert [r.mark_price for r in rows] == [None, 10.0, 10.0, 10.0, 20.0, 20.0, 20.0, 20.0]
    assert all(r.funding_rate is None for r in rows) and [r.close for r in rows] == [0.0, 1.0, 2.0, 3.0] * 2


def test_labelled_files_by_timeframe(spark, tmp_path):
    rows = spark.createDataFrame([("a", tf, START + dt.timedelta(minutes=m), m) for tf in ("5m", "1h") for m in range(6)],
                                 "symbol string, timeframe string, bar_ts timestamp_ntz, label int")
    tables.write_labeled(rows, str(tmp_path), ["5m", "1h", "4h"])
    assert sorted(r.label for r in tables.read_labeled(spark, str(tmp_path), "5m").collect()) == list(range(6))
    tables.write_labeled(rows.filter("label < 2"), str(tmp_path), ["5m"])
    assert tables.read_labeled(spark, str(tmp_path), "5m").count() == 2 and tables.read_labeled(spark, str(tmp_path), "1h").count() == 6
    assert tables.read_labeled(spark, str(tmp_path), "4h").collect() == []
    assert tables.read_labeled(spark, str(tmp_path), "1d") is None


def test_union_of_feature_groups_is_sorted(spark):
    one = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "symbol string, z double, m double")
    two = spark.createDataFrame([("a", 1.0, 4.0)], "symbol string, m double, `b.c` double")
    got = [tuple(r) for r in quality.feature_union({"two": two, "one": one}, ["symbol"]).select("position", "feature", "groups", "n_values").orderBy("position").collect()]
    assert got == [(0, "b.c", "two", 1), (1, "m", "one,two", 2), (2, "z", "one", 2)]
    empty = quality.feature_union({"one": one.limit(0)}, ["symbol"]).collect()
    assert sorted((r.feature, r.n_values) for r in empty) == [("m", 0), ("z", 0)]
