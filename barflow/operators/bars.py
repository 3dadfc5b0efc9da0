"""Bars from ticks, resampling, upserts and the other table-level candle jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.functions.columns import bucket_end, bucket_start, micros, moment
from barflow.operators.series import KEYS, framed, index_series

# Bar length names and their seconds.
BAR_SECONDS = {
    "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400,
    "6h": 21600, "1d": 86400, "1w": 604800,
}
_NAMES = {v: k for k, v in BAR_SECONDS.items()}
OHLCV = ["open", "high", "low", "close", "volume"]


def bar_seconds(resolution: str) -> int:
    key = resolution.strip().lower()
    if key not in BAR_SECONDS:
        raise ValueError(f"unknown bar length {resolution!r}")
    return BAR_SECONDS[key]


def bar_seconds_column(resolution: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BAR_SECONDS.items() for x in pair])
    return table[F.lower(F.trim(resolution))]


def bucket_start_ntz(ts, seconds: int) -> Column:
    return bucket_start(ts, seconds).cast("timestamp_ntz")


def bars_from_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """Left-closed OHLCV bars. One shuffle, partial aggregation; equal times are split by event_id."""
    at = moment("ts", "event_id")
    return ticks.groupBy(
        "symbol", F.lit(_NAMES[seconds]).alias("timeframe"), bucket_start_ntz("ts", seconds).alias("bar_ts")
    ).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))


def resample(bars: DataFrame, seconds: int, keys=("symbol",)) -> DataFrame:
    """Right-closed, right-labelled resample: bucket (t-w, t] stamped t; empty prices dropped."""
    out = bars.groupBy(*keys, bucket_end("bar_ts", seconds).cast("timestamp_ntz").alias("end_ts")).agg(
        F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("end_ts", "bar_ts").dropna(subset=["open", "high", "low", "close"])


def upsert(stored: DataFrame, batch: DataFrame, keys=(*KEYS, "bar_ts")) -> DataFrame:
    """Append and keep the newest version of each bar; a batch lacking a needed column is ignored."""
    if not {*keys, *OHLCV} <= set(batch.columns):
        return stored
    cols = [*keys, *OHLCV]
    both = (stored.select(*cols, F.lit(0).alias("_new"), F.lit(0).cast("bigint").alias("_seq"))
            .unionByName(batch.select(*cols, F.lit(1).alias("_new"),
                                      (F.col("seq") if "seq" in batch.columns else F.lit(0)).cast("bigint")
                                      .alias("_seq"))))
    newest = F.shiftleft(F.col("_new").cast("bigint"), 62) + F.col("_seq")
    return both.groupBy(*keys).agg(*[F.max_by(c, newest).alias(c) for c in OHLCV])


def first_per_time(rows: DataFrame, keys, order: Column) -> DataFrame:
    """Drop repeated (keys); the first by ``order`` stays. Aggregates map-side, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest])


def from_exchange_rows(rows: DataFrame, keys=KEYS, seq: str = "seq") -> DataFrame:
    """Short exchange names and epoch seconds to the bar schema; first row per time stays."""
    named = {"time": "bar_ts", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    out = rows.select(*keys, seq, *[
        (F.timestamp_seconds(F.col(a)).cast("timestamp_ntz") if b == "bar_ts" else F.col(a).cast("double")).alias(b)
        for a, b in named.items()])
    return first_per_time(out, [*keys, "bar_ts"], F.col(seq)).drop(seq)


def epoch_to_timestamp(number: Column, micros_above: float = 1e12, millis_above: float = 1e10) -> Column:
    """Epoch of unknown unit: above 1e12 micros, above 1e10 millis, else seconds."""
    n = number.cast("double")
    us = (F.when(n > micros_above, n).when(n > millis_above, n * 1000.0).otherwise(n * 1e6))
    return F.timestamp_micros(F.round(us).cast("bigint"))


def epoch_millis_to_timestamp(number: Column) -> Column:
    """Second variant: above 1e12 milliseconds, else seconds."""
    n = number.cast("double")
    return F.timestamp_micros(F.round(F.when(n > 1e12, n * 1000.0).otherwise(n * 1e6)).cast("bigint"))


def text_to_timestamp(text: Column) -> Column:
    """ISO text; without a zone it is UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def scan_range(bars: DataFrame, symbol: str, timeframe: str, start=None, end=None) -> DataFrame:
    """Inclusive range of one series; every predicate reaches the Parquet scan."""
    out = bars.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    if start is not None:
        out = out.filter(F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("bar_ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def tail(bars: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Newest n bars per series, from the dense index and one count per series."""
    sized = index_series(bars, keys)
    last = sized.groupBy(*keys).agg(F.max("bar_idx").alias("_last"))
    return sized.join(last, list(keys)).filter(F.col("bar_idx") > F.col("_last") - n).drop("_last")


def union_pages(pages: list[DataFrame], keys=(*KEYS, "bar_ts")) -> DataFrame:
    """Pages of history; rows at an overlapping edge are taken from the newer page (listed first)."""
    stacked = None
    for n, p in enumerate(pages):
        p = p.withColumn("_page", F.lit(n))
        stacked = p if stacked is None else stacked.unionByName(p)
    return first_per_time(stacked, list(keys), F.col("_page")).drop("_page")


def grid_fill(bars: DataFrame, seconds: int, max_run: int = 3, now: Column | None = None,
              keys=KEYS, piece: int = 512) -> DataFrame:
    """Full grid per series; forward filled, but runs of more than ``max_run`` missing bars stay NULL.

    A gap is the space between two neighbours, so the missing bars of a gap come from its left row:
    no grid join, and a long series is not gathered. Gaps expand in pieces, so one wide gap splits too.
    """
    data = index_series(bars, keys)
    step = seconds * 1_000_000

    def build(df, r):
        missing = (micros(r.lead("bar_ts")) - micros("bar_ts")) / F.lit(step) - 1
        return df.withColumn("_miss", F.coalesce(missing.cast("bigint"), F.lit(0)))

    gaps = framed(data, build, after=1, keys=keys)
    gaps = gaps.withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor(F.col("_miss") / piece))))
    k = F.explode(F.sequence(F.col("_p") * piece, F.least(F.col("_miss"), F.col("_p") * piece + piece - 1)))
    rows = gaps.withColumn("_k", k)
    real = F.col("_k") == 0
    keep = real | (F.col("_miss") <= max_run)
    out = rows.select(
        *keys,
        F.timestamp_micros(micros("bar_ts") + F.col("_k") * step).cast("timestamp_ntz").alias("bar_ts"),
        *[F.when(keep, F.col(c)).alias(c) for c in OHLCV], (~real).alias("filled"))
    return out if now is None else out.filter(micros("bar_ts") <= micros(now) - step)


def window_desc(keys, *order):
    return Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
