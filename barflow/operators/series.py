"""Ordered computation over long series without one task per series.

A series is the rows of one key (symbol, timeframe) in time order. One key may hold a third of all
rows, so nothing here partitions by the key alone except tables that hold one row per chunk:

* ``index_series``   dense row number: counts per time bin, prefix over bins, row_number in a bin.
* ``framed``         row frames over fixed-size chunks; each chunk gets the rows its frames reach.
* ``scan``           linear recurrences and running sums: scan in the chunk plus a carry per chunk.
* ``running``        running sum / max / min / count / last value over arbitrary bins.
* ``asof_join``      latest right row at or before each left row, by union and running last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barflow.functions.columns import col, micros
from barflow.session import stage

KEYS = ("symbol", "timeframe")
CHUNK = 1024
# Chunk of tick and trade series, which are far longer than bar series.
TICK_CHUNK = 65_536
DAY = 86_400


def range_bins(df: DataFrame, keys, order, name: str = "_bin") -> DataFrame:
    """Cut rows into bins of even size along (keys, order), so that a hot key spreads over many bins.

    The bin is the partition of a range repartitioning. Its bounds come from a sample, so the result is
    materialised before several passes read it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *keys, *order).withColumn(name, F.spark_partition_id()))


def index_series(df: DataFrame, keys=KEYS, order=("bar_ts",), bin_seconds: int = DAY,
                 name: str = "bar_idx", balanced: bool = False) -> DataFrame:
    """Add a dense 0-based row number per key.

    Bars have a bounded number of rows per time bin (the first order column must then be a timestamp);
    ticks and trades have not: ``balanced`` cuts them into range bins instead.
    """
    if balanced:
        binned = range_bins(df, keys, order)
    else:
        binned = df.withColumn("_bin", F.floor(micros(order[0]) / F.lit(bin_seconds * 1_000_000)))
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    return (
        binned.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bin"])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_bin", "_rn", "_off")
    )


class Roll:
    """Row-frame expressions over one window; ``n`` rows ending at the current one."""

    def __init__(self, w: WindowSpec):
        self.w = w

    def _frame(self, n: int, shift: int = 0) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1) - shift, -shift)

    def _agg(self, fn, x, n, m, shift=0) -> Column:
        x, frame = col(x), self._frame(n, shift)
        out = fn(x).over(frame)
        m = n if m is None else m
        return out if m <= 1 else F.when(F.count(x).over(frame) >= m, out)

    def mean(self, x, n, m=None, shift=0):
        return self._agg(F.avg, x, n, m, shift)

    def sum(self, x, n, m=None, shift=0):
        return self._agg(F.sum, x, n, m, shift)

    def max(self, x, n, m=None, shift=0):
        return self._agg(F.max, x, n, m, shift)

    def min(self, x, n, m=None, shift=0):
        return self._agg(F.min, x, n, m, shift)

    def std(self, x, n, m=None, shift=0):
        return self._agg(F.stddev_samp, x, n, m, shift)

    def quantile(self, x, p, n, m=None, shift=0):
        return self._agg(lambda c: F.percentile(c, p), x, n, m, shift)

    def values(self, x, n, shift=0):
        return F.collect_list(col(x)).over(self._frame(n, shift))

    def ahead(self, x, n, start=1):
        """Values of the next rows start..start+n-1, in order."""
        return F.collect_list(col(x)).over(self.w.rowsBetween(start, start + n - 1))

    def lag(self, x, k=1):
        return F.lag(col(x), k).over(self.w)

    def lead(self, x, k=1):
        return F.lead(col(x), k).over(self.w)

    def diff(self, x, k=1):
        return col(x) - self.lag(x, k)

    def over(self, agg: Column, lo: int, hi: int) -> Column:
        return agg.over(self.w.rowsBetween(lo, hi))


def framed(df: DataFrame, build, before: int = 0, after: int = 0, keys=KEYS, chunk: int = CHUNK,
           idx: str = "bar_idx") -> DataFrame:
    """Run ``build(df, Roll)`` with windows over (keys, chunk) instead of keys.

    Each chunk also gets the ``before`` rows ahead of it and the ``after`` rows behind it, so every
    frame of its own rows is complete; ``before`` and ``after`` are the summed reach of nested frames.
    """
    i = F.col(idx)
    lo = F.greatest(F.lit(0), F.floor((i - after) / F.lit(chunk)))
    hi = F.floor((i + before) / F.lit(chunk))
    spread = df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    out = build(spread, Roll(w))
    return out.filter(F.col("_chunk") == F.floor(i / F.lit(chunk))).drop("_chunk")


@dataclass(frozen=True)
class Linear:
    """y[t] = decay * y[t-1] + gain * x[t]. With ``seed`` s, y[s] = x[s] and earlier rows are NULL."""

    name: str
    x: str
    decay: float
    gain: float = 1.0
    seed: int | None = None


def ema(name: str, x: str, span: float, seed: int = 0) -> Linear:
    a = 2.0 / (span + 1.0)
    return Linear(name, x, 1.0 - a, a, seed)


def wilder(name: str, x: str, period: int, seed: int = 0) -> Linear:
    a = 1.0 / period
    return Linear(name, x, 1.0 - a, a, seed)


def total(name: str, x: str) -> Linear:
    """Running sum; NULL counts as 0."""
    return Linear(name, x, 1.0)



def scan(df: DataFrame, specs: list[Linear], keys=KEYS, chunk: int = CHUNK,
         idx: str = "bar_idx", since: str | None = None) -> DataFrame:
    """Add one column per spec, all in one pass over a dense index.

    In a chunk y is a running sum of x * decay^-pos rescaled (centred, so it stays in double range
    for decay >= 0.5); the value entering a chunk folds the ends of the chunks before it, back to where
    the weight is zero in double arithmetic, for decay = 1 all of them. The table of ends is ``chunk``
    times smaller than the series. Inputs are dense after the seed row. A decay whose powers leave the
    double range within half a chunk is refused; use a smaller chunk for it. ``since`` names a
    column with an index per series: chunks that end before it lend their ends only and are not returned.
    """
    mid = chunk // 2
    for s in specs:
        if not 0 < s.decay <= 1 or mid * -math.log(s.decay) > 700:
            raise ValueError(f"{s.name}: decay {s.decay} is out of range for chunks of {chunk} rows")
    key_list = ", ".join(f"`{k}`" for k in keys)

    def weighted(s: Linear) -> str:
        x = f"coalesce(cast(`{s.x}` AS double), 0D)"
        if s.seed is None:
            return f"{x} * {s.gain!r}D"
        return f"CASE WHEN `{idx}` = {s.seed} THEN {x} WHEN `{idx}` > {s.seed} THEN {x} * {s.gain!r}D ELSE 0D END"

    def power(s: Linear, exponent: str) -> str:
        return "1D" if s.decay == 1.0 else f"pow({s.decay!r}D, cast({exponent} AS double))"

    based = df.selectExpr("*", f"`{idx}` div {chunk} AS _blk", f"`{idx}` % {chunk} AS _pos")
    ends = based.groupBy(*keys, "_blk").agg(
        *[F.expr(f"sum(({weighted(s)}) * {power(s, f'{chunk - 1} - _pos')})").alias(f"_e{i}") for i, s in enumerate(specs)])
    by_block = f"(PARTITION BY {key_list} ORDER BY _blk"

    def carry(i: int, s: Linear) -> str:
        if s.decay == 1.0:
            return f"coalesce(sum(_e{i}) OVER {by_block} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
        # Beyond this many chunks even the largest double times the weight is less than the smallest.
        reach = math.ceil(1460 / (chunk * -math.log(s.decay))) + 1
        ahead = f"collect_list(_e{i}) OVER {by_block} ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING)"
        return f"aggregate({ahead}, 0D, (held, e) -> held * {s.decay**chunk!r}D + e)"

    carries = ends.selectExpr(*keys, "_blk", *[f"{carry(i, s)} AS _c{i}" for i, s in enumerate(specs)])
    inside = f"(PARTITION BY {key_list}, _blk ORDER BY `{idx}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wanted = based if since is None else based.filter(f"_blk >= `{since}` div {chunk}")
    local = wanted.selectExpr("*", *[f"sum(({weighted(s)}) * {power(s, f'{mid} - _pos')}) OVER {inside} AS _s{i}"
                                    for i, s in enumerate(specs)])

    def value(i: int, s: Linear) -> str:
        y = f"_s{i} * {power(s, f'_pos - {mid}')} + _c{i} * {power(s, '_pos + 1')}"
        if s.seed is None:
            return y
        return f"CASE WHEN `{idx}` = {s.seed} THEN cast(`{s.x}` AS double) WHEN `{idx}` > {s.seed} THEN {y} END"

    kept = [c for c in df.columns if c not in {s.name for s in specs}]
    return local.join(carries, [*keys, "_blk"]).selectExpr(
        *[f"`{c}`" for c in kept], *[f"{value(i, s)} AS `{s.name}`" for i, s in enumerate(specs)])


def ema_adjusted(df: DataFrame, items: dict[str, tuple[str, float]], seed: int = 0, keys=KEYS,
                 chunk: int = CHUNK) -> DataFrame:
    """Normalised EMA: sum of decayed values over sum of decayed weights. items: out -> (x, span)."""
    specs = [Linear(f"_n_{out}", x, 1.0 - 2.0 / (span + 1.0), 1.0, None) for out, (x, span) in items.items()]
    df = scan(df, specs, keys, chunk)
    for out, (_, span) in items.items():
        q = 1.0 - 2.0 / (span + 1.0)
        weight = (1.0 - F.pow(F.lit(q), F.col("bar_idx") - seed + 1.0)) / (1.0 - q)
        df = df.withColumn(out, F.when(F.col("bar_idx") >= seed, F.col(f"_n_{out}") / weight)).drop(f"_n_{out}")
    return df


def cascade(fast, slow, fast_span: float, slow_span: float) -> Column:
    """EMA(slow_span) of EMA(fast_span) of x, from the two plain EMAs of x (partial fractions).

    Both start from the first value, i.e. from a constant past, so the identity holds from row 0.
    """
    p, q = 1.0 - 2.0 / (fast_span + 1.0), 1.0 - 2.0 / (slow_span + 1.0)
    return col(slow) + (col(fast) - col(slow)) * F.lit((1.0 - q) * p / (p - q))


_RUN = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, items: dict[str, tuple[str, object]], keys=KEYS, order=("bar_idx",),
            bins: Column | None = None) -> DataFrame:
    """Running aggregates over the whole series. items: out -> (sum|count|max|min|last, column).

    ``bins`` must not decrease along ``order``; default is the chunk of ``bar_idx``. A bin is scanned
    in one task, bins are combined through one row each.
    """
    bins = F.floor(F.col("bar_idx") / F.lit(CHUNK)) if bins is None else bins
    keys = list(keys)
    own = [c for c in df.columns if c not in items]
    df = df.select("*", bins.alias("_bin"), *[col(c).alias(f"_v{i}") for i, (_, c) in enumerate(items.values())])
    kinds = [k for k, _ in items.values()]

    def whole(i, kind):
        if kind == "last":
            at = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])
            return F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), at))
        return _RUN[kind][0](F.col(f"_v{i}"))

    ends = df.groupBy(*keys, "_bin").agg(*[whole(i, k).alias(f"_e{i}") for i, k in enumerate(kinds)])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"count": F.sum}
    carries = ends.select(*keys, "_bin", *[
        fold.get(k, _RUN[k][0])(F.col(f"_e{i}")).over(before).alias(f"_c{i}") for i, k in enumerate(kinds)
    ])
    inside = (Window.partitionBy(*keys, "_bin").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.select("*", *[_RUN[k][0](F.col(f"_v{i}")).over(inside).alias(f"_l{i}") for i, k in enumerate(kinds)])
    out = out.join(carries, [*keys, "_bin"])
    return out.select(*own,
                      *[_RUN[kind][1](F.col(f"_c{i}"), F.col(f"_l{i}")).alias(name) for i, (name, (kind, _)) in enumerate(items.items())])


def time_bins(ts: str, seconds: int = DAY) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def asof_join(left: DataFrame, rights: list[tuple[DataFrame, str, dict[str, str]]], keys=("symbol",),
              ts: str = "bar_ts", bin_seconds: int = DAY, balanced: bool = False) -> DataFrame:
    """Latest right row with right.ts <= left.ts, for several right sides in one pass.

    ``rights`` holds (frame, its time column, {right column: output column}). All sides are stacked,
    sorted once and filled forward. A right row keeps its own NULLs: the row is matched, not the value.
    Bars have a bounded number of rows per time bin; ticks have not: ``balanced`` cuts the stacked sides
    into range bins of even size, which all of them share.
    """
    left_cols = left.columns
    stacked = left.withColumn("_side", F.lit(1)).withColumn("_at", F.col(ts))
    outs: dict[str, tuple[str, object]] = {}
    picks = []
    for n, (right, rts, cols) in enumerate(rights):
        packed = right.select(
            *keys, F.col(rts).cast(dict(left.dtypes)[ts]).alias("_at"), F.lit(0).alias("_side"),
            F.struct(*[F.col(a).alias(b) for a, b in cols.items()]).alias(f"_r{n}"))
        stacked = stacked.unionByName(packed, allowMissingColumns=True)
        outs[f"_m{n}"] = ("last", f"_r{n}")
        picks += [F.col(f"_m{n}.{b}").alias(b) for b in cols.values()]
    if balanced:
        stacked, bins = range_bins(stacked, keys, ("_at", "_side"), "_even"), F.col("_even")
    else:
        bins = time_bins("_at", bin_seconds)
    filled = running(stacked, outs, keys, ("_at", "_side"), bins)
    return filled.filter(F.col("_side") == 1).select(*left_cols, *picks)


def streak(df: DataFrame, cond, name: str, keys=KEYS, idx: str = "bar_idx") -> DataFrame:
    """Length of the run of rows where ``cond`` holds, 0 where it does not."""
    breaks = F.when(~F.coalesce(cond, F.lit(False)), F.col(idx))
    out = running(df, {"_brk": ("max", breaks)}, keys, (idx,))
    return out.withColumn(name, F.col(idx) - F.coalesce(F.col("_brk"), F.lit(-1))).drop("_brk")
