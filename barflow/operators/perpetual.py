"""Features of perpetual futures: basis, funding, open interest and squeeze risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import EPS, clip, div, flag
from barflow.functions.names import b
from barflow.operators.quality import fill_forward
from barflow.operators.series import KEYS, Roll, ema_adjusted, framed, index_series


def side_matrix(bars: DataFrame, sides: dict[str, DataFrame], on=("symbol", "bar_ts")) -> DataFrame:
    """Bars with side series of their own symbol, each filled forward along the series.

    ``sides`` maps a column to a frame with ``on`` and that column, one row per ``on`` at most. The joins share one
    key, so the bars are shuffled once. A bar without a side row takes the latest one of an earlier bar, NULL before the first.
    """
    d = bars
    for name, side in sides.items():
        d = d.join(side.select(*on, name), list(on), "left")
    return fill_forward(index_series(d), list(sides), None)


def _z(r: Roll, x: str, n: int):
    return div(F.col(x) - r.mean(x, n), r.std(x, n))


def basis(d: DataFrame, r: Roll) -> DataFrame:
    d = d.withColumn("basis", F.col("mark_price") - b.C).withColumn("basis_pct", div("basis", b.C))
    return d.withColumns({"basis_zscore": _z(r, "basis_pct", 48), "basis_direction": F.signum("basis")})


def funding(d: DataFrame, r: Roll) -> DataFrame:
    d = d.withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))
    d = d.withColumns({"funding_cumsum_3": r.sum("funding_rate", 3), "funding_zscore": _z(r, "funding_rate", 168),
                       "funding_sign": F.signum("funding_rate")})
    return d.withColumn("funding_spike", flag(F.abs("funding_zscore") > 2))


def open_interest(d: DataFrame, r: Roll) -> DataFrame:
    """Expects open interest already filled forward; rows before its first value count as 0."""
    d = d.withColumn("oi", F.coalesce("open_interest", F.lit(0.0)))
    oi = F.col("oi")
    price, move = (F.signum(F.coalesce(r.diff(x), F.lit(0.0))) for x in (b.C, oi))
    return d.withColumns({
        "oi_change_pct": F.coalesce(div(oi, r.lag(oi)) - 1, F.lit(0.0)), "oi_change_5": F.coalesce(div(oi, r.lag(oi, 5)) - 1, F.lit(0.0)),
        "oi_price_confirm": flag(price == move) * 2 - 1, "oi_zscore": _z(r, "oi", 336)})


def squeeze(d: DataFrame) -> DataFrame:
    spike = (F.col("funding_spike") > 0) & (F.col("oi_change_pct") < -0.01)
    return d.withColumns({"long_squeeze_risk": flag((F.col("funding_sign") > 0) & spike),
                          "short_squeeze_risk": flag((F.col("funding_sign") < 0) & spike)})


def perpetual_features(indexed: DataFrame, keys=KEYS) -> DataFrame:
    def build(d, r):
        return squeeze(open_interest(funding(basis(d, r), r), r))

    return framed(indexed, build, before=337, keys=keys)


def funding_series(indexed: DataFrame, keys=KEYS) -> DataFrame:
    """Features of the funding series itself, to be brought to bars by an as-of join."""
    d = ema_adjusted(indexed, {"funding_ema8": ("funding_rate", 8)}, keys=keys)

    def build(x, r):
        z = (F.col("funding_rate") - r.mean("funding_rate", 50, 10)) / (r.std("funding_rate", 50, 10) + EPS)
        return x.withColumns({"funding_cum3": r.sum("funding_rate", 3), "funding_zscore": clip(z, -4.0, 4.0)})

    return framed(d, build, before=50, keys=keys)
