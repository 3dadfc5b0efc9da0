"""Exact order statistics without sorting a column in one task.

Equal values are merged first, so a heavy tie is one row. The distinct values are range partitioned
into bins of even size, which also spreads a hot key. Ranks inside a bin come from a window over the
bin, ranks of whole bins from one row per bin; the result is exact whatever the bounds are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.operators.series import range_bins


def ordered_counts(df: DataFrame, value: str, keys: list[str], sums: dict[str, object] | None = None) -> DataFrame:
    """Distinct values with their count and the counts before them: keys, value, n, before, total.

    ``sums`` adds columns: name -> numeric column; each also gets ``<name>_before`` and ``<name>_total``.
    """
    sums = {"n": F.lit(1), **(sums or {})}
    v = F.col(value)
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.cast("double").alias("value"), *[
        (e if not isinstance(e, str) else F.col(e)).alias(f"_x_{s}") for s, e in sums.items()])
    distinct = rows.groupBy(*keys, "value").agg(*[F.sum(f"_x_{s}").alias(s) for s in sums])
    placed = range_bins(distinct, keys, ["value"])
    whole = placed.groupBy(*keys, "_bin").agg(*[F.sum(s).alias(f"_w_{s}") for s in sums])
    order = Window.partitionBy(*keys).orderBy("_bin")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    span = Window.partitionBy(*keys)
    offsets = whole.select(*keys, "_bin", *[F.coalesce(F.sum(f"_w_{s}").over(ahead), F.lit(0)).alias(f"_o_{s}") for s in sums],
                           *[F.sum(f"_w_{s}").over(span).alias("total" if s == "n" else f"{s}_total") for s in sums])
    inside = Window.partitionBy(*keys, "_bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_l_{s}") for s in sums])
    out = local.join(offsets, [*keys, "_bin"])
    return out.select(*keys, "value", *sums, *[(F.col(f"_o_{s}") + F.col(f"_l_{s}")).alias("before" if s == "n" else f"{s}_before") for s in sums],
                      "total", *[f"{s}_total" for s in sums if s != "n"])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str]) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one output column per entry of ``probs``."""
    c = ordered_counts(df, value, keys)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    out = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        v_lo = F.max(F.when((first <= lo) & (lo <= last), F.col("value")))
        v_hi = F.max(F.when((first <= hi) & (hi <= last), F.col("value")))
        frac = F.max(at - lo)
        out.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return c.groupBy(*keys).agg(*out)


def long_form(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Wide features to (keys, feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")
