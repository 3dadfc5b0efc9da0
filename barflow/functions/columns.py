"""Column helpers shared by every operator. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """a / b with NULL for a zero denominator (ANSI mode raises otherwise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x, lo=None, hi=None) -> Column:
    """Clamp, keeping NULL as NULL (greatest/least alone would skip it)."""
    x = col(x)
    y = x
    if lo is not None:
        y = F.greatest(y, col(lo))
    if hi is not None:
        y = F.least(y, col(hi))
    return F.when(x.isNotNull(), y)


def flag(cond: Column) -> Column:
    """Boolean to 0/1, with NULL counted as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def if_(cond: Column, a, b) -> Column:
    return F.when(cond, col(a)).otherwise(col(b))


def finite(x) -> Column:
    """NULL for NaN and the infinities."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def half_even(x, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def pick(*pairs, default=None) -> Column:
    """First value whose condition holds: pick((cond, value), ..., default=...)."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, col(value)) if out is None else out.when(cond, col(value))
    return out if default is None else out.otherwise(col(default))


def reasons(*pairs) -> Column:
    """Array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def moment(ts, tie) -> Column:
    """One ordered number of a time and a tie-breaking id (taken modulo 10^18).

    Unlike a struct it is a fixed-width value, so min_by / max_by over it stay in the hash aggregate.
    """
    late = micros(ts).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    return (late + F.pmod(col(tie), F.lit(10**18)).cast("decimal(18,0)")).cast("decimal(38,0)")


def bucket_start(ts, seconds: int) -> Column:
    """Left-closed bucket start of a timestamp."""
    width = seconds * 1_000_000
    m = micros(ts)
    return F.timestamp_micros(m - F.pmod(m, F.lit(width)))


def bucket_end(ts, seconds: int) -> Column:
    """Right label of the right-closed bucket (t-w, t]."""
    width = seconds * 1_000_000
    m = micros(ts)
    return F.timestamp_micros(m + F.pmod(-m, F.lit(width)))


def rounded(df, digits: int = 6, other: dict[str, int] | None = None):
    """Round every double column for output; ``other`` gives single columns their own places."""
    other = other or {}
    return df.select(
        *[F.round(F.col(f.name), other.get(f.name, digits)).alias(f.name)
          if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    )
