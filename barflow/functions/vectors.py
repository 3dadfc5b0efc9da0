"""Vectors as array columns: assembly, cosine similarity, context embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import div, finite


def assemble(df: DataFrame, features: list[str], medians: DataFrame, out: str = "vector") -> DataFrame:
    """Ordered features as one array; a missing or non-finite value takes the training median, else 0.

    ``medians`` has one row per feature, so it is folded into one map.
    """
    row = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()
    d = df.withColumn("_m", row)
    return d.withColumn(out, F.array(*[F.coalesce(finite(f), F.col("_m")[f], F.lit(0.0)) for f in features])).drop("_m")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL for unequal lengths or a zero vector."""
    return F.when(F.size(a) == F.size(b), div(dot(a, b), norm(a) * norm(b)))


def l2_normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(a)


def context_embedding(features: Column, volatility: Column, regime: Column, trend: Column, ts: Column) -> Column:
    """A feature vector of any width and 10 context factors, scaled to unit length."""
    turn = 2 * math.pi * F.hour(ts) / 24.0
    context = [F.least(F.lit(1.0), volatility * 50), *[F.when(regime == r, 1.0).otherwise(0.0) for r in ("bull", "bear", "neutral")],
               trend, F.sin(turn), F.cos(turn)]
    context += [F.lit(0.0)] * (10 - len(context))
    raw = F.concat(F.transform(features, lambda x: x.cast("double")), F.array(*[x.cast("double") for x in context]))
    return l2_normalized(F.transform(raw, lambda x: F.coalesce(x, F.lit(0.0))))
