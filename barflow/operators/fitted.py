"""A feature pipeline that is fitted on one frame and applied to others: a ``pyspark.ml`` Estimator and its Model.

Fitting remembers the feature columns in their order, the exact median of each, and its least and largest finite value. Applying gives
just these columns, in that order, after ``idCols``: a column that is lacking is filled whole, others are dropped;
values that are not finite count as missing, values outside what was seen are moved to the bound, and missing ones
become the median (0 where a feature had no value at all). The model is saved and loaded as its parameters.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators.drift import feature_medians


class _Columns(Params):
    features = Param(Params._dummy(), "features", "feature columns in order", TypeConverters.toListString)
    idCols = Param(Params._dummy(), "idCols", "columns that are kept as they are", TypeConverters.toListString)

    def _finite(self, name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


class FeaturePipeline(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Without ``features`` all numeric columns but ``idCols`` are features."""

    def __init__(self, features: list[str] | None = None, idCols: list[str] | None = None):
        super().__init__()
        self._set(idCols=idCols or [], **({"features": features} if features else {}))

    def _fit(self, df: DataFrame) -> FeaturePipelineModel:
        ids = self.getOrDefault(self.idCols)
        numeric = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") and f.name not in ids]
        names = self.getOrDefault(self.features) if self.isSet(self.features) else numeric
        clean = df.select(*[self._finite(n).alias(n) for n in names])
        # A row for all features, and one for each.
        row = clean.agg(*[F.min(f"`{n}`").alias(f"lo_{i}") for i, n in enumerate(names)], *[F.max(f"`{n}`").alias(f"hi_{i}") for i, n in enumerate(names)]).first()
        medians = {r.feature: r.median for r in feature_medians(clean, names).collect()}
        zero = lambda x: 0.0 if x is None else float(x)
        return FeaturePipelineModel(names, ids, [zero(medians.get(n)) for n in names], [zero(row[f"lo_{i}"]) for i in range(len(names))], [zero(row[f"hi_{i}"]) for i in range(len(names))])


class FeaturePipelineModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "median of each feature", TypeConverters.toListFloat)
    lower = Param(Params._dummy(), "lower", "least value of each feature", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "largest value of each feature", TypeConverters.toListFloat)

    def __init__(self, features=None, idCols=None, medians=None, lower=None, upper=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(features=features, idCols=idCols, medians=medians, lower=lower, upper=upper).items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        out = [F.col(f"`{c}`") for c in self.getOrDefault(self.idCols)]
        for name, mid, lo, hi in zip(*[self.getOrDefault(p) for p in (self.features, self.medians, self.lower, self.upper)]):
            # An infinite value is missing, not beyond a bound.
            value = self._finite(name) if name in df.columns else F.lit(None).cast("double")
            bounded = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))
            out.append(F.coalesce(bounded, F.lit(mid)).alias(name))
        return df.select(*out)
