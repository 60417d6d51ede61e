"""Standard scaler with exclusions and inverse transform, as a pyspark.ml stage.

Fit is one aggregate (mean and population std, NULLs skipped) whose single row is the model;
transform and inverse are projections with the parameters as literals, so they fuse into the
surrounding codegen stage. A zero or undefined std scales by 1. Excluded columns pass through.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to consider", typeConverter=TypeConverters.toListString)
    excludeCols = Param(Params._dummy(), "excludeCols", "columns passed through unscaled", typeConverter=TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(excludeCols=[])

    def scaled_columns(self) -> list[str]:
        ex = set(self.getOrDefault(self.excludeCols))
        return [c for c in self.getOrDefault(self.inputCols) if c not in ex]


class NullAwareStandardScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "NullAwareStandardScalerModel":
        cols = self.scaled_columns()
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        means = [float(row[f"m_{c}"]) if row[f"m_{c}"] is not None else 0.0 for c in cols]
        stds = [float(row[f"s_{c}"]) if row[f"s_{c}"] not in (None, 0.0) else 1.0 for c in cols]
        model = NullAwareStandardScalerModel(
            inputCols=self.getOrDefault(self.inputCols), excludeCols=self.getOrDefault(self.excludeCols), means=means, stds=stds
        )
        return model


class NullAwareStandardScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population std (0 -> 1)", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, means=None, stds=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def params_of(self) -> dict[str, tuple[float, float]]:
        return dict(zip(self.scaled_columns(), zip(self.getOrDefault(self.means), self.getOrDefault(self.stds))))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self.params_of().items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.params_of().items()})

    def as_table(self, spark) -> DataFrame:
        rows = [(c, m, s) for c, (m, s) in self.params_of().items()]
        return spark.createDataFrame(rows, "feature string, mean double, std double")
