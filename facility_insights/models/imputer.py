"""kNN imputer as a pipeline stage: fitted, saved and loaded like any Spark ML stage.

The fitted model is its donors and the columns' means. Saving writes the donors as Parquet beside the stage's
metadata, so a loaded model needs nothing of the session that fitted it. Both may be large: donors are a
DataFrame throughout and never pass through the driver.

A row's imputed values follow from its own features alone. So the rows to impute are told apart by a digest
of their features: equal rows are searched once, and rows need no key. Other columns pass through.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import knn
from ..session import scratch_path

_ROW = "_imputed_row"


class _ImputerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to fill, which are also the distance's features", typeConverter=TypeConverters.toListString)
    keyCol = Param(Params._dummy(), "keyCol", "donors' key: the smaller one is nearer on ties", typeConverter=TypeConverters.toString)
    k = Param(Params._dummy(), "k", "donors whose mean fills a cell", typeConverter=TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(k=S.KNN_IMPUTE_K)

    def columns(self) -> list[str]:
        return list(self.getOrDefault(self.inputCols))


def _digest(cols: list[str]) -> Column:
    """Identity of a row's features: 128 bits over the doubles, NULL and NaN alike."""
    return F.md5(F.concat_ws("|", *[F.coalesce(knn.number(c).cast("string"), F.lit("-")) for c in cols]))


class KnnImputer(Estimator, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the fit rows as donors. Rows without any feature are no donors."""

    @keyword_only
    def __init__(self, *, inputCols=None, keyCol=None, k=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**{name: v for name, v in kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "KnnImputerModel":
        cols, key = self.columns(), self.getOrDefault(self.keyCol)
        known = F.coalesce(*[knn.number(c) for c in cols]).isNotNull()
        path = scratch_path(df.sparkSession, "imputer-donors")
        df.where(known).select(F.col(key).cast("string").alias("_donor"), *[knn.number(c).alias(c) for c in cols]).write.parquet(path)
        donors = df.sparkSession.read.parquet(path)
        means = donors.agg(*[F.avg(c).alias(c) for c in cols]).first()
        model = KnnImputerModel(inputCols=cols, keyCol=key, k=self.getOrDefault(self.k), means=[float("nan") if means[c] is None else float(means[c]) for c in cols])
        model.donors = donors
        return model


class KnnImputerModel(Model, _ImputerParams, MLReadable, MLWritable):
    means = Param(Params._dummy(), "means", "means of the fit columns (NaN: no value)", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, keyCol=None, k=None, means=None):
        super().__init__()
        self.donors: DataFrame | None = None
        kwargs = self._input_kwargs
        self._set(**{name: v for name, v in kwargs.items() if v is not None})

    def copy(self, extra=None) -> "KnnImputerModel":
        that = super().copy(extra)
        that.donors = self.donors
        return that

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, names = self.columns(), df.columns
        rows = df.withColumn(_ROW, _digest(cols))
        gap = F.lit(False)
        for c in cols:
            gap = gap | knn.number(c).isNull()
        asked = rows.where(gap).select(_ROW, *[knn.number(c).alias(c) for c in cols]).distinct()
        donors = self.donors.withColumnRenamed("_donor", _ROW)
        found = knn.knn_target_means(asked, donors, _ROW, cols, cols, {c: F.col(c).isNull() for c in cols}, self.getOrDefault(self.k))
        wide = found.groupBy(_ROW).pivot("target", cols).agg(F.first("value"))
        wide = wide.select(_ROW, *[F.col(c).alias(f"_fill_{c}") for c in cols])
        out = rows.join(wide, _ROW, "left")
        filled = {c: F.coalesce(knn.number(c), F.col(f"_fill_{c}"), F.nanvl(F.lit(m), F.lit(None).cast("double"))) for c, m in zip(cols, self.getOrDefault(self.means), strict=True)}
        return out.withColumns(filled).select(*names)

    def write(self) -> "_DonorWriter":
        return _DonorWriter(self)

    @classmethod
    def read(cls) -> "_DonorReader":
        return _DonorReader(cls)


class _DonorWriter(MLWriter):
    def __init__(self, model: KnnImputerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.model.donors.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        self.model.donors.write.mode("overwrite").parquet(f"{path}/donors")


class _DonorReader(MLReader):
    def __init__(self, cls: type[KnnImputerModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KnnImputerModel:
        spark = self.sparkSession or SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.donors = spark.read.parquet(f"{path}/donors")
        return model
