"""Linear regression and metrics on Spark ML.

Features are assembled into a vector only at the model boundary; rows must be complete there
(impute first, OLS takes no NULLs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(
        df.withColumns({c: F.col(c).cast("double") for c in features})
    )


def fit_linear(df: DataFrame, features: Sequence[str], label: str):
    """Ordinary least squares with intercept (normal equations: one distributed Gram-matrix
    aggregate, solved on the driver — p x p, bounded by the number of features)."""
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0, elasticNetParam=0.0,
                          standardization=False, fitIntercept=True)
    return lr.fit(assemble(df, features))


def coefficient_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    rows = [("intercept", float(model.intercept))] + [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def predict(model, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    m = model.copy({model.predictionCol: out}) if hasattr(model, "predictionCol") else model
    return m.transform(assemble(df, features)).drop("features")


def linear_prediction(coefs: dict[str, float], features: Sequence[str]):
    """The linear predictor as a column expression (no vector, stays in codegen)."""
    expr = F.lit(coefs.get("intercept", 0.0))
    for f in features:
        expr = expr + F.lit(coefs[f]) * F.col(f).cast("double")
    return expr


def metrics(df: DataFrame, label: str, pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """R², MSE, RMSE, MAE (and n) in one aggregate, optionally per group (fold, model, ...).

    R² = 1 - Σ(y-ŷ)² / Σ(y-ȳ)² with Σ(y-ȳ)² = Σy² - (Σy)²/n (one pass)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    g = df.where(y.isNotNull() & p.isNotNull())
    g = g.groupBy(*by) if by else g.groupBy()
    a = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(y - p, 2)).alias("_sse"),
        F.sum(F.abs(y - p)).alias("_sae"),
        F.sum(y).alias("_sy"),
        F.sum(y * y).alias("_syy"),
    )
    sst = F.col("_syy") - F.pow(F.col("_sy"), 2) / F.col("n")
    return a.select(
        *by,
        F.col("n").cast("bigint").alias("n"),
        (F.lit(1.0) - F.col("_sse") / sst).alias("r2"),
        (F.col("_sse") / F.col("n")).alias("mse"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        (F.col("_sae") / F.col("n")).alias("mae"),
    )
