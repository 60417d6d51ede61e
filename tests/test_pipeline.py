"""Scaler and kNN imputer as saved pipeline stages; queries of the model jobs against plain NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

import __spark_entry__ as E
from facility_insights import schema as S
from facility_insights.models.imputer import KnnImputer
from facility_insights.models.scaler import NullAwareStandardScaler

from .conftest import SMALL

COLS = ["a", "b", "c"]


def plain_impute(rows, donors, k):
    """rows, donors: lists of feature lists with None; donors in the order of their keys."""
    p, out = len(COLS), []
    means = [np.mean([d[j] for d in donors if d[j] is not None]) if any(d[j] is not None for d in donors) else None for j in range(p)]
    for q in rows:
        found = []
        for n, d in enumerate(donors):
            shared = [j for j in range(p) if q[j] is not None and d[j] is not None]
            if shared:
                found.append((math.sqrt(p / len(shared) * sum((q[j] - d[j]) ** 2 for j in shared)), n))
        found.sort()
        filled = []
        for j in range(p):
            near = [donors[n][j] for _, n in found if donors[n][j] is not None][:k]
            filled.append(q[j] if q[j] is not None else np.mean(near) if near else means[j])
        out.append(filled)
    return out


@pytest.fixture(scope="module")
def gappy(spark):
    r = random.Random(3)
    rows = [[None if r.random() < 0.3 else round(r.gauss(0, 1), 3) for _ in COLS] for _ in range(120)]
    rows += [[None] * 3, [None, None, 0.5], [float("nan"), 1.0, 2.0]] + [[0.25, None, 0.125]] * 40
    df = spark.createDataFrame([(f"k{n:03d}", *v, float(n)) for n, v in enumerate(rows)], "key string, a double, b double, c double, y double")
    return rows, df


def test_imputer_is_plain_knn(spark, gappy):
    rows, df = gappy
    model = KnnImputer(inputCols=COLS, keyCol="key", k=4).fit(df.where("y < 100"))
    clean = [[None if v is None or math.isnan(v) else v for v in row] for row in rows]
    wanted = plain_impute(clean, clean[:100], 4)
    # rows may repeat, lack a key and bring columns named like the stage's own
    given = df.withColumns({"key": F.lit(None).cast("string"), "_donor": F.lit(1), "target": F.lit("t"), "value": F.lit(0)})
    found = {r.y: (r.a, r.b, r.c) for r in model.transform(given).collect()}
    assert len(found) == len(rows) and model.transform(given).columns == given.columns
    for n, want in enumerate(wanted):
        assert found[float(n)] == pytest.approx(want, abs=1e-9)
    assert model.transform(given.limit(0)).collect() == []


def test_a_column_without_values_stays_null_and_empty_fits_work(spark):
    df = spark.createDataFrame([("a", 1.0, None, 2.0), ("b", None, None, 4.0)], "key string, a double, b double, c double")
    out = {r.key: (r.a, r.b, r.c) for r in KnnImputer(inputCols=COLS, keyCol="key").fit(df).transform(df).collect()}
    assert out == {"a": (1.0, None, 2.0), "b": (1.0, None, 4.0)}
    empty = KnnImputer(inputCols=COLS, keyCol="key").fit(df.limit(0))
    assert {r.key: (r.a, r.b, r.c) for r in empty.transform(df).collect()} == {"a": (1.0, None, 2.0), "b": (None, None, 4.0)}


def test_a_saved_pipeline_scores_raw_rows_in_another_session(spark, gappy, tmp_path):
    df = gappy[1].replace(float("nan"), None)
    stages = [
        NullAwareStandardScaler(inputCols=COLS, excludeCols=["c"]),
        KnnImputer(inputCols=COLS, keyCol="key"),
        VectorAssembler(inputCols=COLS, outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="y", solver="normal"),
    ]
    model = Pipeline(stages=stages).fit(df)
    path = f"file://{tmp_path}/model"
    model.write().overwrite().save(path)
    model.write().overwrite().save(path)  # over itself
    other = spark.newSession()
    loaded = PipelineModel.read().session(other).load(path)
    df.write.parquet(f"file://{tmp_path}/rows")
    one = sorted((r.key, r.prediction) for r in model.transform(df).collect())
    two = sorted((r.key, r.prediction) for r in loaded.transform(other.read.parquet(f"file://{tmp_path}/rows")).collect())
    assert [k for k, _ in one] == [k for k, _ in two] and [v for _, v in one] == pytest.approx([v for _, v in two], abs=1e-12)
    # the donors lie in the model's own folder
    assert loaded.stages[1].donors.count() == model.stages[1].donors.count() > 0
    assert all(f.startswith(path) for f in loaded.stages[1].donors.inputFiles())


def test_insight_coefficients_are_those_of_plain_least_squares(spark):
    from facility_insights.plans.registry import preprocessing, split_table

    got = {(r.target, r.feature): r.coefficient for r in E.queries()["train_insight"](spark, SMALL).collect()}
    sp = split_table(spark, SMALL)
    for y in S.TARGETS:
        train = sp.where((F.col("part") == "train") & F.col(y).isNotNull()).select("ccn", *S.FEATURES_NUM, y)
        rows = preprocessing().fit(train).transform(train).collect()
        x = np.array([[1.0, *(r[c] for c in S.FEATURES_NUM)] for r in rows])
        beta = np.linalg.lstsq(x, np.array([r[y] for r in rows]), rcond=None)[0]
        assert [got[y, f] for f in ("intercept", *S.FEATURES_NUM)] == pytest.approx(list(beta), abs=1e-5)
