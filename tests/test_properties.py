"""Properties of the split, scaler, collapse, dummies, histograms and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facility_insights.models import evaluate, regress
from facility_insights.models.scaler import NullAwareStandardScaler
from facility_insights.operators import distribution, merge, reshape, sampling
from facility_insights.sources import shapes as sh

from .conftest import SMALL


def test_split_sizes_exact_and_partition_independent(spark):
    f = sh.features_num(spark, SMALL)
    a = sampling.stratified_split(f)
    b = sampling.stratified_split(f.repartition(7, "ccn"))
    assert sorted(map(tuple, a.select("ccn", "part").collect())) == sorted(map(tuple, b.select("ccn", "part").collect()))
    per = a.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("part") == "test").cast("int")).alias("t")).collect()
    for r in per:
        want = 0 if r["n"] <= 1 else int(np.ceil(0.33 * r["n"]))
        assert r["t"] == want


def test_scale_inverse_is_identity(spark):
    f = sh.features_num(spark, SMALL).select("ccn", "x1", "x2", "x3")
    m = NullAwareStandardScaler(inputCols=["x1", "x2", "x3"]).fit(f)
    back = {r["ccn"]: r for r in m.inverse(m.transform(f)).collect()}
    for r in f.collect():
        for c in ("x1", "x2", "x3"):
            assert (r[c] is None and back[r["ccn"]][c] is None) or back[r["ccn"]][c] == pytest.approx(r[c])


def test_collapse_idempotent(spark):
    ids = sh.provider_ids(spark, SMALL)
    once = merge.collapse_duplicates(ids, "ccn")
    twice = merge.collapse_duplicates(once, "ccn")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_dummies_sum_to_one_unless_null(spark):
    fac = sh.facility(spark, SMALL)
    d = reshape.one_hot(fac, ["ownership"])
    cols = [c for c in d.columns if c.startswith("ownership_")]
    total = sum(F.col(c) for c in cols)
    rows = d.join(fac.select("ccn", F.col("ownership").alias("o")), "ccn").select(total.alias("s"), "o").collect()
    assert all(r["s"] == (0 if r["o"] is None else 1) for r in rows)


def test_histogram_densities_integrate_to_one(spark):
    f = sh.features_num(spark, SMALL)
    h = distribution.hist_by_width(f, "y1", 1.0, "state").where(F.col("scope") == "national")
    assert sum(r["density"] * 1.0 for r in h.collect()) == pytest.approx(1.0)
    long = f.select("ccn", "x1", "x2").unpivot(["ccn"], ["x1", "x2"], "variable", "value")
    hc = distribution.hist_by_count(long, "variable", "value", 10).collect()
    for v in ("x1", "x2"):
        rows = [r for r in hc if r["variable"] == v]
        width = (max(r["bin_start"] for r in rows) - min(r["bin_start"] for r in rows)) / max(1, max(r["bin"] for r in rows) - min(r["bin"] for r in rows)) if len(rows) > 1 else 1.0
        assert sum(r["density"] for r in rows) * width == pytest.approx(1.0, rel=1e-6)


def test_imputed_table_has_no_nulls_and_keeps_values(spark):
    from facility_insights.operators import knn

    f = sh.features_num(spark, SMALL).select("ccn", "x1", "x2", "x3", "x4")
    out = {r["ccn"]: r for r in knn.knn_impute(f, f, "ccn", ["x1", "x2", "x3", "x4"]).collect()}
    for r in f.collect():
        for c in ("x1", "x2", "x3", "x4"):
            assert out[r["ccn"]][c] is not None
            if r[c] is not None:
                assert out[r["ccn"]][c] == r[c]


def test_planted_coefficients_recovered(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 2.0 + x @ np.array([1.5, -0.5, 3.0])
    df = spark.createDataFrame([(f"k{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "ccn string, a double, b double, c double, y double")
    m = regress.fit_linear(df, ["a", "b", "c"], "y")
    assert m.intercept == pytest.approx(2.0) and list(m.coefficients) == pytest.approx([1.5, -0.5, 3.0])
    per = evaluate.group_ols(df.withColumn("g", F.lit(0)), ["a", "b", "c"], "y")[0]
    assert per["intercept"] == pytest.approx(2.0) and per["c"] == pytest.approx(3.0)
    met = regress.metrics(df.withColumn("prediction", F.col("y")), "y").first()
    assert met["r2"] == pytest.approx(1.0) and met["mae"] == pytest.approx(0.0)


def test_same_seed_same_folds(spark):
    f = sh.features_num(spark, SMALL).select("ccn")
    a = sorted(map(tuple, f.select("ccn", sampling.fold_column("ccn")).collect()))
    b = sorted(map(tuple, f.repartition(3).select("ccn", sampling.fold_column("ccn")).collect()))
    assert a == b


def test_standing_over_several_ranges(spark):
    import random

    from facility_insights.operators import insight

    r = random.Random(2)
    rows = [(k, "a" if k % 3 else "b", r.choice([5.0, round(r.random() * 9, 2), None])) for k in range(400)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # each range stays a partition of its own
    try:
        df = spark.createDataFrame(rows, "ccn int, state string, y double")
        found = insight.entity_standing(df, "ccn", "state", "y").collect()
        ranges = {x._range for x in df.groupBy("y").count().repartitionByRange("y").withColumn("_range", F.spark_partition_id()).collect()}
        empty = insight.entity_standing(df.limit(0), "ccn", "state", "y").collect()
    finally:
        spark.conf.set(name, before)
    assert len(ranges) > 2 and empty == []
    held = [x for x in rows if x[2] is not None]
    assert sorted(x.ccn for x in found) == sorted(x[0] for x in held)
    for x in found:
        for scope, rank, dist in ((x.state, x.group_percent_rank, x.group_cume_dist), (None, x.nation_percent_rank, x.nation_cume_dist)):
            ys = [y for _, s, y in held if scope in (None, s)]
            assert abs(rank - sum(y < x.y for y in ys) / (len(ys) - 1)) < 1e-12
            assert abs(dist - sum(y <= x.y for y in ys) / len(ys)) < 1e-12
